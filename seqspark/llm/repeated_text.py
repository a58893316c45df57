"""Removal of byte strings that occur earlier in the corpus, by suffix arrays of shards.

1. Documents are laid into shards of about `SHARD_BYTES`, in doc_id order, stored as a bucketed table.
2. Every window of `length` bytes has one anchor, the half-length string in it of least hash. Windows side by side with
   one anchor are a piece. Equal windows have equal anchors, so each shard sends its distinct pieces, as sorted runs of
   the anchor's short hash with a hash of 62 bits of the whole piece. A piece that an earlier shard has is repeated as
   it is. The windows of the others can only be elsewhere if their anchor is in another piece as well: few are.
3. In each shard the suffix array of what can repeat within it, refined to `length` bytes, and Kasai's common
   prefixes give the windows that occur earlier in the same shard, exactly.
4. Each shard sends the windows that 2 and 3 leave open as sorted runs of short hashes, about 32 bits more than tell
   ranges of some million keys apart. The runs are merged by binary search, which tells the windows that another, and
   that an earlier shard has.
5. Those are sent again by a hash of another kind, of 56 to 62 bits: sums of powers modulo two primes. A window counts
   as repeated if an earlier shard has it by both hashes.
6. The shards cover the bytes of all three kinds of window.

Results are exact but for windows that both hashes mistake: of n windows sent and m sent again, n * m / 2**70 are
expected (n and m of 1e10 and 3e9: 0.03); n different pieces are mistaken n * n / 2**63 times (n of 2e9: 0.4).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqspark.llm.runs import (
    RUN, distinct, flagged, later_keys, mixed, range_bits, run_batch, runs_of, sent, unpacked_run,
)
from seqspark.llm.shared import bucketed, stored
from seqspark.llm.suffix_array import common_prefixes, suffix_array

#: A task holds some 150 times a shard while it sorts suffixes.
SHARD_BYTES = 1 << 20
ANCHOR_LOW = 2
SURE_BITS = 62
_BASE = 0x9E3779B97F4A7C15
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))
#: Primes and a base for each.
_PRIMES = ((2**31 - 1, 1_103_515_247), (2**31 - 19, 1_664_525_003))
_powers: dict[tuple[int, int], np.ndarray] = {}


def _powers_of(base: int, n: int, modulus: int = 0) -> np.ndarray:
    """1, base, base**2, ...: `n` at least, modulo 2**64 or a prime below 2**31. Kept while they are for a usual shard."""
    powers = _powers.get((base, modulus), np.ones(1, np.uint32 if modulus else np.uint64))
    while len(powers) < n:
        step = pow(base, len(powers), modulus or 2**64)
        more = powers.astype(np.uint64) * np.uint64(step)
        powers = np.concatenate([powers, (more % np.uint64(modulus)).astype(np.uint32) if modulus else more])
    if len(powers) <= 2 * SHARD_BYTES:
        _powers[base, modulus] = powers
    return powers[:n]


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of the `length` bytes from each place on: sums of powers, from prefix sums."""
    n = len(data)
    if n < length:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    terms = _BYTES[data]
    terms *= _powers_of(_BASE, n)
    np.cumsum(terms, out=sums[1:])
    del terms
    out = sums[length:] - sums[:-length]
    out *= _powers_of(pow(_BASE, -1, 2**64), n)[:n - length + 1]
    del sums
    return mixed(out)


def sure_hashes(data: np.ndarray, places: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Hash of 62 bits, evenly spread over 64, of the `length` bytes (for each its own, if many) from each of `places` on."""
    out = np.zeros(len(places), np.uint64)
    for p, base in _PRIMES:
        prime, n = np.uint64(p), len(data)
        terms = (_BYTES >> np.uint64(34))[data]
        terms *= _powers_of(base, n, p)
        terms %= prime
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        del terms
        here = (sums[places + length] - sums[places]) % prime
        out = (out << np.uint64(31)) | here * _powers_of(pow(base, -1, p), n, p)[places] % prime
    return mixed(out)


def bytes_left(sizes: np.ndarray) -> np.ndarray:
    """For each byte, the bytes from it to the end of its document."""
    ends = np.cumsum(sizes).astype(np.int32)
    return np.repeat(ends, sizes) - np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)


def anchors_of(data: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that lie in one document, the place of each one's anchor, and the hashes of strings at all places."""
    half = length // 2
    hashes = string_hashes(data, half)
    windows = np.flatnonzero(left >= length)
    if not len(windows):
        return windows, windows, hashes
    place_bits = np.uint64(int(len(data)).bit_length())
    least = ((hashes >> place_bits) << place_bits) | np.arange(len(hashes), dtype=np.uint64)
    span, choices = 1, length - half + 1
    while 2 * span <= choices:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = choices - span
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    places = (least[windows] & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
    return windows, places, hashes


def pieces_of(
    data: np.ndarray, left: np.ndarray, length: int, bits: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows that lie in one document, the distinct piece of each, and whether its anchor is elsewhere in the data;
    sent bits of the anchors of the distinct pieces, in order, and the hashes of these pieces."""
    windows, places, hashes = anchors_of(data, left, length)
    if not len(windows):
        return windows, windows, np.zeros(0, bool), hashes[:0], hashes[:0]
    new = np.ones(len(places), bool)
    np.not_equal(places[1:], places[:-1], out=new[1:])
    firsts = np.flatnonzero(new)
    sizes = np.diff(np.append(firsts, len(windows)))
    anchors = hashes[places[firsts]]
    del places, hashes, new
    _, same, counts = np.unique(anchors, return_inverse=True, return_counts=True)
    again = np.repeat((counts > 1)[same], sizes)
    pieces, first, of = np.unique(sure_hashes(data, windows[firsts], sizes + length - 1), return_index=True, return_inverse=True)
    keys = sent(anchors[first], bits, ANCHOR_LOW)
    order = np.argsort(keys, kind="stable")
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    return windows, np.repeat(at[of], sizes), again, keys[order], pieces[order]


def piece_runs_of(keys: np.ndarray, pieces: np.ndarray, block: int) -> Iterator[tuple[int, int, bytes]]:
    """`runs_of` the anchors, each run with the hashes of its pieces behind it."""
    at = 0
    for number, block, run in runs_of(keys, block, ANCHOR_LOW):
        n = int.from_bytes(run[:4], "little")
        yield number, block, run + pieces[at:at + n].astype("<u8").tobytes()
        at += n


def _known_pieces(runs: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each run, smallest block first, which pieces a run before has, and whose anchors have more than one piece."""
    sizes = np.array([int.from_bytes(run[:4], "little") for run in runs])
    anchors = np.concatenate([unpacked_run(run, ANCHOR_LOW) for run in runs])
    pieces = np.concatenate([np.frombuffer(run, "<u8", offset=len(run) - 8 * n) for run, n in zip(runs, sizes)])
    order = np.argsort(pieces, kind="stable")
    later = np.zeros(len(pieces), bool)
    later[order[1:]] = pieces[order[1:]] == pieces[order[:-1]]
    order = np.argsort(anchors)
    new = np.ones(len(order), bool)
    new[1:] = anchors[order[1:]] != anchors[order[:-1]]
    starts, sorted_ = np.flatnonzero(new), pieces[order]
    several = np.minimum.reduceat(sorted_, starts) != np.maximum.reduceat(sorted_, starts)
    open_ = np.zeros(len(pieces), bool)
    open_[order] = np.repeat(several, np.diff(np.append(starts, len(order))))
    cuts = np.cumsum(sizes)[:-1]
    return list(zip(np.split(later, cuts), np.split(open_, cuts)))


def repeats_in(data: np.ndarray, left: np.ndarray, windows: np.ndarray, length: int) -> np.ndarray:
    """Which of the `windows` (ascending places) occur earlier in the data, by suffix array and common prefixes."""
    if not len(windows):
        return np.zeros(0, bool)
    edges = np.zeros(len(data) + 1, np.int32)
    edges[windows] += 1
    edges[windows + length] -= 1
    places = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
    new = np.ones(len(places), bool)
    new[1:] = (np.diff(places) > 1) | (left[places[1:]] > left[places[:-1]])
    sizes = np.diff(np.append(np.flatnonzero(new), len(places)))
    part, part_left = data[places], bytes_left(sizes)
    order = suffix_array(part, part_left, length)
    later = np.zeros(len(places), bool)
    later[order] = common_prefixes(part, part_left, order, length) >= length
    return later[np.searchsorted(places, windows)]


def _shards(ordered: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def shard() -> pa.RecordBatch:
            nonlocal number
            whole = pa.Table.from_batches(held).combine_chunks()
            whole = whole.take(pc.sort_indices(whole, [("doc_id", "ascending")], null_placement="at_start"))
            texts = [x or b"" for x in whole["text"].to_pylist()]
            ids = whole["doc_id"]
            first, last = ids[0].as_py(), ids[-1].as_py()
            rows = whole["row"].combine_chunks()
            number += 1
            block = number if ordered or first is None else first
            return pa.RecordBatch.from_arrays([
                pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([last], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), rows),
                pa.array([[len(x) for x in texts]], pa.list_(pa.int32())), pa.array([b"".join(texts)], pa.binary()),
                pa.array([sum(map(len, texts))], pa.int64()),
            ], names=["block", "first", "last", "rows", "sizes", "data", "n_bytes"])

        origin = None
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist()
            origins = batch.column("origin").to_pylist()
            begin = 0
            for i, (n, at) in enumerate(zip(lengths, origins)):
                if size and (size + n > SHARD_BYTES or (at != origin and not ordered)):
                    if i > begin:
                        held.append(batch.slice(begin, i - begin))
                    yield shard()
                    held, size, begin = [], 0, i
                size, origin = size + max(1, n), at
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if held:
            yield shard()
    return shards


def sharded(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The shards' table. Blocks are numbered in doc_id order, so that a smaller number is an earlier document.

    Input that is in order is taken as it lies, with the first doc_id as number; other input is ordered first, at
    the cost of one shuffle of the text. Joins on `block` read the bucketed table without a shuffle.
    """
    spark = docs.sparkSession
    few = docs.select(
        F.struct(*(F.col(f"`{x}`") for x in keep)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").cast("binary").alias("text"),
        F.concat(F.input_file_name(), F.lit("@"), F.input_file_block_start()).alias("origin"))
    kinds = few.schema["row"].dataType.simpleString()
    schema = f"block long, first long, last long, rows array<{kinds}>, sizes array<int>, data binary, n_bytes long"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(source: DataFrame, ordered: bool) -> DataFrame:
        return bucketed(source.mapInArrow(_shards(ordered), schema), "shards", "block", buckets)

    edges = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(
        F.input_file_name(), F.lit("@"), F.input_file_block_start()).alias("origin")).groupBy("origin").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"),
        F.count("doc_id").alias("ids"), F.count_distinct("doc_id").alias("distinct"))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    apart = edges.select(F.coalesce(
        (F.col("n") == F.col("distinct")) & (F.col("origin") != "@-1")
        & F.coalesce(F.max("last").over(before) < F.col("first"), F.lit(True)), F.lit(False)).alias("apart"))
    if not apart.where("NOT apart").isEmpty():
        ordered = few.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        return write(ordered, True)
    # Each piece of a file holds a range of ids; a shard of it must as well.
    return write(few.sortWithinPartitions("origin", "doc_id"), False)


def _plain(sizes: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = sizes.astype(np.int64)
    return np.frombuffer(data, np.uint8), bytes_left(sizes), sizes


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(x)[i] for x in names)


def _in_batches(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == 64:
            yield run_batch(held)
            held = []
    yield run_batch(held)


def removed_bytes(docs: DataFrame, keep: list[str], length: int = 100, low: int | None = None) -> tuple[DataFrame, Callable]:
    """Shards with their answers, and the function that gives of one such row its bytes, sizes and removed bytes.

    `low` is how many bytes of the first hash are sent besides 16 bits and the range; by default two.
    """
    shards = sharded(docs, keep)
    total = shards.agg(F.sum("n_bytes")).first()[0] or 0
    anchor_bits, bits = range_bits(total // 20, 1_000_000), range_bits(total // 4, 2_000_000)
    sure_low = (SURE_BITS - 15 - bits) // 8
    low = 2 if low is None else low
    note_groups = max(1021, 1 << bits)

    def piece_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, sizes, data in _rows(batches, "block", "sizes", "data"):
            data, left, _ = _plain(sizes.values.to_numpy(), data.as_py())
            *_, keys, pieces = pieces_of(data, left, length, anchor_bits)
            yield from _in_batches(piece_runs_of(keys, pieces, block.as_py()))

    def window_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, sizes, data, found in _rows(batches, "block", "sizes", "data", "found"):
            data, left, _ = _plain(sizes.values.to_numpy(), data.as_py())
            windows, piece, again, keys, _ = pieces_of(data, left, length, anchor_bits)
            found = found.as_py()
            gone = flagged(keys, found, ANCHOR_LOW)[piece]
            open_ = flagged(keys, found, ANCHOR_LOW, "shared")[piece]
            # A window that an earlier shard has too is settled there, whatever is known of it here.
            here = again & ~gone
            gone[here] = repeats_in(data, left, windows[here], length)
            firsts = windows[open_ & ~gone]
            if not len(firsts) and not gone.any():
                continue
            flags = np.zeros((2, len(data)), bool)
            flags[0, firsts] = flags[1, windows[gone]] = True
            number = block.as_py()
            note = (-1 - number % note_groups, number, zlib.compress(np.packbits(flags).tobytes(), 1))
            keys = distinct(np.sort(sent(string_hashes(data, length)[firsts], bits, low)))
            yield from _in_batches(x for part in ([note], runs_of(keys, number, low)) for x in part)

    def asked_again(data, flags, notes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows known to repeat; of the others those that another shard has by the first hash, their second, and if it is earlier."""
        marks = np.unpackbits(np.frombuffer(zlib.decompress(notes[0]), np.uint8), count=2 * len(data)).astype(bool)
        firsts, later = np.flatnonzero(marks[:len(data)]), np.flatnonzero(marks[len(data):])
        if not flags:
            return later, firsts[:0], np.zeros(0, np.uint64), np.zeros(0, bool)
        keys, same = np.unique(sent(string_hashes(data, length)[firsts], bits, low), return_inverse=True)
        shared = flagged(keys, flags, low, "shared")[same]
        again = firsts[shared]
        return later, again, sent(sure_hashes(data, again, length), bits, sure_low), flagged(keys, flags, low)[same][shared]

    def sure_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data, flags, notes in _rows(batches, "block", "data", "flags", "notes"):
            _, _, keys, _ = asked_again(np.frombuffer(data.as_py(), np.uint8), flags.as_py(), notes.as_py())
            yield from _in_batches(runs_of(distinct(np.sort(keys)), block.as_py(), sure_low))

    def removed(sizes, data, flags, notes, sure) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, _, sizes = _plain(sizes, data)
        gone = np.zeros(len(data), bool)
        if notes:
            later, again, second, earlier = asked_again(data, flags, notes)
            keys, same = np.unique(second, return_inverse=True)
            edges = np.zeros(len(data) + 1, np.int32)
            for starts in (later, again[earlier & flagged(keys, sure, sure_low)[same]]):
                edges[starts] += 1
                edges[starts + length] -= 1
            gone = np.cumsum(edges[:-1]) > 0
        return data, sizes, gone

    known = later_keys(shards.select("block", "sizes", "data").mapInArrow(piece_runs, RUN), ANCHOR_LOW, _known_pieces)
    # Shards without such pieces may still have repeats of their own.
    asked = shards.join(known, "block", "left").select("block", "sizes", "data", F.col("flags").alias("found"))
    answers = stored(later_keys(asked.mapInArrow(window_runs, RUN), low), "window-answers")
    again = shards.join(answers.where(F.size("flags") > 0), "block").select("block", "data", "flags", "notes")
    sure = later_keys(again.mapInArrow(sure_runs, RUN), sure_low).select("block", F.col("flags").alias("sure"))
    found = shards.join(answers, "block", "left").join(sure, "block", "left")
    return found.select("rows", "sizes", "data", "flags", "notes", "sure"), removed


def _documents(df: DataFrame, removed: Callable, kinds: str, fields: str, of: Callable) -> DataFrame:
    """A row for each document: `row` and what `of` makes of its bytes and of which are removed."""
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.from_numpy_dtype("int64") if f.endswith(" long") else pa.string() for f in fields.split(", ")]
        names = [f.split()[0] for f in fields.split(", ")]
        for rows, sizes, data, flags, notes, sure in _rows(batches, "rows", "sizes", "data", "flags", "notes", "sure"):
            bytes_, sizes, gone = removed(sizes.values.to_numpy(), data.as_py(), flags.as_py(), notes.as_py(), sure.as_py())
            ends = np.cumsum(sizes)
            made = [of(bytes_[a:b], gone[a:b]) for a, b in zip(ends - sizes, ends)]
            columns = [pa.array(x, t) for x, t in zip(zip(*made), types)]
            yield pa.RecordBatch.from_arrays([rows.values, *columns], names=["row", *names])

    return df.mapInArrow(each, f"row {kinds}, {fields}")


def _kinds(df: DataFrame) -> str:
    return df.schema["rows"].dataType.elementType.simpleString()


def repeat_digests(docs: DataFrame, length: int = 100, low: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document (doc_id, text).

    A byte is removed if a string of `length` bytes that covers it starts earlier as well: in a document of smaller
    doc_id, or before in the same one. Null text is empty; a null doc_id comes first, and rows that repeat a doc_id
    are taken in order of their text. Other columns are ignored.
    """
    def digest(data: np.ndarray, gone: np.ndarray) -> tuple[int, int, int, str]:
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = data if not spans else data[~gone]
        return len(data), int(gone.sum()), spans, hashlib.sha256(kept.tobytes()).hexdigest()

    df, removed = removed_bytes(docs, ["doc_id"], length, low)
    out = _documents(df, removed, _kinds(df), "n_bytes long, n_removed long, n_spans long, kept_sha256 string", digest)
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """`docs`, all columns, with the repeated bytes cut from `text`; n_chars, if there, is counted anew.

    A character of which a byte goes, goes as a whole. A document that loses everything stays, with an empty text.
    """
    def text(data: np.ndarray, gone: np.ndarray) -> tuple[str]:
        return (data[~gone].tobytes().decode("utf-8", "ignore"),)

    rest = [x for x in docs.columns if x != "text"]
    df, removed = removed_bytes(docs, rest, length)
    out = _documents(df, removed, _kinds(df), "text string", text)
    made = {"text": F.col("text"), "n_chars": F.length("text").cast(docs.schema["n_chars"].dataType if "n_chars" in rest else "long")}
    return out.select(*(made.get(x, F.col("row")[x]).alias(x) for x in docs.columns))
