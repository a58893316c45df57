"""Near-duplicate texts: SimHash tables by ball hashing find pairs, exact shingle similarity settles them.

One 64-bit fingerprint and 4 bits of difference find few of the pairs that share four fifths of their shingles, since
about 10 of their bits differ. Here a text has several short fingerprints, each of other bits of its shingles' hashes.
Every fingerprint emits itself and its variants of one bit; texts that share a variant differ in two bits or fewer of
that table. Pairs far apart in all bits of all tables drop out; of the rest, the nearest of each text and then those
between classes still apart are compared by their whole sets of shingles.

Length and number of the fingerprints follow from the number of texts and the recall asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.components import components
from seqspark.llm.runs import RUN, among, mixed, prefix_set, range_bits, repeated_keys, run_batch, runs_of, sent
from seqspark.llm.shared import slices, stored

#: Texts that a block holds; their variants are worked out together.
BLOCK = 2048
#: Bytes of a variant's hash sent as they are, besides its range and 16 bits.
LOW = 2
#: Keys that meet in one task at most, if all of them collide.
PART_KEYS = 4_000_000
#: A bucket of more texts is searched from pivots instead of by pairs.
SMALL = 8
#: Stands for a null doc_id.
NO_ID = (1 << 63) - 1


def differing(similarity: float) -> float:
    """Expected share of differing bits of two texts of equal size and this Jaccard similarity."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def plan(texts: int, similarity: float, recall: float) -> tuple[int, int]:
    """Bits of a fingerprint, ten more than number the texts, and how many reach `recall` at exactly `similarity`."""
    bits = min(54, max(20, max(1, texts).bit_length() + 10))
    p = differing(similarity)
    one = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - one))


def shingle_sets(texts: list[str | None], shingle: int = 5, seed: int = 42) -> list[np.ndarray]:
    """The distinct XXH64 of the word shingles of each text, A-Z in lower case; a shorter text is one shingle."""
    digest, out = xxhash.xxh64_intdigest, []
    for text in texts:
        words = text.encode().lower().split() if text else []
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        n = max(1, len(words) - shingle + 1) if words else 0
        starts, stops = [0, *(ends[:max(n - 1, 0)] + 1).tolist()], ends[len(words) - n:].tolist()
        out.append(np.unique(np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)))
    return out


def set_key(shingles: np.ndarray) -> int:
    """One 64-bit number for a set of shingles; 0 for an empty one."""
    return int(np.sum(mixed(shingles), dtype=np.uint64).astype(np.int64))


def signatures(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """`bits` SimHash bits of each set, packed: those that are set in over half of as many hashed bits of its shingles."""
    sizes = np.array([len(s) for s in sets], np.int64)
    out = np.zeros((len(sets), -(-bits // 64) * 64), bool)
    some = np.flatnonzero(sizes)
    if len(some):
        hashes = np.concatenate([sets[i] for i in some])
        begins = np.cumsum(sizes[some]) - sizes[some]
        # Bits are summed up as bytes, eight to a word, in pieces of 255 rows at most, so that no byte overflows.
        pieces = [np.arange(b, b + n, 255) for b, n in zip(begins, sizes[some])]
        first = np.cumsum([0, *map(len, pieces[:-1])])
        pieces = np.concatenate(pieces)
        for k in range(out.shape[1] // 64):
            salted = mixed(hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
            lanes = np.unpackbits(salted.view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
            sums = np.add.reduceat(lanes, pieces, axis=0).view(np.uint8)
            sums = np.add.reduceat(sums, first, axis=0, dtype=np.int64)
            out[some, 64 * k:64 * k + 64] = 2 * sums > sizes[some, None]
    return np.packbits(out[:, :bits], axis=1)


def _variants(packed: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """Every table's fingerprint and its variants of one bit, a row for each text; no two tables share one."""
    whole = np.unpackbits(packed, axis=1, count=bits * tables).reshape(len(packed), tables, bits)
    fp = whole.astype(np.uint64) @ (np.uint64(1) << np.arange(bits, dtype=np.uint64))
    fp |= np.arange(tables, dtype=np.uint64)[None, :] << np.uint64(bits)
    ball = np.concatenate([[np.uint64(0)], np.uint64(1) << np.arange(bits, dtype=np.uint64)])
    return mixed((fp[:, :, None] ^ ball).reshape(len(packed), -1))


def _apart(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of the signatures of each pair."""
    out = np.zeros(len(a), np.int64)
    for i in range(0, len(a), 1 << 16):
        out[i:i + (1 << 16)] = np.bitwise_count(words[a[i:i + (1 << 16)]] ^ words[b[i:i + (1 << 16)]]).sum(axis=1)
    return out


def near_pairs(variant: np.ndarray, node: np.ndarray, words: np.ndarray, close: int, loose: int) -> tuple[np.ndarray, ...]:
    """A forest (a, b, differing bits) over the nodes that share a variant and differ in `loose` bits or fewer.

    Pairs of `close` or fewer bits come first, so a class of near copies is joined by its nearest pairs.
    """
    order = np.lexsort((node, variant))
    variant, node = variant[order], node[order]
    cuts = np.flatnonzero(np.concatenate([[True], variant[1:] != variant[:-1], [True]])) if len(variant) else np.zeros(1, int)
    sizes = np.diff(cuts)
    size = np.repeat(sizes, sizes)
    parent = list(range(len(words)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int, int]] = []
    for limit in (close, loose):
        for i in np.flatnonzero(sizes > SMALL):
            some = node[cuts[i]:cuts[i + 1]]
            label = np.array([find(x) for x in some.tolist()])
            values, counts = np.unique(label, return_counts=True)
            # Of any pair between two classes one end is outside the largest.
            for at in np.flatnonzero(label != values[counts.argmax()]).tolist():
                others = np.flatnonzero(label != label[at])
                if not len(others):
                    break
                d = _apart(words, np.full(len(others), some[at]), some[others])
                near = np.flatnonzero(d <= limit)
                near = near[np.argsort(d[near], kind="stable")]
                classes, first = np.unique(label[others[near]], return_index=True)
                for j in near[first].tolist():
                    a, b = int(some[at]), int(some[others[j]])
                    found.append((a, b, int(d[j])))
                    parent[find(a)] = find(b)
                label[np.isin(label, classes)] = label[at]
        if limit == close:
            pairs = [np.zeros(0, np.int64)]
            for k in range(1, SMALL):
                i = np.flatnonzero((size[:-k] <= SMALL) & (variant[k:] == variant[:-k]))
                pairs.append(node[i] * len(words) + node[i + k])
            pairs = np.unique(np.concatenate(pairs))
            left, right = np.divmod(pairs, max(1, len(words)))
            apart = _apart(words, left, right)
            apart[left == right] = loose + 1
        some = np.flatnonzero((apart <= limit) & (apart > (close if limit == loose else -1)))
        for i in some[np.argsort(apart[some], kind="stable")].tolist():
            a, b = find(int(left[i])), find(int(right[i]))
            if a != b:
                parent[a] = b
                found.append((int(left[i]), int(right[i]), int(apart[i])))
    return tuple(np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def candidate_links(texts: DataFrame, bits: int, tables: int, similarity: float) -> DataFrame:
    """(a, b, d): links between the keys of `texts` (key, signature) that may be near, d of all their bits apart."""
    width = bits * tables
    spread = math.sqrt(differing(similarity) * (1 - differing(similarity)) / width)
    loose = math.ceil(width * (differing(similarity) + 3.5 * spread))
    close = math.floor(width * differing((1 + similarity) / 2))
    row = -(-width // 8)
    count = texts.count()
    keys = count * tables * (bits + 1)
    spans, parts = range_bits(keys), max(1, keys // PART_KEYS)

    def block_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, width_ = TaskContext.get().partitionId() << 32, [b"", b""], row

        def block(n: int) -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([held[0][:8 * n]], pa.binary()), pa.array([held[1][:width_ * n]], pa.binary())],
                names=["block", "keys", "sigs"])
            held[:] = held[0][8 * n:], held[1][width_ * n:]
            return out

        for batch in batches:
            held[0] += batch.column("key").to_numpy().astype("<i8").tobytes()
            held[1] += b"".join(batch.column("signature").to_pylist())
            while len(held[0]) >= 8 * BLOCK:
                yield block(BLOCK)
                number += 1
        if held[0]:
            yield block(BLOCK)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, sigs in zip(batch.column("block").to_pylist(), batch.column("sigs").to_pylist()):
                variants = _variants(np.frombuffer(sigs, np.uint8).reshape(-1, row), bits, tables)
                rows: list = []
                for run in runs_of(np.sort(sent(variants.reshape(-1), spans, LOW)), number, LOW):
                    rows.append(run)
                    if len(rows) == 64:
                        yield run_batch(rows)
                        rows = []
                yield run_batch(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, sigs, found in zip(*(batch.column(c).to_pylist() for c in ("keys", "sigs", "found"))):
                key, sig = np.frombuffer(names, "<i8"), np.frombuffer(sigs, np.uint8).reshape(-1, row)
                variants = _variants(sig, bits, tables)
                flat = variants.reshape(-1)
                hit = np.flatnonzero(among(sent(flat, spans, LOW), prefix_set(found)))
                variant, of = flat[hit], hit // variants.shape[1]
                part = (mixed(variant) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                edges = np.flatnonzero(np.diff(part[order], prepend=-1))
                rows = []
                for some in np.split(order, edges[1:]) if len(order) else []:
                    nodes, at = np.unique(of[some], return_inverse=True)
                    rows.append((int(part[some[0]]), variant[some].tobytes(), at.astype("<i4").tobytes(), key[nodes].tobytes(), sig[nodes].tobytes()))
                columns = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                    names=["part", "variants", "at", "keys", "sigs"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(x, "<i8") for x in group["keys"]]
        shift = np.cumsum([0, *map(len, keys[:-1])])
        node = np.concatenate([np.frombuffer(x, "<i4") + s for x, s in zip(group["at"], shift)])
        variant = np.concatenate([np.frombuffer(x, np.uint64) for x in group["variants"]])
        keys = np.concatenate(keys)
        words = np.zeros((len(keys), -(-row // 8) * 8), np.uint8)
        words[:, :row] = np.concatenate([np.frombuffer(x, np.uint8) for x in group["sigs"]]).reshape(-1, row)
        a, b, d = near_pairs(variant, node, words.view(np.uint64), close, loose)
        a, b = np.minimum(keys[a], keys[b]), np.maximum(keys[a], keys[b])
        return pd.DataFrame({"a": a, "b": b, "d": d.astype(np.int32)})

    blocks = stored(texts.select("key", "signature").mapInArrow(block_up, "block long, keys binary, sigs binary"), "text-blocks")
    repeated = repeated_keys(blocks.mapInArrow(emit, RUN), LOW)
    met = blocks.join(repeated, "block").select("keys", "sigs", "found").mapInArrow(
        meet, "part int, variants binary, at binary, keys binary, sigs binary")
    return met.groupBy("part").applyInPandas(join, "a long, b long, d int").distinct()


def similar_links(edges: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The links (a, b) of `edges` whose sets (key, shingles) have this Jaccard similarity or more."""
    one = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    pairs = edges.select("a", "b").join(one, "a").join(two, "b").select("a", "b", F.size("x").alias("m"), F.size("y").alias("n"), common.alias("c"))
    return pairs.where(F.col("c") / (F.col("m") + F.col("n") - F.col("c")) >= similarity).select("a", "b")


def near_classes(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, recall: float = 0.95, seed: int = 42) -> DataFrame:
    """doc_id and component_id (the smallest doc_id that links reach) of every row of `docs` (doc_id, text).

    Texts are linked if their sets of word shingles have at least this Jaccard similarity. All links that are used are
    true; a pair of exactly this similarity is found with a chance of `recall`, more similar ones more surely. Texts
    of the same shingles are one from the start, so copies cost nothing; texts without words are copies of each other.
    A null doc_id is never a component_id, unless all the component's are null. An empty table gives no row.
    """
    bits, tables = plan(docs.count(), similarity, recall)
    few = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = shingle_sets(batch.column("text").to_pylist(), shingle, seed)
            sigs = [x.tobytes() for x in signatures(sets, bits * tables)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([set_key(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())],
                names=["doc_id", "key", "signature"])

    def list_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            sets = shingle_sets(batch.column("text").to_pylist(), shingle, seed)
            # 32 bits of a hash tell the shingles of two texts apart.
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([s.astype(np.uint32).view(np.int32) for s in sets], pa.list_(pa.int32()))],
                names=["doc_id", "key", "shingles"])

    signed = stored(few.mapInArrow(sign, "doc_id long, key long, signature binary"), "signatures")
    texts = stored(signed.groupBy("key").agg(F.min("doc_id").alias("least"), F.first("signature").alias("signature")), "texts")
    edges = stored(candidate_links(texts, bits, tables, similarity), "edges")
    # One row of a text gives its shingles, so the rows of a hot text are spread over the shuffle and then drop out.
    at = F.coalesce("doc_id", F.lit(NO_ID))
    needed = edges.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(texts.select("key", "least"), "key").select(
        "key", F.coalesce("least", F.lit(NO_ID)).alias("at"))
    listed = few.mapInArrow(list_sets, "doc_id long, key long, shingles array<int>").select("key", at.alias("at"), "shingles")
    sets = stored(listed.join(needed, ["key", "at"]).groupBy("key").agg(F.first("shingles").alias("shingles")), "shingles")

    # First each text's nearest, then the nearest between each two classes still apart, then all that is left.
    ends = edges.select("a", "b", "d", F.explode(F.array("a", "b")).alias("node"))
    nearest = ends.groupBy("node").agg(F.min(F.struct("d", "a", "b")).alias("e")).select("e.a", "e.b").distinct()
    tried = stored(nearest, "tried")
    links = stored(similar_links(tried, sets, similarity), "near-links")
    roots = components(links)
    for last in (False, True):
        ca, cb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        open_ = edges.join(tried, ["a", "b"], "left_anti").join(ca, "a", "left").join(cb, "b", "left").select(
            "a", "b", "d", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).where("ra <> rb")
        if not last:
            open_ = open_.groupBy(F.least("ra", "rb"), F.greatest("ra", "rb")).agg(F.min(F.struct("d", "a", "b")).alias("e")).select("e.a", "e.b")
        chosen = stored(open_.select("a", "b"), "tried")
        if chosen.isEmpty():
            break
        more = stored(similar_links(chosen, sets, similarity), "near-links")
        tried = tried.unionByName(chosen)
        if not more.isEmpty():
            links = links.unionByName(more)
            roots = components(links)
    classes = stored(texts.join(roots, texts["key"] == roots["node"], "left").select("key", "least", F.coalesce("root", "key").alias("root")), "classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    # Only texts whose component or copies hold a smaller doc_id matter, but every row is returned.
    return signed.select("doc_id", "key").join(classes.select("key", "root").join(least, "root").select("key", "component_id"), "key").select("doc_id", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, recall: float = 0.95) -> DataFrame:
    """The rows of `docs`, all their columns, without those whose class of near-duplicates has a smaller doc_id.

    Rows that repeat a doc_id count as one document and stay or go together; a row without doc_id stays.
    """
    found = near_classes(docs.select("doc_id", "text"), similarity, shingle, recall)
    later = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti")
