"""Which 64-bit keys occur more than once over many blocks, with a few bytes shuffled for each key.

A block sends its keys to each range of keys as one sorted run: the high 16 bits below the range number as
differences of a byte, the low bits as they are. What comes back to a block are the prefixes (range and sent bits)
of its keys that are asked for, or a bit for each key; the block works its keys out again to see which they are. So
no row per key is ever shuffled. Keys must be evenly spread, as hashes are.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN = "range int, block long, data binary"


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(values: np.ndarray) -> np.ndarray:
    """The distinct ones of sorted values. np.unique takes ten times as long: it hashes where no inverse is asked for."""
    new = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=new[1:])
    return values[new]


def sent(keys: np.ndarray, bits: int, low: int) -> np.ndarray:
    """Range number and sent bits of each key: its first `bits` + 16 + 8 * `low` bits."""
    return keys >> np.uint64(64 - bits - 16 - 8 * low)


def packed_run(tails: np.ndarray, low: int) -> bytes:
    """Sorted values of 16 + 8 * `low` bits."""
    high = (tails >> np.uint64(8 * low)).astype(np.int64)
    steps = np.diff(high, prepend=0)
    wide = bool(len(steps)) and bool(steps.max() > 255)
    lows = np.ascontiguousarray(tails.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :low])
    return struct.pack("<IB", len(tails), wide) + steps.astype("<u2" if wide else np.uint8).tobytes() + lows.tobytes()


def unpacked_run(data: bytes, low: int) -> np.ndarray:
    n, wide = struct.unpack_from("<IB", data)
    high = np.cumsum(np.frombuffer(data, "<u2" if wide else np.uint8, n, 5), dtype=np.uint64)
    lows = np.zeros((n, 8), np.uint8)
    lows[:, :low] = np.frombuffer(data, np.uint8, n * low, 5 + n * (2 if wide else 1)).reshape(n, low)
    return (high << np.uint64(8 * low)) | lows.view("<u8").reshape(-1).astype(np.uint64)


def runs_of(prefixes: np.ndarray, block: int, low: int) -> Iterator[tuple[int, int, bytes]]:
    """The block's run for each range that has one of its sorted prefixes."""
    tail = np.uint64(16 + 8 * low)
    ranges = (prefixes >> tail).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(prefixes)] if len(prefixes) else []
    mask = (np.uint64(1) << tail) - np.uint64(1)
    for a, b in zip(cuts, cuts[1:]):
        yield int(ranges[a]), block, packed_run(prefixes[a:b] & mask, low)


def run_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary())],
        names=["range", "block", "data"])


def range_bits(total_keys: int, per_range: int = 3_000_000) -> int:
    """Bits of the range number that leave about `per_range` keys to a range, at any size; 28 serve 8e14 keys."""
    return min(28, max(0, (max(1, total_keys) // per_range).bit_length()))


def _repeated(runs: list[np.ndarray]) -> list[np.ndarray]:
    """Of each run, the values that occur more than once in all runs."""
    all_ = np.sort(np.concatenate(runs))
    again = distinct(all_[1:][all_[1:] == all_[:-1]])
    if not len(again):
        return [r[:0] for r in runs]
    out = []
    for r in runs:
        at = np.minimum(np.searchsorted(again, r), len(again) - 1)
        out.append(distinct(r[again[at] == r]))
    return out


def _later(runs: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each run (sorted, distinct values), which of its values a run before it has, and which any other run has.

    The values that occur in several runs are looked up by binary search in each run's turn, the last run first, so
    that the first run of each is known in the end.
    """
    all_ = np.sort(np.concatenate(runs)) if runs else np.zeros(0, np.uint64)
    again = distinct(all_[1:][all_[1:] == all_[:-1]])
    if not len(again):
        return [(np.zeros(len(r), bool),) * 2 for r in runs]
    first, found = np.zeros(len(again), np.int32), []
    for i in range(len(runs) - 1, -1, -1):
        at = np.searchsorted(again, runs[i])
        at[at == len(again)] = 0
        shared = again[at] == runs[i]
        first[at[shared]] = i
        found.append((shared, at[shared].astype(np.int32)))
    out = []
    for i, (shared, at) in enumerate(reversed(found)):
        later = np.zeros(len(shared), bool)
        later[shared] = first[at] < i
        out.append((later, shared))
    return out


def repeated_keys(runs: DataFrame, low: int) -> DataFrame:
    """(block, found): the prefixes of each block that occur more than once in all blocks, as a list of binaries."""
    def answer(group: pd.DataFrame) -> pd.DataFrame:
        first = np.uint64(int(group["range"].iloc[0]) << (16 + 8 * low))
        found = _repeated([unpacked_run(x, low) for x in group["data"]])
        rows = [(b, (first | x).astype("<u8").tobytes()) for b, x in zip(group["block"], found) if len(x)]
        return pd.DataFrame(rows, columns=["block", "data"])

    answers = runs.groupBy("range").applyInPandas(answer, "block long, data binary")
    return answers.groupBy("block").agg(F.collect_list("data").alias("found"))


def later_keys(
    runs: DataFrame, low: int, find: Callable[[list[bytes]], list[tuple[np.ndarray, np.ndarray]]] | None = None,
) -> DataFrame:
    """(block, flags, notes): a bit for each key of a block's runs, set if a block of a smaller number has it as well.

    `flags` lists (range, bits, shared), in the order of the run, of the ranges that have a key in common with another
    block; `shared` has the bits of all such keys. The keys of a block are distinct. Rows of a negative range are notes
    of a block to itself, handed through. `find` may tell both from the runs of a range, smallest block first, in
    another way.
    """
    if find is None:
        def find(runs: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
            return _later([unpacked_run(x, low) for x in runs])

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["range"].iloc[0])
        if number < 0:
            return pd.DataFrame({"block": group["block"], "range": -1, "bits": None, "shared": None, "note": group["data"]})
        group = group.sort_values("block")
        found = find(list(group["data"]))
        rows = [(b, number, np.packbits(x).tobytes(), np.packbits(y).tobytes(), None) for b, (x, y) in zip(group["block"], found) if x.any() or y.any()]
        return pd.DataFrame(rows, columns=["block", "range", "bits", "shared", "note"])

    # Without a number, adaptive execution joins partitions until a task holds a tenth of all runs.
    dealt = runs.repartition(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "range")
    answers = dealt.groupBy("range").applyInPandas(answer, "block long, range int, bits binary, shared binary, note binary")
    return answers.groupBy("block").agg(
        F.collect_list(F.when(F.col("bits").isNotNull(), F.struct("range", "bits", "shared"))).alias("flags"),
        F.collect_list("note").alias("notes"))


def flagged(prefixes: np.ndarray, flags: list[dict] | None, low: int, field: str = "bits") -> np.ndarray:
    """For the sorted distinct prefixes of a block's runs, the bits (or `shared`) that `later_keys` gives."""
    out = np.zeros(len(prefixes), bool)
    ranges = prefixes >> np.uint64(16 + 8 * low)
    for flag in flags or []:
        a, b = np.searchsorted(ranges, np.array([flag["range"], flag["range"] + 1], np.uint64))
        out[a:b] = np.unpackbits(np.frombuffer(flag[field], np.uint8), count=int(b - a)).astype(bool)
    return out


def prefix_set(found: list[bytes] | None) -> np.ndarray:
    """The prefixes of one block, sorted."""
    parts = [np.frombuffer(x, "<u8") for x in found or []]
    return np.sort(np.concatenate(parts)).astype(np.uint64) if parts else np.zeros(0, np.uint64)


def among(prefixes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Whether each prefix is among the sorted `chosen`; a table of one bit by hash answers most at once."""
    out = np.zeros(len(prefixes), bool)
    if not len(chosen):
        return out
    size = np.uint64(64 - max(16, (len(chosen) * 16).bit_length()))
    slot = lambda x: ((x * np.uint64(0x9E3779B97F4A7C15)) >> size).astype(np.int64)
    table = np.zeros(1 << int(np.uint64(64) - size), bool)
    table[slot(chosen)] = True
    maybe = np.flatnonzero(table[slot(prefixes)])
    some = prefixes[maybe]
    out[maybe] = chosen[np.minimum(np.searchsorted(chosen, some), len(chosen) - 1)] == some
    return out
