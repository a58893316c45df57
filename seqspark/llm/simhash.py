"""Near-duplicates by SimHash, with links found by meet-in-the-middle ball hashing.

Two fingerprints at most 2r bits apart have a variant in common that is at most r bits from either. Every distinct
fingerprint emits all its variants within r bits; variants meet in a shuffle and those that only one fingerprint
emits drop out. What is left is worked out again by the block of fingerprints that emitted it, and each variant
links its fingerprints, which are all within 2r bits of one another. A variant has no more fingerprints than a
fingerprint has variants, so no group is large, and a part of the links is reduced to a spanning forest before it
leaves its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.components import components, spanning_links
from seqspark.llm.runs import RUN, among, mixed, prefix_set, range_bits, repeated_keys, run_batch, runs_of, sent
from seqspark.llm.shared import slices, stored

#: Fingerprints that a block holds; its variants are worked out together.
BLOCK = 2048
#: Bytes of a variant's hash sent as they are, besides its range and 16 bits.
LOW = 2


def fingerprints_of(texts: list[str | None], shingle: int = 4, seed: int = 42) -> np.ndarray:
    """64-bit SimHash of the word shingles of each text: bits set in over half of the shingles' XXH64."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.encode().lower().split() if text else []
        if not words:
            counts.append(0)
            continue
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        n = max(1, len(words) - shingle + 1)
        starts = [0, *(ends[:n - 1] + 1).tolist()]
        stops = ends[len(words) - n:].tolist()
        hashes += [digest(joined[a:b], seed) for a, b in zip(starts, stops)]
        counts.append(n)
    out = np.zeros(len(texts), np.uint64)
    if hashes:
        sizes = np.array(counts)
        some = np.flatnonzero(sizes)
        bits = np.unpackbits(np.array(hashes, np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        starts = (np.cumsum(sizes) - sizes)[some]
        set_ = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        over = 2 * set_ > sizes[some, None]
        out[some] = np.packbits(over, axis=1).view(">u8").reshape(-1).astype(np.uint64)
    return out


def masks(radius: int) -> np.ndarray:
    """All 64-bit values with at most `radius` bits set."""
    return np.array([sum(1 << i for i in c) for k in range(radius + 1) for c in combinations(range(64), k)], np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every whole text; none for a null text: 0 as well."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            fp = fingerprints_of(batch.column("text").to_pylist(), shingle, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])

    few = docs.selectExpr("cast(doc_id AS long) AS doc_id", "cast(text AS string) AS text")
    return few.mapInArrow(digest, "doc_id long, fp long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    number, held = TaskContext.get().partitionId() << 32, np.zeros(0, np.int64)

    def block(values: np.ndarray, number: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([number], pa.int64()), pa.array([values.astype("<i8").tobytes()], pa.binary())], names=["block", "fps"])

    for batch in batches:
        held = np.concatenate([held, batch.column("fp").to_numpy()])
        while len(held) >= BLOCK:
            yield block(held[:BLOCK], number)
            number, held = number + 1, held[BLOCK:]
    if len(held):
        yield block(held, number)


def linked_fingerprints(fps: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) that join all the distinct fingerprints of `fps` (fp) that are `distance` or fewer bits apart.

    `distance` is even. Not every pair is listed: the links' components are those of all pairs.
    """
    radius = distance // 2
    ball = masks(radius)
    blocks = stored(fps.select("fp").mapInArrow(_blocks, "block long, fps binary"), "fingerprint-blocks")
    total = blocks.agg(F.sum(F.octet_length("fps"))).first()[0] or 0
    bits = range_bits(total // 8 * len(ball))
    parts = max(1, (1 << bits) // 32)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("fps").to_pylist()):
                fp = np.frombuffer(data, "<u8").astype(np.uint64)
                keys = mixed((fp[:, None] ^ ball[None, :]).reshape(-1))
                rows: list = []
                for row in runs_of(np.sort(sent(keys, bits, LOW)), number, LOW):
                    rows.append(row)
                    if len(rows) == 64:
                        yield run_batch(rows)
                        rows = []
                yield run_batch(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, found in zip(batch.column("fps").to_pylist(), batch.column("found").to_pylist()):
                fp, chosen = np.frombuffer(data, "<u8").astype(np.uint64), prefix_set(found)
                pairs = []
                for some in np.array_split(fp, -(-len(fp) // 256)):
                    variants = (some[:, None] ^ ball[None, :]).reshape(-1)
                    hit = np.flatnonzero(among(sent(mixed(variants), bits, LOW), chosen))
                    pairs.append(np.stack([variants[hit], some[hit // len(ball)]]))
                variant, of = np.concatenate(pairs, axis=1)
                part = (mixed(variant) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                rows = [(p, variant[order[a:b]].tobytes(), of[order[a:b]].tobytes()) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
                yield pa.RecordBatch.from_arrays([
                    pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
                    pa.array([r[2] for r in rows], pa.binary()),
                ], names=["part", "variants", "fps"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        variant = np.concatenate([np.frombuffer(x, np.uint64) for x in group["variants"]])
        fp = np.concatenate([np.frombuffer(x, np.uint64) for x in group["fps"]])
        order = np.argsort(variant, kind="stable")
        variant, fp = variant[order], fp[order].view(np.int64)
        same = variant[1:] == variant[:-1]
        node, root = spanning_links(fp[1:][same], fp[:-1][same])
        return pd.DataFrame({"a": node, "b": root})

    repeated = repeated_keys(blocks.mapInArrow(emit, RUN), LOW)
    met = blocks.join(repeated, "block").select("fps", "found").mapInArrow(meet, "part int, variants binary, fps binary")
    return met.groupBy("part").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document (doc_id, text).

    component_id is the smallest doc_id that links of `distance` or fewer bits reach. Texts without words have
    fingerprint 0 and link like any other. Repeated rows and equal texts share a fingerprint. A null doc_id is
    never a component_id, unless all the component's are null. An empty table gives no row.
    """
    docs = stored(fingerprints(docs, shingle, seed), "fingerprints")
    fps = docs.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(linked_fingerprints(fps, distance))
    classes = stored(fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")), "classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return docs.join(classes.select("fp", "root").join(least, "root"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
