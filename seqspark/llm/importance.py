"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Words and pairs of words are hashed to a set number of buckets. The raw model counts every document, the target
model the documents known to be good; the log-weight of a document is the sum over its n-grams of the log of target
over raw probability. Log-weight plus Gumbel noise, fixed by doc_id, and taking the k highest, draws k documents
without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm.shared import slices, stored

_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
#: Distinct words whose hash a worker remembers before it starts anew.
REMEMBERED = 500_000


class WordHashes:
    """64-bit hashes of words, each worked out once while it is remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            for word in set(words).difference(self.known):
                self.known[word] = xxhash.xxh64_intdigest(word.encode())
            return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def ngram_buckets(texts: list[str | None], hashes: WordHashes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word and each pair of neighbouring words, and the number of the text that has it."""
    split = [x.split() if x else [] for x in texts]
    h = hashes.of([w for words in split for w in words])
    text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, split), np.int64, len(split)))
    same = text[1:] == text[:-1] if len(text) else np.zeros(0, bool)
    pair = (h[:-1][same] * _MULTIPLY + h[1:][same]) * _MULTIPLY
    all_ = np.concatenate([h * _MULTIPLY, pair])
    return ((all_ >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), np.concatenate([text, text[1:][same]])


def _counter(buckets: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros((2, buckets), np.int64)
        for batch in slices(batches, "text"):
            bucket, text = ngram_buckets(batch.column("text").to_pylist(), hashes, buckets)
            target = batch.column("target").to_numpy(zero_copy_only=False).astype(bool)
            counts[0] += np.bincount(bucket, minlength=buckets)
            counts[1] += np.bincount(bucket[target[text]], minlength=buckets)
        some = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["bucket", "raw", "target"])
    return count


def log_ratios(docs: DataFrame, targets: DataFrame, buckets: int, smoothing: float = 1.0) -> np.ndarray:
    """Log of target over raw probability by bucket, from all n-grams of `docs` (doc_id, text).

    `targets` (doc_id) must be of bounded size: it is broadcast. The driver gets one row for each bucket.
    """
    marked = docs.select("doc_id", "text").join(
        F.broadcast(targets.select("doc_id", F.lit(True).alias("target"))), "doc_id", "left")
    few = marked.select("text", F.coalesce("target", F.lit(False)).alias("target"))
    sums = few.mapInArrow(_counter(buckets), "bucket long, raw long, target long").groupBy("bucket").agg(
        F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for r in sums:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + smoothing) / (target.sum() + smoothing * buckets)) - np.log(
        (raw + smoothing) / (raw.sum() + smoothing * buckets))


def _scorer(ratios: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text"):
            bucket, text = ngram_buckets(batch.column("text").to_pylist(), hashes, len(ratios))
            weights = np.bincount(text, ratios[bucket], minlength=batch.num_rows)
            counts = np.bincount(text, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), batch.column("doc_id"), pa.array(counts), pa.array(weights)],
                names=["row", "doc_id", "n_ngrams", "log_weight"])
    return score


def kth_largest(values: DataFrame, k: int, bins: int = 4096, collect: int = 20_000) -> float:
    """The k-th largest of the single double column `v` (no nulls or NaN): counts by interval until few are left."""
    low, high = values.agg(F.min("v"), F.max("v")).first()
    while True:
        inside = values.where(F.col("v").between(low, high))
        width = (high - low) / bins
        if width == 0 or low + width == low:
            break
        place = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1))
        counts = inside.groupBy(place.alias("place")).agg(
            F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy(F.desc("place")).collect()
        for r in counts:
            if r["n"] >= k:
                break
            k -= r["n"]
        low, high = r["low"], r["high"]
        if r["n"] <= collect or low == high:
            break
    if low == high:
        return low
    return sorted((r["v"] for r in values.where(F.col("v").between(low, high)).collect()), reverse=True)[k - 1]


def resample(
    docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, share: float | None = None, buckets: int = 1 << 16,
    target_rows: int = 50_000, seed: int = 7,
) -> DataFrame:
    """Every row of `docs` (as struct `row`, its columns `keep`) with doc_id, n_ngrams, log_weight, score and kept.

    The target model is fitted on at most `target_rows` documents with quality 1 (a sample by hash of doc_id). `share`
    of the rows is kept; if None, the share of good documents among the labelled ones. Equal scores at the limit are
    all kept. A null or empty text has weight 1; without good labels all weights are 1; an empty table gives none.
    """
    source = docs.select(
        F.struct(*(F.col(f"`{x}`") for x in keep or docs.columns)).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where("doc_id is not null and quality is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    known = known.join(source.select("doc_id").distinct(), "doc_id")
    targets = known.where("quality > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows).select("doc_id")
    ratios = log_ratios(source, targets, buckets)
    kinds = source.schema["row"].dataType.simpleString()
    scored = source.mapInArrow(_scorer(ratios), f"row {kinds}, doc_id long, n_ngrams long, log_weight double")
    scored = stored(scored, "importance")
    # Uniform in (0, 1) by doc_id, then Gumbel.
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) * 2.0**-53
    scored = scored.withColumn("score", F.col("log_weight") - F.log(-F.log(uniform)))
    if share is None:
        good = known.agg(F.avg((F.col("quality") > 0).cast("double"))).first()[0]
        share = 1.0 if good is None else good
    n = scored.count()
    k = min(n, round(share * n))
    limit = kth_largest(scored.select(F.col("score").alias("v")), k) if k else float("inf")
    return scored.withColumn("kept", F.col("score") >= limit)


def keep_resampled(docs: DataFrame, labels: DataFrame, **parameters: float) -> DataFrame:
    """The rows of `docs`, all their columns, that the resampling keeps."""
    return resample(docs, labels, **parameters).where("kept").select("row.*")
