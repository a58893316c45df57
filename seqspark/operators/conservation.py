"""Enrichment of a motif's core k-mers against composition-preserving shuffles."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as P

from seqspark.operators.repeats import CODE

SHUFFLES = 100
EPSILON = 1e-6
#: Bases of all shuffles worked out at a time.
CELLS = 1 << 18

# Motif class -> k-mer family.
FAMILY = {
    "G-Quadruplex Family": "G", "i-motif family": "C", "Triplex": "C", "Z-DNA": "Z", "R-loop": "R",
    "Curved DNA": "AT",
}
SUBTYPE_FAMILY = {"AC-motif": "AC", "sticky DNA": "all"}


def family_of(cls="class", subtype="subtype") -> Column:
    out = None
    for table, column in ((SUBTYPE_FAMILY, subtype), (FAMILY, cls)):
        for name, family in table.items():
            hit = F.col(column) == name
            out = F.when(hit, family) if out is None else out.when(hit, family)
    return out.otherwise("all")


def kmer_size(family, n) -> Column:
    """k grows with the motif length between a lower and an upper bound."""
    bounded = lambda low, high, part: F.least(F.lit(high), F.greatest(F.lit(low), F.floor(n / part).cast("int")))
    return (
        F.when(family == "Z", bounded(3, 6, 6)).when(family == "AC", bounded(4, 6, 4))
        .when(family == "AT", bounded(4, 6, 6)).otherwise(bounded(4, 8, 4))
    )


def _in_family(letters: np.ndarray, family: str, k: int) -> np.ndarray:
    """Which k-mers of a motif, one for each start, belong to its family; equal k-mers all do or none does."""
    places = max(len(letters) - k + 1, 0)

    def inside(hit, width=1):
        """How many hits of ``width`` letters each k-mer holds."""
        upto = np.append(0, np.cumsum(hit))
        return upto[k - width + 1:][:places] - upto[:places]

    base = lambda *names: np.isin(letters, [ord(c) for c in names])
    run = lambda hit: hit[2:] & hit[1:-1] & hit[:-2]
    if not places:
        return np.zeros(0, bool)
    if family in ("G", "C"):
        runs = inside(run(base(family)), 3) > 0
        return runs if runs.any() else inside(base(family)) >= k // 2
    if family == "Z":
        pair = letters[:-1].astype(np.int32) * 256 + letters[1:]
        steps = np.isin(pair, [ord(a) * 256 + ord(b) for a, b in ("GC", "CG", "GT", "TG", "AC", "CA")])
        return inside(steps, 2) >= (k - 1) // 2
    if family == "AC":
        return inside(base("A", "C")) / k >= 0.6
    if family == "R":
        return inside(base("G")) / k >= 0.4
    if family == "AT":
        return (inside(run(base("A")), 3) > 0) | (inside(run(base("T")), 3) > 0)
    return np.ones(places, bool)


def _codes(rows: np.ndarray, k: int) -> np.ndarray:
    """2-bit code of the k-mer at every place of each row, put together from codes of half as many bases."""
    if k == 1:
        return rows.astype(np.uint16)
    half = k // 2
    codes = _codes(rows, half)
    places = max(rows.shape[1] - k + 1, 0)
    if k > 8:
        codes = codes.astype(np.int64)
    out = (codes[:, :places] << 2 * half) | codes[:, half:half + places]
    return (out << 2) | rows[:, k - 1:k - 1 + places] if k % 2 else out


def shuffle_counts(sequence: str, k: int, core: list[str], shuffles: int = SHUFFLES) -> np.ndarray:
    """In each seeded shuffle of the bases, how many k-mers are in ``core``.

    The seed is the CRC of the sequence, so a sequence always gets the same numbers.
    """
    kmers = CODE[np.frombuffer("".join(core).encode("ascii", "replace"), np.uint8)].reshape(-1, k)
    return _shuffled(sequence, CODE[np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)], k, _codes(kmers, k)[:, 0], shuffles)


def _shuffled(sequence: str, bases: np.ndarray, k: int, core: np.ndarray, shuffles: int) -> np.ndarray:
    wanted = np.zeros(4**k, bool)
    wanted[core] = True
    rng, out = np.random.default_rng(zlib.crc32(sequence.encode())), []
    step = max(1, CELLS // max(len(bases), 1))
    for s in range(0, shuffles, step):
        # numbers of eight bytes are moved faster, to the same places
        mixed = rng.permuted(np.tile(bases.astype(np.int64), (min(step, shuffles - s), 1)), axis=1)
        out.append(wanted[_codes(mixed.astype(np.uint8), k)].sum(axis=1))
    return np.concatenate(out)


def _rated(sequence: str, family: str, k: int, shuffles: int):
    """How many k-mers belong to the family, mean and deviation of that in shuffles, and how many shuffles have as many."""
    if len(sequence) < 4:
        return None
    letters = np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)
    found = np.flatnonzero(_in_family(letters, family, k))
    if not len(found):
        return None
    bases = CODE[letters]
    counts = _shuffled(sequence, bases, k, _codes(bases[None], k)[0, found], shuffles)
    mean = counts.sum() / shuffles
    # added up from the first shuffle to the last
    spread = np.cumsum((counts - mean) * (counts - mean))[-1] / (shuffles - 1) if shuffles > 1 else None
    return len(found), mean, None if spread is None else np.sqrt(spread), int((counts >= len(found)).sum())


RATED = P.StructType([
    P.StructField("observed", P.IntegerType()), P.StructField("mean", P.DoubleType()), P.StructField("std", P.DoubleType()),
    P.StructField("extreme", P.IntegerType()),
])


def _counts(shuffles: int):
    def rated(sequence: pd.Series, family: pd.Series, k: pd.Series) -> pd.DataFrame:
        rows = [
            (None if s is None else _rated(s, f, int(n), shuffles)) or (None,) * len(RATED)
            for s, f, n in zip(sequence, family, k)
        ]
        return pd.DataFrame(rows, columns=RATED.names, dtype=object)

    return F.pandas_udf(rated, RATED)


def with_conservation(motifs: DataFrame, family: Column | None = None, shuffles: int = SHUFFLES) -> DataFrame:
    """Adds conservation_score, conservation_p, conservation_significance and the counts behind them.

    The k-mers of a motif and its shuffles are one numpy step on its row, so no row is copied once per shuffle.
    """
    rows = motifs.withColumn("_f", family_of() if family is None else family)
    rows = rows.withColumn("_k", kmer_size(F.col("_f"), F.length("sequence")))
    rows = rows.withColumn("_rated", _counts(shuffles)("sequence", "_f", "_k"))
    rows = rows.withColumn("_valid", F.col("_rated.observed").isNotNull())
    rows = rows.withColumn("observed_count", F.col("_rated.observed"))
    rows = rows.withColumn("null_mean", F.col("_rated.mean")).withColumn("null_std", F.col("_rated.std"))
    score = F.log2((F.col("observed_count") + EPSILON) / (F.col("null_mean") + EPSILON))
    as_extreme = F.col("_rated.extreme")
    rows = rows.withColumn("conservation_score", F.when(F.col("_valid"), score).otherwise(0.0))
    rows = rows.withColumn(
        "conservation_p", F.when(F.col("_valid"), (1 + as_extreme) / F.lit(shuffles + 1.0)).otherwise(1.0)
    )
    c = F.col("conservation_score")
    label = F.when(c >= 2.5, "high").when(c >= 1.5, "medium").when(c >= 0.5, "low").otherwise("not significant")
    rows = rows.withColumn(
        "conservation_significance", F.when(F.col("conservation_p") <= 0.05, label).otherwise("not significant")
    )
    return rows.drop("_f", "_k", "_rated", "_valid")
