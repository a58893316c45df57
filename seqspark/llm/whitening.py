"""Whitening of vectors by components of their exact covariance.

1. Entries become integers. Every task sums products exactly; the sums of all tasks are the integer scatter.
2. Tasks take primes and give the scatter's characteristic polynomial modulo each; remainders are combined.
3. Roots are isolated with exact counts; tasks refine each root and find the vectors of its null space.
4. Every vector is projected, in one pass; another one measures the covariance of the result.

What reaches the driver is bounded by the dimension d: d * d sums, a number of d + 1 residues for each prime, and k
vectors of d entries.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqspark.llm import exact_spectrum as spectrum

#: An entry c becomes floor(STEPS * c) + SHIFT. Covariances don't depend on SHIFT, so sums are taken without it.
STEPS = 64
SHIFT = 1_000_000
#: Entries from here on would have no long, and count as not finite.
TOO_LARGE = 2.0**56
#: Rows worked on at a time.
ROWS = 8192


def finite_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and values (doubles) of rows whose vector is there, all finite, and of the commonest length (ties: longest)."""
    found = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("values")).where(
        F.coalesce(F.forall("values", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < TOO_LARGE), F.lit(False))), F.lit(False)))
    common = found.groupBy(F.size("values").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.where(F.size("values") == (common["d"] if common else -1))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """vec_ids and their integers without SHIFT, a row for each vector."""
    for batch in batches:
        for begin in range(0, batch.num_rows, ROWS):
            part = batch.slice(begin, ROWS)
            values = part.column("values").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            yield part.column("vec_id"), np.floor(STEPS * values).astype(np.int64)


def products(y: np.ndarray) -> np.ndarray:
    """The exact y' y as Python integers: in doubles where every sum stays below 2**53, else a part of the rows at a time."""
    largest = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0)))) or 1
    rows = 2**53 // largest**2
    if not rows:
        wide = y.astype(object)
        return wide.T.dot(wide)
    total = np.zeros((y.shape[1],) * 2, object)
    for begin in range(0, len(y), rows):
        part = y[begin:begin + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64)
    return total


def scatter(found: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """n, the sums S by dimension (without SHIFT) and n * sum(y y') - S S', all exact."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, 0, 0
        for _, y in _blocks(batches):
            n, one, two = n + len(y), one + y.astype(object).sum(axis=0), two + products(y)
        if n:
            d = len(one)
            cells = [n, *one, *two[np.triu_indices(d)]]
            # In two parts, so that sums of any number of longs' products fit a decimal.
            high, low = [c >> 64 for c in cells], [c & (1 << 64) - 1 for c in cells]
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([
                pa.array(range(len(cells)), pa.int32()), pa.array([Decimal(int(c)) for c in high], kind),
                pa.array([Decimal(int(c)) for c in low], kind)], names=["cell", "high", "low"])

    rows = found.mapInArrow(sums, "cell int, high decimal(38,0), low decimal(38,0)").groupBy("cell").agg(
        F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    if not rows:
        return 0, np.zeros(0, object), np.zeros((0, 0), object)
    cells = [0] * len(rows)
    for r in rows:
        cells[r["cell"]] = (int(r["high"]) << 64) + int(r["low"])
    n, d = cells[0], int((9 + 8 * (len(cells) - 1)) ** 0.5 - 3) // 2  # d + d * (d + 1) / 2 cells follow n
    one, two = np.array(cells[1:1 + d], object), np.zeros((d, d), object)
    two[np.triu_indices(d)] = cells[1 + d:]
    two = two + np.triu(two, 1).T
    return n, one, n * two - np.outer(one, one)


def components_of(found: DataFrame, n: int, matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The largest eigenvalues above 0 (falling) of matrix / n**2, their share in its trace, and unit vectors as rows."""
    spark, d = found.sparkSession, len(matrix)
    matrix, divisor = spectrum.reduced(matrix)
    trace = int(np.trace(matrix)) if d else 0
    if not trace:
        return np.zeros(0), np.zeros(0), np.zeros((0, d))
    primes = spectrum.primes_for(matrix)
    tasks = spark.sparkContext.defaultParallelism

    def remainders(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p in frame["p"]:
                yield pd.DataFrame({"p": [p], "values": [spectrum.residues(matrix, int(p)).tolist()]})

    dealt = spark.createDataFrame([(p,) for p in primes], "p long").repartition(min(tasks, len(primes)))
    poly = spectrum.combined({r["p"]: r["values"] for r in dealt.mapInPandas(remainders, "p long, values array<long>").collect()})
    bits = max(0, spectrum.DEPTH - trace.bit_length())
    poly = spectrum.stretched(poly, bits)
    intervals = spectrum.isolated(poly, (trace + 1) << bits, most)

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for low, high, count in zip(frame["low"], frame["high"], frame["n"]):
                root = spectrum.refined(poly, int(low), int(high), int(count))
                found = spectrum.null_vectors(matrix, root, bits, int(count))
                yield pd.DataFrame({"root": [str(root)] * len(found), "vector": [v.tolist() for v in found]})

    dealt = spark.createDataFrame([(str(a), str(b), c) for a, b, c in intervals], "low string, high string, n int")
    rows = dealt.repartition(min(tasks, len(intervals))).mapInPandas(vectors, "root string, vector array<double>").collect()
    rows = sorted(rows, key=lambda r: (-int(r["root"]), r["vector"]))[:most]
    roots = [Fraction(int(r["root"]), 1 << bits) for r in rows]
    return (np.array([float(r * divisor / (n * n)) for r in roots]), np.array([float(r / trace) for r in roots]),
            np.array([r["vector"] for r in rows]))


def whiten(vectors: DataFrame, most: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, a row for each vector and component.

    `vectors` (vec_id, embedding): vectors that are null, or hold null or non-finite entries (or of 2**56 and more),
    are left out, and so are those of another length than most have. x = floor(64 * entry) + 1000000; S is the sum of
    the n vectors. deviation (decimal): sum over dimensions of (n * x - S)**2, exact. Components are numbered from 1
    by falling eigenvalue, `most` at most; those of eigenvalue 0 have no whitened form and are left out, so a table of
    equal vectors or of one gives no row, nor does an empty one. Within equal eigenvalues any basis serves. Repeated rows and
    repeated vec_ids count each time; other columns are not read. identity_error is measured on all the result: the
    largest entry, without sign, of the whitened covariance minus the identity.
    """
    found = finite_vectors(vectors)
    n, one, matrix = scatter(found)
    value, share, basis = components_of(found, n, matrix, most)
    k, sums = len(value), [int(x) for x in one]
    projection = (basis / np.sqrt(value)[:, None]).T if k else np.zeros((len(sums), 0))

    def whitened(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        largest = max([abs(int(y.max(initial=0))), abs(int(y.min(initial=0))), 1]) * n + max(map(abs, sums), default=0)
        narrow = largest**2 * max(1, len(sums)) < 2**63
        away = n * (y if narrow else y.astype(object)) - np.array(sums, np.int64 if narrow else object)
        return (away * away).sum(axis=1), (away.astype(np.float64) / n) @ projection

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for _, y in _blocks(batches):
            w = whitened(y)[1]
            total += np.vstack([w.T @ w, w.sum(axis=0)])
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.reshape(-1))], names=["cell", "value"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, y in _blocks(batches):
            deviation, w = whitened(y)
            exact = pa.array(deviation.tolist(), pa.int64()).cast(pa.decimal128(38, 0)) if deviation.dtype == np.int64 else pa.array(
                [Decimal(int(x)) for x in deviation], pa.decimal128(38, 0))
            cuts = pa.array(np.arange(len(w) + 1, dtype=np.int32) * k)
            yield pa.RecordBatch.from_arrays(
                [ids, exact, pa.ListArray.from_arrays(cuts, pa.array(w.reshape(-1)))], names=["vec_id", "deviation", "w"])

    error = 0.0
    if k:
        cells = found.mapInArrow(spread, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
        total = np.zeros(len(cells))
        total[[r["cell"] for r in cells]] = [r["value"] for r in cells]
        total = total.reshape(k + 1, k) / n
        error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
    shares = F.array(*(F.lit(float(x)) for x in share)) if k else F.expr("cast(array() AS array<double>)")
    out = found.mapInArrow(rows, "vec_id long, deviation decimal(38,0), w array<double>")
    out = out.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
