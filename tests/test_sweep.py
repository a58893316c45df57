"""Counts by sweep against the pairs themselves."""

import random
import time

import pytest
from pyspark.sql import functions as F

from seqspark.operators import hybrid, intervals, sweep
from seqspark.plans import reports

COLUMNS = "seq_id long, class string, subtype string, start_pos int, end_pos int, length int, score double"


def _rows(seed, n=80, reach=400):
    rng, rows = random.Random(seed), []
    for seq in range(4):
        for _ in range(n):
            s, size = rng.randint(1, reach), rng.choice([1, 4, 9, 30, 80])
            rows.append((seq, rng.choice("ABCD"), rng.choice("st"), s, s + size - 1, size, float(rng.randint(1, 40))))
    return rows + rows[:25]  # repeated rows


@pytest.fixture(scope="module", params=[1, 2])
def motifs(spark, request):
    rows = _rows(request.param, *((80, 400) if request.param == 1 else (30, 900)))
    return rows, spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(params=[7, 1 << 16])
def tile(monkeypatch, request):
    """Tiles of seven bases put every sum across many tiles."""
    monkeypatch.setattr(sweep.running, "__defaults__", ((), (), request.param))


def test_cooccurrence_counts_all_pairs(motifs, tile):
    rows, df = motifs
    want = {}
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[1] != b[1] and a[3] <= b[4] and b[3] <= a[4]:
                want[a[1], b[1]] = want.get((a[1], b[1]), 0) + 1
    assert {(r["class"], r["other_class"]): r["n"] for r in reports.cooccurrence(df).collect()} == want


def test_proximity_counts_the_edges(motifs, tile):
    edges = reports.proximity_edges(motifs[1], 50).groupBy("class", "other_class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))
    got = sweep.proximity_by_class(motifs[1], 50)
    assert got.dtypes == edges.dtypes
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, edges.collect()))


def test_hybrids_are_the_regions_left_after_nesting(motifs, tile):
    want = hybrid.collapse_nested(hybrid.hybrid_regions(motifs[1]))
    got = hybrid.hybrids(motifs[1])
    assert got.dtypes == want.dtypes
    plain = lambda df: sorted(str(r.asDict(True)) for r in df.collect())
    assert plain(got) == plain(want)


def test_no_motifs(spark):
    none = spark.createDataFrame([], COLUMNS)
    assert reports.cooccurrence(none).count() == sweep.proximity_by_class(none).count() == hybrid.hybrids(none).count() == 0


def test_dense_spot_is_linear(spark):
    """10,000 motifs that all overlap: 75 million ordered pairs of different classes."""
    n = 10_000
    df = spark.range(n).select(
        F.lit(1).cast("long").alias("seq_id"), F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("id") % 4 + 1).cast("int")).alias("class"),
        F.lit("t").alias("subtype"), (F.col("id") + 1).cast("int").alias("start_pos"), (F.lit(2 * n) - F.col("id")).cast("int").alias("end_pos"),
        (F.lit(2 * n) - 2 * F.col("id")).cast("int").alias("length"), F.lit(1.0).alias("score"),
    )
    begin = time.time()
    assert reports.cooccurrence(df).agg(F.sum("n")).first()[0] == n * n - 4 * (n // 4) ** 2
    sweep.proximity_by_class(df).collect()
    found = hybrid.hybrids(df).select("start_pos", "end_pos", "n_motifs").collect()
    assert [tuple(r) for r in found] == [(2, 2 * n - 1, 2)]
    assert time.time() - begin < 30
