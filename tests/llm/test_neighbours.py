"""Graph search and merged results against all inner products."""

import numpy as np
import pytest

from seqspark.llm import neighbours as N
from seqspark.llm.hnsw import Graph
from seqspark.llm.runs import mixed


def brute(rows, k=20):
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % 20 == 0:
            near = sorted((-float(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))
            out[q] = [(i, -s) for s, i in near[:k]]
    return out


@pytest.mark.parametrize("n,d,norms", [(3000, 32, False), (2000, 16, True), (1, 4, False), (7, 3, True)])
def test_graph_recall(n, d, norms):
    rng = np.random.default_rng(n)
    x = (rng.normal(size=(40, d))[rng.integers(0, 40, n)] + 0.4 * rng.normal(size=(n, d))).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms:
        x *= rng.uniform(0.5, 2, size=(n, 1)).astype(np.float32)
    graph = Graph(x, mixed(np.arange(n, dtype=np.uint64)))
    queries, k = x[:100], min(20, n)
    found = graph.search(queries, 20, 96)
    truth = np.argsort(-(queries @ x.T), axis=1)[:, :k]
    hits = sum(len(set(a.tolist()) & set(b.tolist())) for a, b in zip(found, truth))
    assert hits >= 0.95 * truth.size
    assert all(layer.dtype == np.int32 and (layer < n).all() for layer in graph.layers)


def check(rows, found, recall):
    truth = brute(rows)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == {q for q, near in truth.items() if near}
    hits = total = 0
    vectors = {i: v for i, v in rows if i is not None and v}
    for q, near in truth.items():
        own = got.get(q, [])
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and len(own) == len(near)
        assert q not in [r["vec_id"] for r in own]
        keys = [(-r["score"], r["vec_id"]) for r in own]
        assert keys == sorted(keys)
        for r in own:
            assert r["score"] == pytest.approx(float(np.array(vectors[q], np.float32).astype(float) @ np.array(vectors[r["vec_id"]], np.float32).astype(float)), abs=1e-12)
        hits += len({r["vec_id"] for r in own} & {i for i, _ in near})
        total += len(near)
    assert hits >= recall * total


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 8))
    rows = [(i, [float(v) for v in x[i]]) for i in range(700)]
    rows += [(1000 + i, rows[0][1]) for i in range(90)] + [(1200 + i, rows[7][1]) for i in range(45)]
    rows += [(2000, None), (2020, []), (2040, [0.0] * 8), (2060, [1.0, None] * 4), (2080, [float("nan")] * 8), (2100, [float("inf")] * 8), (None, rows[1][1]), (2120, [1.0, 2.0]), (2121, [2.0, 1.0]), (2140, [3.0] * 5)]
    table = spark.createDataFrame([(*r, 0, 1.5) for r in rows], "vec_id long, embedding array<float>, label int, score double")
    out = N.nearest(table.unionAll(table.limit(3)), least_shards=3, ef=200)
    check(rows, out.collect(), 0.98)
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    assert N.nearest(table.limit(0)).count() == 0


def test_recall_on_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    check(rows, N.nearest(table).collect(), 0.95)


def test_repeated_ids_and_doubles(spark):
    """The smallest vector of an id counts; doubles keep all digits."""
    rows = [(0, [1.0, 0.1]), (1, [2.0, 1 / 3]), (1, [9.0, 9.0]), (1, [2.0, 1 / 3]), (2, [-1.0, 1e-9]), (20, [9.0, 0.0]), (20, [-3.0, 1.0])]
    for part in (rows, rows[::-1]):
        table = spark.createDataFrame([(*r, "clash") for r in part], "vec_id long, embedding array<double>, rank string")
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in N.nearest(table, least_shards=2).collect()}
        assert got == {
            (0, 1): (1, 2.0 + 0.1 * (1 / 3)), (0, 2): (2, -1.0 + 0.1 * 1e-9), (0, 3): (20, -3.0 + 0.1),
            (20, 1): (2, 3.0 + 1e-9), (20, 2): (0, -3.0 + 0.1), (20, 3): (1, -6.0 + 1 / 3)}


def test_lists_grow_with_shards(spark):
    """Vectors without any structure, where lists of 96 find too little."""
    n, d = 6000, 48
    x = np.random.default_rng(4).normal(size=(n, d)).astype(np.float32)
    table = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "vec_id long, embedding array<float>")
    found = {}
    for r in N.nearest(table, queries="vec_id % 60 = 0", least_shards=1, rows_per_ef=20).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    y = x.astype(np.float64)
    hits = sum(len(near & set([int(i) for i in np.argsort(-(y @ y[q]), kind="stable") if i != q][:20])) for q, near in found.items())
    assert len(found) == 100 and hits >= 0.9 * 2000
