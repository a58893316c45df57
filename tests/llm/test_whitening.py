"""The exact spectrum against determinants and floating-point solvers, and whitening against plain numpy."""

from fractions import Fraction

import numpy as np
import pytest

from seqspark.llm import exact_spectrum as spectrum
from seqspark.llm import whitening


def gram(rng, n, d, scale=9):
    x = rng.integers(-scale, scale, (n, d)).astype(object)
    return x.T.dot(x)


def polynomial(matrix):
    found = {p: spectrum.residues(matrix, p).tolist() for p in spectrum.primes_for(matrix)}
    return spectrum.combined(found)


def determinant(matrix):
    a, out = [[Fraction(int(x)) for x in row] for row in matrix], Fraction(1)
    for k in range(len(a)):
        p = next((i for i in range(k, len(a)) if a[i][k]), None)
        if p is None:
            return 0
        if p != k:
            a[k], a[p], out = a[p], a[k], -out
        out *= a[k][k]
        for i in range(k + 1, len(a)):
            f = a[i][k] / a[k][k]
            a[i] = [x - f * y for x, y in zip(a[i], a[k])]
    return out


@pytest.mark.parametrize("d,n", [(1, 3), (2, 5), (7, 20), (7, 4), (12, 12)])
def test_polynomial_by_determinants(d, n):
    matrix = gram(np.random.default_rng(d * n), n, d, 10**6)
    poly = polynomial(matrix)
    assert poly[-1] == 1 and len(poly) == d + 1
    for x in (-3, 0, 1, 10, 12345678901):
        assert sum(c * x**i for i, c in enumerate(poly)) == determinant(np.eye(d, dtype=int).astype(object) * x - matrix)


def test_polynomial_of_sparse_and_equal():
    for matrix in (np.diag([3, 3, 0, 5]), np.ones((5, 5), int), np.diag([2] * 4)):
        matrix = matrix.astype(object)
        poly = polynomial(matrix)
        assert [sum(c * x**i for i, c in enumerate(poly)) for x in (1, 7)] == [determinant(np.eye(len(matrix), dtype=int).astype(object) * x - matrix) for x in (1, 7)]


def test_roots_and_counts():
    roots = [1, 5, 5, 9, 1000]
    poly = [1]
    for r in roots:
        poly = [a - r * b for a, b in zip([0, *poly], [*poly, 0])]
    for at in (0, 1, 4, 5, 9, 999, 1000):
        assert spectrum.roots_above(poly, at) == sum(r > at for r in roots)
    found = spectrum.isolated(spectrum.stretched(poly, 20), 2000 << 20, 4)
    assert [x[2] for x in found] == [1, 1, 2]
    assert [round(spectrum.refined(spectrum.stretched(poly, 20), *x) / 2**20) for x in found] == [1000, 9, 5]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n int, whitened string")


def plain(rows, most):
    good = [(i, [float(c) for c in e]) for i, e in rows if e is not None and all(c is not None and np.isfinite(c) for c in e)]
    x = np.floor(64 * np.array([e for _, e in good])) + 1000000
    xi = x.astype(np.int64)
    n, s = len(x), xi.sum(axis=0)
    deviation = [sum(int(v)**2 for v in n * row - s) for row in xi]
    c = x - s / n
    value, vector = np.linalg.eigh(c.T @ c / n)
    order = np.argsort(-value)[:most]
    return [i for i, _ in good], deviation, c @ vector[:, order] / np.sqrt(value[order]), value[order] / value.sum()


def test_against_numpy(spark):
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(300, 40)) * np.linspace(0.05, 0.5, 40)).astype(np.float32)
    rows = [(i, e.tolist()) for i, e in enumerate(data)]
    rows += [(300, None), (301, [None] + [0.1] * 39), (302, [float("nan")] * 40), (303, [float("inf")] + [0.0] * 39), (304, []), (305, [0.5]), (4, data[4].tolist())]
    got = whitening.whiten(frame(spark, [(i, e, 1, "x") for i, e in rows]).repartition(3)).toPandas()
    ids, deviation, whitened, share = plain([(i, e) for i, e in rows if e is None or len(e) == 40], 32)
    assert sorted(got.columns) == sorted(["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    assert len(got) == 32 * len(ids) and set(got.n) == {len(ids)}
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10
    table = got[got.vec_id != 4].pivot(index="vec_id", columns="component", values="whitened")
    expected = {i: w for i, w in zip(ids, whitened)}
    expected = np.array([expected[i] for i in table.index])
    signs = np.sign((table.to_numpy() * expected).sum(axis=0))
    assert np.allclose(table.to_numpy() * signs, expected, atol=1e-8)
    assert np.allclose(got.groupby("component").explained.first(), share, rtol=1e-10)
    assert {(i, int(x)) for i, x in zip(got.vec_id, got.deviation)} == set(zip(ids, deviation))


def test_low_rank_and_equal_eigenvalues(spark):
    # Two dimensions that always agree, one that never changes, and three of equal spread: rank four.
    rows = []
    for i in range(64):
        a, b, c, d = (1.0 if i >> k & 1 else -1.0 for k in range(4))
        rows.append((i, [2.0 * a, 2.0 * a, 7.0, b, c, d], 1, "x"))
    got = whitening.whiten(frame(spark, rows)).toPandas()
    assert sorted(set(got.component)) == [1, 2, 3, 4]
    w = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(w.T @ w / 64, np.eye(4), atol=1e-12)
    assert got.identity_error.iloc[0] < 1e-12
    assert np.allclose(got.groupby("component").explained.first(), [8 / 11, 1 / 11, 1 / 11, 1 / 11])


def test_close_eigenvalues():
    # Two eigenvalues that differ by 1e-13 of the trace: vectors are still right to double precision.
    m = np.array([[10**13, 0, 0], [0, 10**13 + 1, 1], [0, 1, 10**13 + 3]], object)
    poly = spectrum.stretched(polynomial(m), 100)
    found = spectrum.isolated(poly, 4 * 10**13 << 100, 3)
    assert [x[2] for x in found] == [1, 1, 1]
    small = np.linalg.eigh(np.array([[1.0, 1], [1, 3]]))[1]
    vectors = [spectrum.null_vectors(m, spectrum.refined(poly, *x), 100, 1)[0] for x in found]
    for v, w in zip(vectors, ([0, *small[:, 1]], [0, *small[:, 0]], [1, 0, 0])):
        assert np.allclose(np.abs(v), np.abs(w), atol=1e-15)


def test_small_tables(spark):
    for rows in ([], [(1, None, 1, "x")], [(1, [0.5, 1.5], 1, "x")], [(1, [0.5], 1, "x")] * 5, [(1, [], 1, "x")]):
        assert whitening.whiten(frame(spark, rows)).count() == 0


def test_large_entries(spark):
    rows = [(i, [v, -v / 3], 1, "x") for i, v in enumerate([1e15, -3e14, 5.0, 2.0**55])] + [(9, [1e30, 0.0], 1, "x")]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int, whitened string")).toPandas()
    y = [[int(np.floor(64 * c)) for c in r[1]] for r in rows[:4]]
    s = [sum(c) for c in zip(*y)]
    exact = {i: sum((4 * c - t)**2 for c, t in zip(row, s)) for i, row in enumerate(y)}
    if max(exact.values()) < 10**38:
        assert {i: int(x) for i, x in zip(got.vec_id, got.deviation)} == exact
    assert set(got.vec_id) == {0, 1, 2, 3}
