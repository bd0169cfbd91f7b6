"""Whitening against a dense eigendecomposition with exact integer statistics."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from contentkit.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def dense(vectors, k=16):
    """n, exact sums, covariance and its leading pairs, of the different grid vectors."""
    seen = sorted({tuple(math.floor(64 * float(c)) + 1_000_000 for c in v) for v in vectors})
    n, sums = len(seen), [sum(c) for c in zip(*seen)]
    y = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in seen])
    values, found = np.linalg.eigh(y.T @ y / n)
    return n, sums, values[::-1][:k], found[:, ::-1][:, :k], np.trace(y.T @ y / n)


def test_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    n, sums, values, found, trace = dense([r.embedding for r in rows])
    got = queries.QUERIES["op12_embedding_whitening"](spark, SF).collect()
    assert sorted((r.vec_id, r.component) for r in got) == sorted((r.vec_id, c) for r in rows for c in range(1, 17))
    vector = {r.vec_id: [math.floor(64 * float(c)) + 1_000_000 for c in r.embedding] for r in rows}
    sign = {}
    for r in got:
        x = vector[r.vec_id]
        want = sum(float(Fraction(n * c - s, n)) * f for c, s, f in zip(x, sums, found[:, r.component - 1])) / math.sqrt(values[r.component - 1])
        sign.setdefault(r.component, 1 if abs(want - r.whitened) <= abs(want + r.whitened) else -1)
        assert abs(sign[r.component] * want - r.whitened) < 1e-9
        assert r.n == n and r.deviation == sum((n * c - s) ** 2 for c, s in zip(x, sums))
        assert abs(r.explained - values[r.component - 1] / trace) < 1e-10 and r.identity_error < 1e-10


@pytest.mark.parametrize("size,count,kind", [(120, 8, "spread"), (300, 16, "flat"), (40, 16, "pairs"), (5, 16, "spread"), (200, 6, "low")])
def test_iteration(size, count, kind):
    rng = np.random.default_rng(size)
    values = {"spread": np.geomspace(1, 1e-6, size), "flat": np.linspace(2, 1, size), "pairs": np.repeat(np.geomspace(1, 0.01, size // 2), 2),
              "low": np.append(np.geomspace(1, 0.1, 4), np.zeros(196))}[kind]
    q = np.linalg.qr(rng.standard_normal((size, size)))[0]
    matrix = (q * values) @ q.T
    products = []

    def product(columns):
        products.append(columns.shape[1])
        return matrix @ columns

    got, vectors, residuals = whitening.jacobi_davidson(product, size, count)
    count = min(count, size)
    assert np.allclose(got, np.sort(values)[::-1][:count], rtol=0, atol=1e-13) and residuals.max() < 1e-13 * 2
    assert np.abs(vectors.T @ vectors - np.eye(count)).max() < 1e-12 and np.abs(matrix @ vectors - vectors * got).max() < 1e-13


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    matrix, shifts = (q * np.linspace(-1, 1, 30)) @ q.T, np.array([0.01, 0.5, -3.0])
    right = rng.standard_normal((30, 3))
    got = whitening.minres(lambda v: matrix @ v, shifts, right, lambda t: t, 60, 1e-12)
    assert np.abs(matrix @ got - got * shifts - right).max() < 1e-8


def make(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string, x string")


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    plain = [(k, [float(c) for c in rng.standard_normal(4)], "a", "b") for k in range(50)]
    odd = [(100, None, "a", "b"), (101, [], "a", "b"), (102, [1.0, None, 0.0, 0.0], "a", "b"), (103, [float("nan")] * 4, "a", "b"),
           (104, [float("inf"), 0.0, 0.0, 0.0], "a", "b"), (105, [1.0, 2.0], "a", "b")]
    same = plain[:5] + [(None, plain[6][1], None, None), (7, plain[9][1], "a", "b")]
    table = make(spark, plain + odd + same)
    model = whitening.fit(table)
    n, _, values, _, _ = dense([r[1] for r in plain])
    assert model.n == n == 50 and np.allclose(model.values, values, rtol=1e-12) and len(values) == 4
    got = whitening.transform(table, model)
    assert got.count() == len(plain) + len(same) and got.columns == ["vec_id", "x", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.component_report(table, model).count() == 4 * (len(plain) + len(same))


def test_few_or_equal_vectors(spark):
    for rows in ([], [(1, None, "", "")], [(k, [0.5, 0.25], "", "") for k in range(4)]):
        table = make(spark, rows)
        assert whitening.component_report(table, whitening.fit(table)).count() == 0
    line = make(spark, [(k, [k / 4, k / 2, 1.0], "", "") for k in range(9)])
    model = whitening.fit(line)
    assert model.values.shape == (1,) and abs(model.identity_error) < 1e-12
    huge = make(spark, [(k, [1e30 * (k % 3 - 1), float(k)], "", "") for k in range(9)])
    assert whitening.component_report(huge, whitening.fit(huge)).filter(F.isnan("whitened")).count() == 0


def test_deviation_is_exact():
    x = np.array([[5, -7], [1 << 50, 3]])
    sums = [int(c) for c in x.sum(0)]
    assert whitening._deviations(x[:1] * 0 + 1_000_003, 10**8, [10**14, 10**14 + 5])[0] == (3 * 10**8) ** 2 + (3 * 10**8 - 5) ** 2
    assert whitening._deviations(x, 2, sums) == [None, None]
