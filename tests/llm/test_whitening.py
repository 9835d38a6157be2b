"""Spectral divide and conquer against numpy, whitened rows against exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetide.llm import queries
from kinetide.llm.whitening import polar, spectrum, whitened


def matrices():
    r = np.random.default_rng(1)
    q, _ = np.linalg.qr(r.normal(size=(16, 16)))
    a, b = r.normal(size=(70, 64)), r.normal(size=(5, 20))
    yield from [np.zeros((0, 0)), np.array([[3.0]]), np.zeros((4, 4)), np.eye(6), np.ones((8, 8)), a.T @ a, b.T @ b, np.diag([1.0, 5, 3])]
    for values in ([5.0] * 6 + [1.0] * 10, 10.0 ** -np.arange(16), 1 + 1e-15 * np.arange(16), 1 + 1e-9 * np.arange(16), [0.0] * 8 + [2.0] * 8, np.arange(-8.0, 8)):
        yield q @ np.diag(values) @ q.T


@pytest.mark.parametrize("v", list(matrices()), ids=str)
def test_spectrum(v):
    values, vectors = spectrum(v)
    size = max(np.linalg.norm(v), 1e-300) if v.size else 1
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1], rtol=0, atol=1e-14 * size)
    assert np.allclose(vectors.T @ vectors, np.eye(len(v)), rtol=0, atol=1e-14)
    assert np.allclose(v @ vectors, vectors * values, rtol=0, atol=2e-14 * size)


def test_polar_factor():
    a = np.random.default_rng(2).normal(size=(30, 30))
    a = a + a.T
    e, w = np.linalg.eigh(a)
    assert np.allclose(polar(a), w * np.sign(e) @ w.T, atol=1e-12)


def check(rows, got, components):
    """Rows of ``whitened`` against exact sums and numpy's eigenvectors (up to sign)."""
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v in rows}
    n, sums = len(x), [sum(c) for c in zip(*x.values(), strict=True)]
    deviation = {i: sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for i, v in x.items()}
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums, strict=True)] for v in x.values()])
    cov = centred.T @ centred / n
    e, w = np.linalg.eigh(cov)
    e, w = e[::-1], w[:, ::-1]
    want = centred @ w / np.sqrt(e)
    table = {(r.vec_id, r.component): r for r in got}
    assert len(table) == len(got) == n * min(components, len(e))
    for k in range(min(components, len(e))):
        mine = np.array([table[i, k + 1].whitened for i in x])
        assert min(np.abs(mine - want[:, k]).max(), np.abs(mine + want[:, k]).max()) < 1e-7
    for (i, k), r in table.items():
        assert r.n == n and r.deviation == deviation[i] and abs(r.explained / (e[k - 1] / np.trace(cov)) - 1) < 1e-8
        assert 0 <= r.identity_error < 1e-8
    assert len({r.identity_error for r in got}) == 1


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(rows, queries.QUERIES["op12_whitening"](spark, sf).collect(), 32)


def test_unusable_rows_and_clashing_columns(spark):
    r = np.random.default_rng(3)
    good = [(i, [float(c) for c in r.normal(size=6).astype(np.float32)]) for i in range(40)]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0, 5.0]), (103, [float("nan")] * 6), (104, [1.0, 2.0, 3.0, 4.0, 5.0, float("inf")]), (105, [1.0, 2.0])]
    df = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumn("x", F.lit("mine")).withColumn("place", F.lit(1)).repartition(3)
    check(good, whitened(df).collect(), 32)
    check(good, whitened(df, components=2).collect(), 2)


def test_degenerate_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitened(spark.createDataFrame([], schema)).count() == 0
    alone = whitened(spark.createDataFrame([(1, [1.0, 2.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.identity_error) for r in alone] == [(1, 1, 0, None, None), (2, 1, 0, None, None)]
    # A constant dimension and repeated rows: one component has variance.
    flat = whitened(spark.createDataFrame([(None, [1.0, 5.0]), (None, [1.0, 5.0]), (2, [3.0, 5.0])], schema)).collect()
    assert len(flat) == 6 and all((r.whitened is None) == (r.component == 2) for r in flat)
    assert {r.identity_error for r in flat}.pop() < 1e-9
    huge = whitened(spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 0.5])], schema)).collect()
    assert len(huge) == 4
