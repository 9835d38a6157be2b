"""Both searches against brute force."""

import math

import numpy as np
import pytest

from kinetide.llm import impact, multi_index


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 16))
    rows = [(i, [float(x) for x in np.float32(centres[i % 8] + 0.4 * rng.normal(size=16))]) for i in range(600)]
    rows += [(1000 + i, rows[5][1]) for i in range(300)]  # a third is one vector
    rows += [(2000, None), (2050, [0.0] * 16), (2100, [float("nan")] * 16), (2150, [float("inf")] + [1.0] * 15), (2200, [None] + [1.0] * 15), (None, rows[0][1]), (2300, [1.0])]
    rows += [(2050, rows[7][1])]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)


def usable(rows):
    return [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v is not None and len(v) == 16 and all(x is not None and math.isfinite(x) for x in v)]


def test_all_cells_give_exact_neighbours_and_few_give_most(spark, vectors):
    rows, df = vectors
    queries = df.where("vec_id % 50 = 0")
    good = [(i, v) for i, v in usable(rows) if np.any(v)]
    want = {}
    for q, v in good:
        if q % 50 == 0:
            scores = [(-(float((w * v).sum() / (np.sqrt((w * w).sum()) * np.sqrt((v * v).sum())))), i) for i, w in good if i != q]
            want[q] = [(i, s) for s, i in sorted(scores)[:5]]
    got = multi_index.search(df, queries, share=1.0, centroids=4).collect()
    mine = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        mine.setdefault(r.query_id, []).append((r.vec_id, -r.score))
    assert mine.keys() == want.keys()
    for q in want:
        assert [i for i, _ in mine[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in mine[q]], [s for _, s in want[q]], rtol=1e-12)
    few = multi_index.search(df, queries, wanted=60, share=0.1, centroids=4).collect()
    right = sum(r.vec_id in {i for i, _ in want[r.query_id]} for r in few)
    assert right >= 0.9 * sum(map(len, want.values()))


def brute_products(rows, k, mod):
    whole = [(i, np.floor(64 * v).astype(np.int64)) for i, v in usable(rows)]
    return {(q, j, i, s) for q, v in whole if q % mod == 0 for j, (s, i) in enumerate(sorted(((-int(w @ v), i) for i, w in whole if i != q))[:k], 1) for s in [-s]}


def test_exact_products(spark, vectors, monkeypatch):
    rows, df = vectors
    monkeypatch.setattr(impact, "SHARD", 250)
    monkeypatch.setattr(impact, "QUERIES", 7)
    got = impact.search(df, df.where("vec_id % 20 = 0"), k=20).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute_products(rows, 20, 20)


def test_large_components_stay_exact():
    rng = np.random.default_rng(1)
    values = rng.integers(-(10**7), 10**7, size=(300, 8))
    ids = np.arange(300)
    got = impact.top(ids, values, ids[:5], values[:5], 4)
    for q in range(5):
        best = sorted((-int(values[i] @ values[q]), i) for i in range(300) if i != q)[:4]
        assert sorted((-s, i) for a, i, s in got if a == q) == best


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert multi_index.search(df, df).count() == 2 and impact.search(df, df).count() == 2
    none = df.where("false")
    assert multi_index.search(none, none).count() == 0 and impact.search(none, none).count() == 0
