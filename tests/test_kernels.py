import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetide.kernels import (
    Ordering, auc, interval_anti, interval_join, islands, mad, nearest_asof, quantiles, scan,
    with_chunks,
)
from kinetide.kernels.islands import gap_exceeds
from kinetide.kernels.stats import average_rank

# Chunk settings from "everything in one chunk" to "dense instants split".
SETTINGS = [(10**9, None), (500, None), (2000, 20), (3000, 3), (5000, 1)]


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(1)
    n = 900
    pdf = pd.DataFrame(
        {
            "k": rng.choice([1, 1, 1, 2, 3], n),
            "ts": np.where(rng.random(n) < 0.3, 5000, rng.integers(0, 20000, n)),
            "o": rng.permutation(n),
            "v": np.where(rng.random(n) < 0.4, np.nan, rng.normal(size=n).round(3)),
        }
    )
    return pdf.sort_values("o").reset_index(drop=True)


def _frame(spark, pdf):
    df = spark.createDataFrame(pdf)
    return df.withColumn("v", F.when(~F.isnan("v"), F.col("v"))) if "v" in pdf else df


@pytest.mark.parametrize("width,rows", SETTINGS)
def test_scan_equals_whole_key_order(spark, samples, width, rows):
    df = with_chunks(_frame(spark, samples), ["k"], "ts", "o", width, rows).repartition(5)
    seq = Ordering(("k",), ("ts", "o"))
    got = scan(
        df, seq, prev={"p": ["o"]}, nxt={"n": ["o"]}, sums={"s": F.lit(1)},
        last={"l": F.col("v")}, upcoming={"u": F.col("v")}, totals={"t": F.lit(1)},
    ).select("k", "o", "p.o", F.col("n.o").alias("no"), "s", "l", "u", "t").toPandas()
    got.columns = ["k", "o", "po", "no", "s", "l", "u", "t"]
    ref = samples.sort_values(["k", "ts", "o"])
    g = ref.groupby("k")
    ref = ref.assign(
        po=g["o"].shift(1), no=g["o"].shift(-1), s=g.cumcount() + 1, l=g["v"].ffill(),
        u=g["v"].transform(lambda x: x.shift(-1).bfill()), t=g["o"].transform("size"),
    )
    cols = ["k", "o", "po", "no", "s", "l", "u", "t"]
    a = got.sort_values("o")[cols].astype(float).reset_index(drop=True)
    b = ref.sort_values("o")[cols].astype(float).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)


def test_look_ahead_is_no_frame_to_the_end(spark, samples):
    """Such a frame reads all later rows of a chunk anew for each row; one in the opposite order reads each once."""
    df = with_chunks(_frame(spark, samples), ["k"], "ts", "o", 10**9)
    out = scan(df, Ordering(("k",), ("ts", "o")), upcoming={"u": F.col("v")})
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert out.columns == [*df.columns, "u"] and out.count() == len(samples)


@pytest.mark.parametrize("width,rows", SETTINGS)
def test_islands(spark, samples, width, rows):
    df = with_chunks(_frame(spark, samples), ["k"], "ts", "o", width, rows)
    got = islands(df, Ordering(("k",), ("ts", "o")), ["ts"], gap_exceeds("ts", 60)).toPandas()
    ref = samples.sort_values(["k", "ts", "o"])
    ref["island"] = ref.groupby("k")["ts"].transform(lambda t: (t.diff() > 60).cumsum() + 1)
    a = got.sort_values("o")["island"].to_numpy()
    b = ref.sort_values("o")["island"].to_numpy()
    assert (a == b).all()


@pytest.mark.parametrize("width,rows", SETTINGS)
@pytest.mark.parametrize("tol", [None, 40])
def test_nearest_asof_matches_pandas(spark, samples, width, rows, tol):
    left = samples[samples.o % 3 != 0]
    right = samples[samples.o % 3 == 0]
    got = nearest_asof(
        spark.createDataFrame(left[["k", "ts", "o"]]), spark.createDataFrame(right[["k", "ts", "o"]]),
        ["k"], "ts", "o", [], width=width, tolerance=tol, max_rows=rows,
    ).toPandas().sort_values("o")
    ref = pd.merge_asof(
        left.sort_values(["ts", "o"])[["k", "ts", "o"]],
        right.sort_values(["ts", "o"])[["k", "ts", "o"]].rename(columns={"o": "r"}).assign(rt=lambda d: d.ts),
        on="ts", by="k", direction="nearest", tolerance=tol,
    ).sort_values("o")
    assert len(got) == len(ref)
    # pandas resolves ties between a backward and a forward hit to the backward one
    pd.testing.assert_series_equal(
        got["r_ts"].astype(float).reset_index(drop=True), ref["rt"].astype(float).reset_index(drop=True),
        check_names=False,
    )


def test_interval_join_half_open_and_overlap(spark):
    pts = spark.createDataFrame([(1, t) for t in range(0, 50, 5)], "k int, t long")
    blocks = spark.createDataFrame(
        [(1, 5, 20, "a"), (1, 15, 30, "b"), (1, 40, 40, "empty"), (2, 0, 50, "other")],
        "k int, start_ms long, end_ms long, task string",
    )
    got = {
        r.t: r.task
        for r in interval_join(pts, blocks, ["k"], "t", ["task"], width=7).collect()
    }
    assert got == {0: None, 5: "a", 10: "a", 15: "b", 20: "b", 25: "b", 30: None, 35: None, 40: None, 45: None}
    left = {r.t for r in interval_anti(pts, blocks, ["k"], "t", width=7).collect()}
    assert left == {0, 30, 35, 40, 45}


def test_quantiles_mad_auc_rank(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 600), "x": rng.normal(size=600).round(2), "y": rng.integers(0, 2, 600)})
    df = spark.createDataFrame(pdf)
    q = quantiles(df, ["k"], "x", {"a": 0.1, "m": 0.5, "z": 0.99}).toPandas().set_index("k").sort_index()
    ref = pdf.groupby("k")["x"].quantile([0.1, 0.5, 0.99]).unstack()
    np.testing.assert_allclose(q[["a", "m", "z"]].to_numpy(), ref.to_numpy(), atol=1e-12)
    m = mad(df, ["k"], "x").toPandas().set_index("k").sort_index()
    np.testing.assert_allclose(
        m["mad"], pdf.groupby("k")["x"].apply(lambda s: (s - s.median()).abs().median()), atol=1e-12
    )
    a = auc(df, [], "x", "y").collect()[0].auc
    p, n = pdf[pdf.y == 1].x.to_numpy(), pdf[pdf.y == 0].x.to_numpy()
    ref_auc = ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))
    assert abs(a - ref_auc) < 1e-12
    r = average_rank(df, ["k"], "x", "rk").toPandas()
    ref = pdf.assign(rk=pdf.groupby("k")["x"].rank()).drop_duplicates(["k", "x"])
    j = r.merge(ref, on=["k", "x"])
    assert len(j) == len(r) and np.allclose(j.rk_x, j.rk_y)
