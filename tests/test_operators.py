"""Operators on small sensor fixtures, and the same result for every way of cutting sessions."""

import math
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetide.operators import align, clean, decode, evaluate as ev, features as ft, label as lab, quality as q, strokes as st
from kinetide.plans import focus, study

# (chunk width, rows per chunk): whole session, small chunks, dense instants split.
CUTS = [(10**9, None), (700, None), (5000, 5)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


WATCH = "session_id string, _ord long, ts long"


def test_label_join_tolerance(spark):
    w = frame(spark, [("A", i, i * 20) for i in range(15)], WATCH)
    p = frame(
        spark, [("A", 0, 100, "PEN_DOWN"), ("A", 1, 130, "PEN_MOVE"), ("A", 2, 160, "PEN_MOVE"), ("A", 3, 200, "PEN_UP")],
        WATCH + ", dot_type string",
    )
    got = {r.ts: r.label_writing for r in lab.label_samples(w, p).collect()}
    assert len(got) == 15
    assert all(got[t] == 0 for t in (0, 20, 40, 260, 280)) and all(got[t] == 1 for t in (100, 120, 140, 160))


def test_replays_and_collisions(spark):
    cols = "session_id string, _ord long, ts long, ax double"
    rows = [("A", i, i * 20, float(i)) for i in range(10)] + [("A", 20, 60, 3.0), ("A", 21, 80, 4.0), ("A", 22, 100, 77.0)]
    out = clean.drop_replays(frame(spark, rows, cols)).collect()
    assert len(out) == 11  # two replays gone, the collision with other axes stays
    assert max(r._ord for r in out if r.ts in (60, 80)) < 10


@pytest.mark.parametrize("width,rows", CUTS)
def test_closing_leaves_first_and_last_run(spark, width, rows):
    labels = [0, 0, 1, 1, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0]
    df = frame(spark, [("A", i, i * 1000, v) for i, v in enumerate(labels)], WATCH + ", label int")
    out = lab.close_labels(df, max_gap_ms=2500, width=width, max_rows=rows).orderBy("_ord").collect()
    assert [r.label_closed for r in out] == [0, 0, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 1, 0]


def test_pen_intervals_restart_and_orphans(spark):
    kinds = ["PEN_MOVE", "PEN_DOWN", "PEN_MOVE", "PEN_DOWN", "PEN_MOVE", "PEN_HOVER", "PEN_UP", "PEN_UP", "PEN_MOVE"]
    df = frame(spark, [("A", i, 1000 + i * 10, 5000 + i * 10, k) for i, k in enumerate(kinds)],
               "session_id string, _ord long, ts long, local_ts long, dot_type string")
    r = st.pen_intervals(df).collect()
    assert [(x.source_start_ms, x.source_end_ms, x.duration_ms, x.dot_count) for x in r] == [(1030, 1060, 30, 4)]


def test_task_timeline_rebuilds_missing_start(spark):
    rows = [
        ("A", 0, 1000, "task_start", 1, "t1", "writing"), ("A", 1, 9000, "task_end", 1, "t1", "writing"),
        ("A", 2, 30000, "task_end", 2, "t2", "idle"), ("A", 3, 40000, "task_start", 3, "t3", "writing"),
        ("B", 4, 500, "task_end", 1, "t1", "idle"),
    ]
    m = frame(spark, rows, "session_id string, _ord long, timestamp_ms long, event string, task_index int, task_id string, task_category string")
    got = {(r.session_id, r.task_index): (r.start_ms, r.end_ms) for r in st.task_timeline(m).collect()}
    assert got == {("A", 1): (1000, 9000), ("A", 2): (14000, 30000)}


def test_sequence_gaps_and_resets(spark):
    def run(seqs):
        df = frame(spark, [("A", i, i * 100, s) for i, s in enumerate(seqs)], "session_id string, _ord long, local_ts long, sequence long")
        g = q.gap_regions(df).agg(F.sum("missing")).collect()[0][0] or 0
        r = [x.resets for x in q.counter_resets(df).collect()]
        return g, (r or [0])[0]

    assert run([2, 3, 4, 5, 1, 6]) == (0, 0)  # late first batch: neither gap nor reset
    assert run([1, 2, 5, 6]) == (2, 0)
    assert run([1, 2, 3, 1, 2, 3]) == (0, 1)


@pytest.mark.parametrize("offset", [0, 3000])
def test_offset_search_finds_still_windows(spark, offset):
    rng = np.random.default_rng(0)
    t = np.arange(0, 60_000, 20)
    still = ((t >= 10_000) & (t < 12_000)) | ((t >= 25_000) & (t < 27_000)) | ((t >= 40_000) & (t < 42_000))
    a = rng.normal(0, 1, (len(t), 3)) * np.where(still, 0.02, 0.5)[:, None]
    w = pd.DataFrame({"session_id": "A", "_ord": range(len(t)), "ts": t, "ax": a[:, 0], "ay": a[:, 1], "az": a[:, 2] + 1})
    pen, o = [], 0
    for s in (10_000, 25_000, 40_000):
        ts = np.arange(s, s + 2000, 12) + offset
        kinds = ["PEN_DOWN"] + ["PEN_MOVE"] * (len(ts) - 2) + ["PEN_UP"]
        for x, k in zip(ts, kinds):
            pen.append(("A", o, int(x), k, 1.0, 1.0))
            o += 1
    p = frame(spark, pen, WATCH + ", dot_type string, x double, y double")
    r = align.offset_search(spark.createDataFrame(w), p).collect()[0]
    assert abs(r.delta_sec + offset / 1000) < 0.25 and r.sigma < -2 and r.applied


def test_windows_sixty_seconds(spark):
    t = np.arange(0, 60_000, 20)
    rng = np.random.default_rng(2)
    w = pd.DataFrame({"session_id": "A", "_ord": range(len(t)), "ts": t, "label_writing": (t // 5000 % 2).astype(int)})
    for c in ("ax", "ay", "az", "rx", "ry", "rz"):
        w[c] = rng.normal(size=len(t))
    out = ft.build_windows(spark.createDataFrame(w), fs_hz=50.0, max_gap_ms=0, rhythm=True, hard_negative=True, winners=True)
    pdf = out.toPandas().sort_values("k")
    assert len(pdf) == 119
    for names in (ft.BASE_FEATURES, ft.RHYTHM_FEATURES, ft.HARD_NEGATIVE_FEATURES, ft.WINNER_FEATURES):
        assert set(names) <= set(pdf.columns)
    assert len(ft.BASE_FEATURES) == 88 and len(ft.WINNER_FEATURES) == 42
    x = w["ax"].to_numpy()[25:75]
    r = pdf[pdf.k == 1].iloc[0]
    psd = np.abs(np.fft.rfft(x - x.mean()))[1:] ** 2
    assert math.isclose(r.ax_dom_freq, np.argmax(psd) + 1) and math.isclose(r.ax_std, x.std(), rel_tol=1e-9)
    assert math.isclose(r.ax_jerk_std, (np.diff(x) * 50).std(), rel_tol=1e-9)
    assert math.isclose(r.ax_q70, np.quantile(x, 0.7), rel_tol=1e-9)


def test_samples_of_overlapping_windows_travel_once(spark, monkeypatch):
    """Windows of 25 rows at every row: the rows of a window are made where it is aggregated."""
    rng = np.random.default_rng(8)
    w = pd.DataFrame({"session_id": np.repeat([1, 2, 3], (700, 30, 20)), "_ord": range(750), "ts": np.arange(750) * 40, "label_writing": rng.integers(0, 2, 750)})
    for c in ("ax", "ay", "az", "rx", "ry", "rz"):
        w[c] = rng.integers(0, 5, 750).astype(float)
    plans, tables = [], []
    for overlap in (ft.OVERLAP, 10**9):
        monkeypatch.setattr(ft, "OVERLAP", overlap)
        out = ft.build_windows(spark.createDataFrame(w), window_sec=1.0, stride_sec=0.04, fs_hz=25.0, max_gap_ms=0)
        plans.append(bool(re.search(r"hashpartitioning\(session_id#\d+L?, k#", out._jdf.queryExecution().executedPlan().toString())))
        tables.append(out.toPandas().sort_values(["session_id", "k"]).reset_index(drop=True))
    assert plans == [False, True] and len(tables[0]) == 676 + 6
    pd.testing.assert_frame_equal(tables[0], tables[1][tables[0].columns], rtol=1e-9)


def test_decimation_suppresses_alias(spark):
    t = np.arange(0, 5000, 10)
    w = pd.DataFrame({"session_id": "A", "_ord": range(len(t)), "ts": t, "ax": np.sin(2 * np.pi * 40 * t / 1000), "ay": np.sin(2 * np.pi * 5 * t / 1000)})
    out = ft.decimate(spark.createDataFrame(w), ft.decimation_factor(99.5, 50)).toPandas()
    assert len(out) == 250 and out.ax[20:-20].abs().max() < 0.1 and out.ay[20:-20].abs().max() > 0.9
    with pytest.raises(ValueError):
        ft.decimation_factor(73, 50)


@pytest.mark.parametrize("width,rows", CUTS)
@pytest.mark.parametrize("centred", [False, True])
def test_smoothing_matches_pandas(spark, width, rows, centred):
    rng = np.random.default_rng(4)
    pdf = pd.concat([
        pd.DataFrame({"session_id": s, "t_center_ms": np.arange(n) * step, "p": rng.random(n)}) for s, n, step in (("A", 700, 500), ("B", 90, 250))
    ], ignore_index=True)
    pdf["_ord"] = range(len(pdf))
    got = ev.smoothed(spark.createDataFrame(pdf), "p", (5.0,), centred=centred, width=width, max_rows=rows).toPandas().sort_values("_ord")
    ref = pd.concat([
        g.p.rolling(n, min_periods=1, center=centred).mean() for n, (_, g) in zip((10, 20), pdf.groupby("session_id"))
    ])
    np.testing.assert_allclose(got.smooth.to_numpy(), ref.to_numpy(), atol=1e-9)


@pytest.mark.parametrize("width,rows", CUTS)
def test_hmm_chunks_equal_plain_recursion(spark, width, rows):
    rng = np.random.default_rng(5)
    n = 60
    pdf = pd.DataFrame({"session_id": 1, "t_center_ms": np.arange(n) * 100, "_ord": range(n), "p": rng.random(n)})
    A, pi = np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([0.6, 0.4])
    for name, v in zip(decode.PARAMS, [*A.ravel(), *pi]):
        pdf[name] = v
    got = decode.decode(spark.createDataFrame(pdf), "p", width=width, max_rows=rows).toPandas().sort_values("_ord")
    c = pdf.p.clip(1e-3, 1 - 1e-3).to_numpy()
    b = np.stack([(1 - c) / pi[0], c / pi[1]], 1)
    al = np.empty((n, 2)); x = pi * b[0]; al[0] = x / x.sum()
    for t in range(1, n):
        x = (A.T @ al[t - 1]) * b[t]; al[t] = x / x.sum()
    be = np.ones((n, 2))
    for t in range(n - 2, -1, -1):
        y = A @ (b[t + 1] * be[t + 1]); be[t] = y / y.sum()
    g = al * be
    np.testing.assert_allclose(got.filtered, al[:, 1], atol=1e-9)
    np.testing.assert_allclose(got.smoothed, (g / g.sum(1, keepdims=True))[:, 1], atol=1e-9)
    d = np.log(pi) + np.log(b[0]); back = []
    for t in range(1, n):
        s = d[:, None] + np.log(A); back.append(s.argmax(0)); d = s.max(0) + np.log(b[t])
    path = [int(d.argmax())]
    for k in reversed(back):
        path.append(int(k[path[-1]]))
    assert got.viterbi.tolist() == path[::-1]


def test_transitions_do_not_cross_sessions(spark):
    rows = [("A", 0, 0, "p", 1), ("A", 1, 1, "p", 1), ("B", 2, 2, "p", 0), ("B", 3, 3, "p", 0)]
    df = frame(spark, rows, "session_id string, _ord long, t_center_ms long, person_id string, label int")
    r = decode.transition_counts(df, ["person_id"]).collect()[0]
    assert (r.c00, r.c01, r.c10, r.c11) == (1, 0, 0, 1)


def test_focus_stretch_rules(spark):
    base = 1_700_000_000_000
    ticks = [(i, 1) for i in range(60)] + [(i, 0) for i in range(60, 70)] + [(i, 1) for i in range(70, 100)] + [(200, 1)]
    df = frame(spark, [("u", n, base + t * 1000, float(w), w) for n, (t, w) in enumerate(ticks)], "session_id string, _ord long, ts long, proba double, writing int")
    from kinetide.kernels import with_chunks

    for width in (10**12, 7000):
        log = with_chunks(df, ["session_id"], "ts", "_ord", width)
        runs = sorted((r.start_ms - base, r.end_ms - base) for r in focus.stretches(log).collect())
        assert runs == [(0, 59000), (70000, 99000)]


def test_goal_streaks(spark):
    days = [("u", f"2024-01-{d:02d}", s) for d, s in ((1, 99.0), (2, 99.0), (3, 99.0), (4, 0.0), (5, 99.0), (6, 99.0), (7, 0.0))]
    df = frame(spark, days, "session_id string, date string, writing_seconds double")
    r = focus.goal_streaks(df, 60, "2024-01-07").collect()[0]
    assert (r.current_streak, r.longest_streak) == (2, 3)


@pytest.mark.parametrize("n", [4, 5])
def test_latin_square_is_balanced(spark, n):
    rows = study.counterbalance(frame(spark, [(n,)], "n int")).toPandas()
    table = rows.pivot(index="row", columns="position", values="item").to_numpy()
    assert table.shape == (n if n % 2 == 0 else 2 * n, n)
    assert all(sorted(r) == list(range(n)) for r in table.tolist())
    pairs = pd.Series([(a, b) for r in table.tolist() for a, b in zip(r, r[1:])]).value_counts()
    assert pairs.nunique() == 1 and len(pairs) == n * (n - 1)


def test_wilcoxon_exact_and_ties(spark):
    a = [0.9, 0.8, 0.85, 0.7, 0.95, 0.6]
    b = [0.8, 0.75, 0.87, 0.5, 0.65, 0.55 - 0.01]
    df = frame(spark, list(zip(range(6), a, b)), "held_out int, x double, y double")
    r = ev.wilcoxon(df, "x", "y").collect()[0]
    assert r.n == 6 and r.statistic == 1.0 and math.isclose(r.p_value, 4 / 64, rel_tol=1e-9) and not r.significant
    same = ev.wilcoxon(df, "x", "x").collect()[0]
    assert same.p_value == 1.0 and not same.significant


def test_hot_session_is_split(spark):
    """A session holding most rows is spread over chunks of bounded size."""
    from kinetide.kernels import with_chunks

    rows = [("hot", i, 5 if i % 3 else i, ) for i in range(3000)] + [("cold", i, i) for i in range(100)]
    df = with_chunks(frame(spark, rows, WATCH), ["session_id"], "ts", "_ord", 10_000, 20)
    sizes = {r[0]: r[1] for r in df.groupBy("session_id", "_chunk").count().groupBy("session_id").max("count").collect()}
    assert sizes["hot"] <= 20  # a dense bucket: instants and ordinal blocks
    assert sizes["cold"] <= 64 * 20  # the documented bound below that
