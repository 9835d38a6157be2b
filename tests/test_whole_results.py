"""Nothing is lost on the way: NULL keys, missing features, overlaps, shared folders."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetide import session
from kinetide.kernels import attach, auc, interval_anti, interval_join, islands, scan, with_chunks
from kinetide.kernels.islands import gap_exceeds
from kinetide.kernels.order import Ordering
from kinetide.models import panel
from kinetide.operators import evaluate as ev
from kinetide.operators import align, quality


def test_null_keys_stay(spark):
    rows = [(k, i, i * 10) for k in (1, None) for i in range(30)]
    df = spark.createDataFrame(rows, "k int, _ord long, ts long")
    seq = Ordering(("k",), ("ts", "_ord"))
    chunked = with_chunks(df, ["k"], "ts", "_ord", 50)
    out = scan(chunked, seq, sums={"n": F.lit(1)}, prev={"p": ["ts"]}).collect()
    assert len(out) == 60 and max(r.n for r in out if r.k == 1) == 30
    runs = islands(chunked, seq, ["ts"], gap_exceeds("ts", 100)).collect()
    assert len(runs) == 60 and all(r.island is not None for r in runs)
    dim = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    assert attach(df, dim, ["k"]).groupBy("v").count().collect().__len__() == 2


def test_points_are_never_repeated_or_merged(spark):
    points = spark.createDataFrame([(1, 5), (1, 5), (1, 7), (1, 99), (None, 5)], "k int, t long")
    blocks = spark.createDataFrame([(1, 0, 10, "long"), (1, 4, 8, "late"), (1, 4, 8, "late"), (1, 9, 9, "none")], "k int, start_ms long, end_ms long, name string")
    got = interval_join(points, blocks, ["k"], "t", ["name"], width=3).collect()
    assert sorted((r.t, r.name or "") for r in got) == [(5, ""), (5, "late"), (5, "late"), (7, "late"), (99, "")]
    assert interval_join(points, blocks, ["k"], "t", ["name"], width=3, how="inner").count() == 3
    assert sorted(r.t for r in interval_anti(points, blocks, ["k"], "t", width=3).collect()) == [5, 99]


@pytest.fixture(scope="module")
def windows(spark):
    rows = []
    for i in range(240):
        label = (i // 8) % 2
        rows.append((i, i % 8, i % 4, label, "t", label * 2.0 + (i % 5) * 0.1, None if i % 8 == 3 else float(i % 3), float("nan") if i == 7 else 1.0 * (i % 7)))
    return spark.createDataFrame(rows, "_ord long, session_id int, person_id int, label int, task_id string, a double, tilt double, b double")


@pytest.mark.parametrize("model", ["logreg", "dummy"])
def test_rows_in_are_rows_out(spark, windows, model):
    out = panel.leave_group_out(windows, ["a", "tilt", "b"], model=model, calibrate=True, hard_tasks=["t"])
    assert out.count() == windows.count() and out.where("proba_raw is null or proba_cal is null or isnan(proba_raw)").count() == 0
    assert {r.held_out for r in out.select("held_out").distinct().collect()} == {0, 1, 2, 3}


def test_folds_without_both_classes_give_an_empty_table(spark, windows):
    out = panel.leave_group_out(windows.withColumn("label", F.lit(1)), ["a"], model="logreg")
    assert out.count() == 0 and {"proba_raw", "held_out"} <= set(out.columns)


def test_no_limit_on_groups(spark):
    assert len(panel.fold_keys(spark.range(1500), "id")) == 1500


def test_stored_model_is_described(spark, windows, tmp_path):
    path = str(tmp_path / "m")
    panel.train_final(windows, ["a", "tilt"], path, "logreg", fs_hz=25.0, threshold=0.4)
    about = panel.described(spark, path).first()
    assert (about.features, about.fs_hz, about.threshold, about.n_windows, about.n_sessions) == (["a", "tilt"], 25.0, 0.4, 240, 8)
    scored = panel.score_table(spark, windows, ["a", "tilt"], path)
    assert scored.count() == 240 and scored.where("writing != cast(proba >= 0.4 as int)").count() == 0


def test_pooled_deviation_with_large_means(spark):
    rows = [(p, 1e9 + 0.001 * ((p * 7 + i * 3) % 11)) for p in range(4) for i in range(50)]
    df = spark.createDataFrame(rows, "person_id int, x double")
    got = {r.person_id: r for r in ev.pooled_stats_by_fold(df, ["x"]).collect()}
    for p in range(4):
        rest = [x - 1e9 for q, x in rows if q != p]
        mean = sum(rest) / len(rest)
        sd = (sum((x - mean) ** 2 for x in rest) / (len(rest) - 1)) ** 0.5
        assert got[p]["_s_x"] == pytest.approx(sd, rel=1e-3)


def test_rank_test_methods(spark):
    pairs = spark.createDataFrame([(i, float(i), float(i) - 0.5 - 0.01 * i if i % 3 else float(i) + 0.3 + 0.001 * i) for i in range(1, 13)], "f int, a double, b double")
    p = {m: ev.wilcoxon(pairs, "a", "b", method=m).first().p_value for m in ("auto", "exact", "approx")}
    assert p["auto"] == p["exact"] != p["approx"] and abs(p["exact"] - p["approx"]) < 0.05


class _Cluster:
    master, applicationId = "spark://host:7077", "x"


class _Session:
    sparkContext = _Cluster()

    class conf:
        get = staticmethod(lambda key, default=None: default)


def test_a_cluster_needs_a_shared_folder(spark):
    with pytest.raises(RuntimeError):
        session.shared_dir(_Session())


def test_staged_tables_go_on_release(spark, tmp_path):
    import os

    table = session.staged(spark.range(3), "gone")
    path = table.inputFiles()[0].removeprefix("file:").replace("///", "/")
    assert os.path.exists(path) and session.release(spark) >= 1 and not os.path.exists(path)


def test_models_share_one_prepared_table(spark, monkeypatch):
    """Windows are scaled and dealt to folds once, and a fit's passes don't count the classes again."""
    rows = [(i % 4, i % 4, i, i % 2 if i % 50 else None, float((i * 7) % 11 + 3 * (i % 2)), float(i % 5)) for i in range(240)]
    w = spark.createDataFrame(rows, "session_id long, person_id long, _ord long, label int, a double, b double")
    data = panel.folded(w.filter("label is not null"), ["a", "b"], k=2)
    want = panel.fold_metrics(panel.leave_group_out(w.filter("label is not null"), ["a", "b"], model="logreg", k=2)).collect()
    with monkeypatch.context() as m:
        m.setattr(ev, "zscore_per_session", None)
        got = panel.fold_metrics(panel.leave_group_out(w, ["a", "b"], model="logreg", k=2, data=data)).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 2
    weighted = panel.balanced_weights(w)
    plan = weighted._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and weighted.columns[0] == "label"
    n = {label: sum(r[3] == label for r in rows) for label in (0, 1)}
    assert {(r.label, r.weight) for r in weighted.collect()} == {(label, 240 / (2.0 * count)) for label, count in n.items()}
    assert panel.balanced_weights(w.limit(0)).count() == 0


def test_fourier_features_are_cosines_of_random_directions(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = np.random.default_rng(2).normal(size=(40, 3))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, x array<double>").select("i", array_to_vector("x").alias("_plain"))
    out = panel.RandomFourier(width=3).transform(df).select("i", vector_to_array("features").alias("f")).orderBy("i").collect()
    rng = np.random.default_rng(panel.SEED)
    turn, shift = rng.normal(size=(3, panel.DIRECTIONS)) * np.sqrt(2.0 / 3), rng.uniform(0, 2 * np.pi, panel.DIRECTIONS)
    assert np.allclose(np.array([r.f for r in out]), np.sqrt(2.0 / panel.DIRECTIONS) * np.cos(x @ turn + shift), rtol=0, atol=1e-12)


def test_staged_tables_leave_no_shuffle_files(spark):
    import time

    files = lambda: set(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n"))
    before, kept = files(), spark.conf.get(session.CLEANUP)
    table = session.staged(spark.range(1000).groupBy(F.expr("id % 7").alias("k")).count(), "shuffled")
    until = time.time() + 20
    while (left := {f for f in files() - before if "shuffle_" in f}) and time.time() < until:
        time.sleep(0.1)
    assert not left and spark.conf.get(session.CLEANUP) == kept and table.count() == 7


def test_a_table_that_is_no_longer_read_is_discarded(spark):
    import os

    table, other = session.staged(spark.range(3), "read"), session.staged(spark.range(3), "kept")
    path = table.inputFiles()[0].removeprefix("file:").replace("///", "/")
    session.discard(table, spark.range(2))
    session.discard(table)
    assert not os.path.exists(path) and other.count() == 3


def test_activity_lane_makes_its_bins_after_the_last_join(spark):
    """A grid of bins under a join is broadcast by the size of the sessions, 200 times too small."""
    rows = [(s, i, 10 * i, float(i % 7 + s), 0.0, 0.0) for s in (1, 2, 3) for i in range(0, 500, s)] + [(4, 0, 5, 1.0, 0.0, 0.0), (5, 0, 0, 0.0, 0.0, 0.0), (5, 1, 9, 0.0, 0.0, 0.0)]
    watch = spark.createDataFrame(rows, "session_id long, _ord long, local_ts long, ax double, ay double, az double")
    clock = watch.groupBy("session_id").agg(F.min("local_ts").alias("start_ms"), F.max("local_ts").alias("end_ms"))
    out = quality.activity_lane(watch, clock)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("explode(") < plan.index("Join")
    want = {}
    for s in (1, 2, 3):  # 4 and 5 have no span or no motion
        own = [(t, a) for k, _, t, a, _, _ in rows if k == s]
        end, bins = max(t for t, _ in own), {}
        for t, a in own:
            if t < end:
                bins.setdefault(int(t / (end / 200.0)), []).append(a * a)
        rms = {b: (sum(v) / len(v)) ** 0.5 for b, v in bins.items()}
        want |= {(s, b): rms.get(b, 0.0) / max(rms.values()) for b in range(200)}
    got = {(r.session_id, r.bin): r.level for r in out.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 6e-4 for k in want)


def test_motion_peaks_read_their_table_once(spark, tmp_path):
    rows = [(s, 20 * i, 1000 * i, 50.0 + s if i % 50 == 25 else 1.0 + (i % 7) / 100) for s in (1, 2) for i in range(300)]
    spark.createDataFrame(rows, "session_id long, _ord long, ts long, motion_mag double").write.parquet(str(tmp_path / "watch"))
    out = align.motion_peaks(spark.read.parquet(str(tmp_path / "watch")), width=5000)
    assert not [f for f in out.inputFiles() if "/watch/" in f]
    assert sorted((r.session_id, r.ts, r.motion_mag) for r in out.collect()) == [(s, 1000 * i, 50.0 + s) for s in (1, 2) for i in range(25, 300, 50)]


def test_permutation_importance_pairs_rows_once(spark, monkeypatch):
    rows = [(s, i, 10 * i, float((i * 7 + s) % 11), float((i * 5) % 13), int((i * 7 + s) % 11 > 5)) for s in (1, 2) for i in range(120)]
    df = spark.createDataFrame(rows, "session_id long, _ord long, ts long, a double, b double, label int")
    model = panel.fit(df, ["a", "b"], "rf_small")
    data = with_chunks(df, ["session_id"], "ts", "_ord", 500)
    alone = {}
    for name in ("a", "b"):
        s = panel.score(model, ev.shuffled(data, ["session_id"], ["ts", "_ord"], name)).select("label", "proba_raw")
        alone[name] = auc(panel.score(model, df), [], "proba_raw", "label").first()["auc"] - auc(s, [], "proba_raw", "label").first()["auc"]
    calls, numbered = [], ev.row_numbers
    monkeypatch.setattr(ev, "row_numbers", lambda *a, **b: calls.append(a) or numbered(*a, **b))
    out = {r.feature: r["drop"] for r in panel.permutation_importance(model, data, ["a", "b"], ["ts", "_ord"]).collect()}
    assert len(calls) == 2
    assert out == pytest.approx(alone) and out["a"] > 0.2
