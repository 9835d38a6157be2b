"""Spark ML evaluation: events as windows with six channels, grouped folds of persons."""

from pyspark.sql import functions as F

from ..models import panel
from ..operators import evaluate as ev
from ..session import fresh_path, staged
from .data import SAMPLES, WIDTH, embeddings, rnd, watch
from .registry import query

FEATS = ["ax", "ay", "az", "rx", "ry", "rz"]


def windows(spark, sf):
    """Every third label copies a threshold on the axes, so there is something to learn."""
    w = watch(spark, sf).withColumn("t_center_ms", F.col("ts")).withColumn("task_id", F.col("event_type"))
    learnable = F.when(F.col("_ord") % 3 > 0, (F.col("ax") > F.col("ay")).cast("int")).otherwise(F.col("label"))
    return w.withColumn("label", learnable)


def folds(spark, sf, model="logreg", **o):
    return panel.fold_metrics(panel.leave_group_out(windows(spark, sf), FEATS, model=model, k=3, **o))


@query("g1_leave_group_out", """SELECT user_id % 20 AS person_id, count(*) AS n, 1 AS folds, 0 AS with_others, true AS same_metrics, true AS better_than_chance FROM events GROUP BY 1""")
def _(spark, sf):
    """Rows in are rows out; a person lies in one fold, which no other fold's rows share; the fold's metrics again from its rows."""
    oof = panel.leave_group_out(windows(spark, sf), FEATS, model="logreg", k=3)
    m = panel.fold_metrics(oof).select("held_out", "n_test", "accuracy")
    own = oof.groupBy("held_out").agg(F.count("*").alias("rows"), F.avg(((F.col("proba_raw") >= 0.5).cast("int") == F.col("label")).cast("int")).alias("hits"))
    same = own.join(m, "held_out").select("held_out", ((F.col("rows") == F.col("n_test")) & (F.abs(F.col("hits") - F.col("accuracy")) < 1e-9)).alias("same_metrics"), (F.col("hits") > 0.55).alias("better_than_chance"))
    of = oof.groupBy("person_id").agg(F.count("*").alias("n"), F.countDistinct("held_out").cast("int").alias("folds"), F.countDistinct("fold").cast("int").alias("in_folds"), F.max("held_out").alias("held_out"))
    return of.join(same, "held_out").select("person_id", "n", "folds", (F.col("in_folds") - 1).cast("int").alias("with_others"), "same_metrics", "better_than_chance")


@query("g9_stacking", "WITH" + SAMPLES + " SELECT person_id, count(*) AS n, count(*) AS scored, 4 * count(*) AS uses, 0 AS leaks FROM samples GROUP BY 1")
def _(spark, sf):
    """Every window once, scored by three first models and a second one; how many of them saw its person."""
    rows, uses, models = panel.stacked(windows(spark, sf), FEATS[:3], FEATS[3:], k=3)
    saw = models.select("model", F.col("person_id").alias("saw"))
    each = uses.join(rows.select("_ord", "person_id"), "_ord").join(saw, "model").groupBy("person_id").agg(F.count_if(F.col("saw") == F.col("person_id")).alias("leaks"))
    used = uses.join(rows.select("_ord", "person_id"), "_ord").groupBy("person_id").agg(F.count("*").alias("uses"))
    n = rows.groupBy("person_id").agg(F.count("*").alias("n"), F.count_if(F.col("proba").between(0, 1) & F.col("p1").between(0, 1)).alias("scored"))
    return n.join(used, "person_id").join(each, "person_id").select("person_id", "n", "scored", "uses", F.col("leaks").cast("int").alias("leaks"))


PANEL = ("dummy", "rf_small", "extra_small", "hist_gb_small", "logreg", "mlp", "svm")


@query("g3_panel", "WITH m(model) AS (VALUES " + ", ".join(f"('{m}')" for m in PANEL) + ") SELECT model, (SELECT count(*) FROM events) AS n, 2::BIGINT AS folds, model <> 'dummy' AS above FROM m")
def _(spark, sf):
    """Every kind of the panel: rows scored, folds, and whether the AUC is over 0.7 on a rule that two thirds of the labels follow."""
    out = None
    w = staged(windows(spark, sf).select("session_id", "person_id", "_ord", "label", *FEATS), "panel-windows")
    data = panel.folded(w, FEATS, k=2)  # scaled and dealt to folds once, for all models
    for m in PANEL:
        f = panel.fold_metrics(panel.leave_group_out(w, FEATS, model=m, k=2, data=data))
        d = f.agg(F.sum("n_test").alias("n"), F.count("*").alias("folds"), (F.min("roc_auc") > 0.7).alias("above")).select(F.lit(m).alias("model"), "*")
        out = d if out is None else out.unionByName(d)
    return out


@query("g4_isotonic_calibration")
def _(spark, sf):
    oof = panel.leave_group_out(windows(spark, sf), FEATS, model="logreg", k=2, calibrate=True)
    return ev.reliability(oof, [], "proba_cal")


@query("g5_task_weights", "WITH" + SAMPLES + """, l AS (SELECT event_type, label FROM samples), c AS (SELECT label, count(*) AS c FROM l GROUP BY 1)
  SELECT event_type, label, count(*) AS n, round(sum((SELECT sum(c) FROM c) / (2.0 * c.c) * CASE WHEN event_type = 'view' THEN 3.0 ELSE 1.0 END), 4)::DOUBLE AS weight FROM l JOIN c USING (label) GROUP BY 1, 2""")
def _(spark, sf):
    w = panel.balanced_weights(watch(spark, sf).withColumn("task_id", F.col("event_type")), ["view"])
    return w.groupBy("event_type", "label").agg(F.count("*").alias("n"), rnd(F.sum("weight"), 4).alias("weight"))


@query("g6_g8_train_and_score")
def _(spark, sf):
    path = fresh_path(spark, "final-model")
    w = windows(spark, sf)
    panel.train_final(w, FEATS, path, "logreg")
    return panel.score_table(spark, w, FEATS, path).select("_ord", "session_id", rnd(F.col("proba"), 4).alias("proba"), "writing")


@query("g7_within_session")
def _(spark, sf):
    m, top = panel.within_session(windows(spark, sf), FEATS, "rf_small", width=WIDTH)
    return top.crossJoin(F.broadcast(m.select("n", "accuracy", "roc_auc")))


@query("g11_normalisation_ab")
def _(spark, sf):
    return panel.normalisation_ab(windows(spark, sf), FEATS, model="logreg", k=3)


@query("g12_feature_ablation")
def _(spark, sf):
    w = windows(spark, sf)
    return panel.ablation({"full": (w, FEATS), "acc_only": (w, FEATS[:3])}, model="logreg", k=3)


@query("g13_importances")
def _(spark, sf):
    w = staged(windows(spark, sf), "windows")
    m = panel.fit(w, FEATS, "rf_small")
    imp = panel.importances(spark, m, FEATS)
    perm = panel.permutation_importance(m, w.drop("_chunk").transform(ev.in_time, WIDTH), FEATS, ["t_center_ms", "_ord"])
    return imp.join(perm, "feature", "left")


@query("g14_principal_components")
def _(spark, sf):
    e = embeddings(spark, sf).select("vec_id", *[F.col("x")[i].alias(f"x{i}") for i in range(64)])
    p = panel.principal_components(e, [f"x{i}" for i in range(64)])
    return p.select("vec_id", rnd(F.abs("pc1"), 4).alias("pc1"), rnd(F.abs("pc2"), 4).alias("pc2"))


@query("g15_random_convolutions")
def _(spark, sf):
    e = embeddings(spark, sf).selectExpr("vec_id as _ord", "vec_id % 8 as session_id", "vec_id % 8 as person_id", "cast(label >= 5 as int) as label", "x")
    f, names = panel.random_convolutions(e, 8)
    return panel.fold_metrics(panel.leave_group_out(f.drop("x"), names, model="logreg", k=3))
