"""Evaluation over predictions: events as windows, persons as folds."""

from pyspark.sql import functions as F

from ..kernels import auc
from ..operators import decode as hmm
from ..operators import evaluate as ev
from ..operators import label as lab
from ..operators import strokes as st
from .data import DAY, HOUR, OOF, SAMPLES, WATCH, WIDTH, markers, oof, oof_tasks, rnd, samples, table, watch
from .quality import BLOCKS, TIMELINE
from .registry import query

UNIT = 6 * HOUR  # stands for one second in smoothing queries
OT = OOF + """, ot AS (
  SELECT o.*, s.event_type AS task_id, CASE WHEN s.event_type IN ('click','purchase') THEN 'writing' ELSE 'idle' END AS task_category,
         CASE WHEN o.proba_cal >= 0.5 THEN 1 ELSE 0 END AS pred_cal, CASE WHEN o.proba_raw >= 0.5 THEN 1 ELSE 0 END AS pred_raw
  FROM oof o JOIN samples s USING (_ord))"""


def r6(df, *cols, d=6):
    return df.select(*[rnd(F.col(c), d).alias(c) if c in cols else F.col(c) for c in df.columns])


def auc_sql(src, keys, score, label="label"):
    by = f"PARTITION BY {keys} " if keys else ""
    head, grp = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    return f"""(SELECT {head}CASE WHEN sum({label}) > 0 AND sum({label}) < count(*) THEN
      (sum(rk) FILTER ({label} = 1) - sum({label}) * (sum({label}) + 1) / 2.0::DOUBLE) / (sum({label})::DOUBLE * (count(*) - sum({label}))) END AS auc
      FROM (SELECT *, rank() OVER ({by}ORDER BY {score}) + (count(*) OVER (PARTITION BY {keys + ', ' if keys else ''}{score}) - 1) / 2.0 AS rk FROM {src}) {grp})"""


# ── folds ───────────────────────────────────────────────────────────────────


def cv(spark, sf, proba="proba_cal"):
    return ev.metrics(oof(spark, sf), ["person_id"], proba).selectExpr(
        "person_id as held_out", "n as n_test", "accuracy", "f1_writing", "roc_auc"
    )


def cv_sql(name, proba):
    return f""", {name} AS (SELECT c.*, a.auc AS roc_auc FROM (
      SELECT person_id AS held_out, count(*) AS n_test, avg(CASE WHEN ({proba} >= 0.5) = (label = 1) THEN 1.0::DOUBLE ELSE 0 END) AS accuracy,
        2.0 * count(*) FILTER ({proba} >= 0.5 AND label = 1) / (2 * count(*) FILTER ({proba} >= 0.5 AND label = 1) + count(*) FILTER ({proba} >= 0.5 AND label = 0) + count(*) FILTER ({proba} < 0.5 AND label = 1))::DOUBLE AS f1_writing
      FROM oof GROUP BY 1) c JOIN {auc_sql('oof', 'person_id', proba)} a ON a.person_id = c.held_out)"""


CV = OOF + cv_sql("cva", "proba_cal") + cv_sql("cvb", "proba_raw")


@query("d33_confusion", "WITH" + OT + """
  SELECT person_id, count(*) AS n, count(*) FILTER (pred_cal = 1 AND label = 1) AS tp, count(*) FILTER (pred_cal = 1 AND label = 0) AS fp,
         count(*) FILTER (pred_cal = 0 AND label = 1) AS fn, count(*) FILTER (pred_cal = 0 AND label = 0) AS tn,
         round(avg(CASE WHEN pred_cal = label THEN 1 ELSE 0 END), 6) AS accuracy,
         round(2.0 * count(*) FILTER (pred_cal = 1 AND label = 1) / (count(*) FILTER (pred_cal = 1) + count(*) FILTER (label = 1)), 6)::DOUBLE AS f1_writing FROM ot GROUP BY 1""")
def _(spark, sf):
    return r6(ev.confusion(oof(spark, sf), ["person_id"], "proba_cal"), "accuracy", "f1_writing")


@query("d34_auc_per_person", "WITH" + OOF + f" SELECT person_id, round(auc, 6) AS auc FROM {auc_sql('oof', 'person_id', 'proba_cal')}")
def _(spark, sf):
    return r6(auc(oof(spark, sf), ["person_id"], "proba_cal", "label"), "auc")


@query("d34_auc_documents", f"WITH x AS (SELECT quality AS label, n_chars FROM labels JOIN documents USING (doc_id)) SELECT round(auc, 6) AS auc FROM {auc_sql('x', '', 'n_chars')}")
def _(spark, sf):
    d = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return r6(auc(d, [], "n_chars", "quality"), "auc")


@query("d35_roc_curve", "WITH" + OOF + """, g AS (SELECT person_id, proba_cal AS s, sum(label) AS p, sum(1 - label) AS n FROM oof GROUP BY 1, 2), c AS (
  SELECT *, sum(p) OVER w AS tps, sum(n) OVER w AS fps, lead(p) OVER w AS np, lead(n) OVER w AS nn, sum(p) OVER (PARTITION BY person_id) AS pa, sum(n) OVER (PARTITION BY person_id) AS na
  FROM g WINDOW w AS (PARTITION BY person_id ORDER BY s DESC)), k AS (
  SELECT person_id, s, tps, fps, pa, na FROM c WHERE np IS NULL OR NOT ((p = 0 AND np = 0) OR (n = 0 AND nn = 0))
  UNION ALL SELECT DISTINCT person_id, 1e9, 0, 0, pa, na FROM c), m AS (
  SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY s DESC) - 1 AS rn, count(*) OVER (PARTITION BY person_id) AS total FROM k), ks AS (SELECT unnest(range(40)) AS i), pick AS (
  SELECT DISTINCT person_id, CAST(floor(i * ((total - 1) / 39.0::DOUBLE)) AS BIGINT) AS rn FROM (SELECT DISTINCT person_id, total FROM m), ks)
  SELECT person_id, rn, round(fps / na, 6)::DOUBLE AS fpr, round(tps / pa, 6)::DOUBLE AS tpr FROM m WHERE total <= 40 OR (person_id, rn) IN (SELECT (person_id, rn) FROM pick)""")
def _(spark, sf):
    return r6(ev.roc_points(oof(spark, sf), ["person_id"], "proba_cal"), "fpr", "tpr")


REL = OOF + """, rel AS (SELECT CAST(least(floor(proba_cal * 10), 9) AS INT) AS bin, avg(proba_cal) AS mean_p, avg(label) AS frac_pos, count(*) AS n FROM oof GROUP BY 1)"""


@query("d36_reliability", "WITH" + REL + """
  SELECT CAST(g.b AS INT) AS bin, round(mean_p, 6) AS mean_p, round(frac_pos, 6) AS frac_pos, coalesce(n, 0) AS count
  FROM (SELECT unnest(range(10)) AS b) g LEFT JOIN rel ON rel.bin = g.b""")
def _(spark, sf):
    return r6(ev.reliability(oof(spark, sf), [], "proba_cal"), "mean_p", "frac_pos")


@query("d37_ece", "WITH" + REL + " SELECT round(sum(n * abs(frac_pos - mean_p)) / sum(n), 6) AS ece FROM rel")
def _(spark, sf):
    return r6(ev.ece(oof(spark, sf), [], "proba_cal"), "ece")


@query("d38_brier", "WITH" + OOF + """ SELECT person_id, round(avg((proba_raw - label) ** 2), 6) AS brier_proba_raw, round(avg((proba_cal - label) ** 2), 6) AS brier_proba_cal FROM oof GROUP BY 1""")
def _(spark, sf):
    return r6(ev.brier(oof(spark, sf), ["person_id"], ["proba_raw", "proba_cal"]), "brier_proba_raw", "brier_proba_cal")


@query("d39_cv_summary", "WITH" + CV + """
  SELECT count(*) AS folds, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_sd, round(avg(f1_writing), 6) AS f1_writing_mean,
         round(stddev_pop(f1_writing), 6) AS f1_writing_sd, round(avg(roc_auc), 6) AS roc_auc_mean, round(stddev_pop(roc_auc), 6) AS roc_auc_sd,
         round(sum(accuracy * n_test) / sum(n_test), 6) AS accuracy_weighted FROM cva""")
def _(spark, sf):
    s = ev.cv_summary(cv(spark, sf))
    return r6(s, *[c for c in s.columns if c != "folds"])


@query("c8_paired_folds", "WITH" + CV + """
  SELECT a.held_out, round(a.accuracy, 6) AS accuracy_a, round(b.accuracy, 6) AS accuracy_b FROM cva a JOIN cvb b USING (held_out)""")
def _(spark, sf):
    return r6(ev.paired_folds(cv(spark, sf), cv(spark, sf, "proba_raw"), "accuracy"), "accuracy_a", "accuracy_b")


@query("d43_wilcoxon", "WITH" + CV + """, d AS (SELECT a.roc_auc - b.roc_auc AS d FROM cva a JOIN cvb b USING (held_out)), r AS (
  SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk FROM d WHERE d <> 0), w AS (
  SELECT least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)) AS w, count(*) AS m FROM r), dp AS (
  WITH RECURSIVE c AS (SELECT 0 AS k, 0 AS s, 1::DOUBLE AS cnt UNION ALL
    SELECT k + 1, s2, sum(cnt) FROM (SELECT k, unnest([s, s + k + 1]) AS s2, cnt FROM c WHERE k < (SELECT m FROM w)) GROUP BY k, s2) SELECT * FROM c)
  SELECT (SELECT count(*) FROM d) AS n, round((SELECT median(d) FROM d), 6) AS median_diff, round((SELECT avg(d) FROM d), 6) AS mean_diff, w::DOUBLE AS statistic,
         round(least(1.0, 2 * (SELECT sum(cnt) FROM dp WHERE k = m AND s <= w) / pow(2, m)), 6) AS p_value,
         least(1.0, 2 * (SELECT sum(cnt) FROM dp WHERE k = m AND s <= w) / pow(2, m)) < 0.05 AS significant FROM w""")
def _(spark, sf):
    p = ev.paired_folds(cv(spark, sf), cv(spark, sf, "proba_raw"), "roc_auc")
    return r6(ev.wilcoxon(p, "roc_auc_a", "roc_auc_b"), "median_diff", "mean_diff", "p_value")


# ── blocks and tasks ────────────────────────────────────────────────────────

D24 = "100.0 * avg(CASE WHEN proba_cal >= 0.5 THEN 1.0::DOUBLE ELSE 0 END)"


@query("d24_block_percentages", "WITH" + OT + f"""
  SELECT session_id, task_id, count(*) AS n_windows, round({D24}, 6) AS pred_pct, round(100.0 * avg(proba_cal), 6) AS pred_pct_proba, round(100.0 * avg(label), 6) AS true_pct
  FROM ot GROUP BY 1, 2""")
def _(spark, sf):
    return r6(ev.block_percentages(oof_tasks(spark, sf), ["session_id", "task_id"]), "pred_pct", "pred_pct_proba", "true_pct")


# One day and ten days stand for 60 and 300 seconds.
TB = OOF + f""", a AS (SELECT session_id, min(t_center_ms) AS a FROM oof GROUP BY 1), sc AS (SELECT unnest([{DAY // 1000}.0, {10 * DAY // 1000}.0, 0.0])::DOUBLE AS scale), tb AS (
  SELECT o.session_id, person_id, scale, CASE WHEN scale = 0 THEN 0 ELSE CAST(floor((t_center_ms - a) / (scale * 1000)) AS BIGINT) END AS block,
         count(*) AS n_windows, {D24} AS pred_pct, 100.0 * avg(label) AS truth_closed_pct, min(a) AS a FROM oof o JOIN a USING (session_id) CROSS JOIN sc GROUP BY ALL), tp AS (
  SELECT s.session_id, scale, CASE WHEN scale = 0 THEN 0 ELSE greatest(0, CAST(floor((ts - a) / (scale * 1000)) AS BIGINT)) END AS block,
         avg(CASE WHEN event_type IN ('click','view') THEN 1 ELSE 0 END) * 100.0 AS truth_pen_pct FROM samples s JOIN a USING (session_id) CROSS JOIN sc GROUP BY ALL), blocks AS (
  SELECT tb.*, tp.truth_pen_pct FROM tb LEFT JOIN tp ON tp.session_id = tb.session_id AND tp.scale = tb.scale AND tp.block = tb.block)"""


def blocks(spark, sf):
    pen = samples(spark, sf).selectExpr("session_id", "_ord", "ts", "cast(event_type in ('click', 'view') as int) as label_writing")
    return ev.time_blocks(oof(spark, sf), pen, (DAY / 1000, 10 * DAY / 1000, None))


@query("d25_time_blocks", "WITH" + TB + """
  SELECT session_id, scale, block, n_windows, round(pred_pct, 6) AS pred_pct, round(truth_closed_pct, 6) AS truth_closed_pct,
         round(truth_pen_pct, 6) AS truth_pen_pct, a + block * scale * 1000 AS block_start_ms FROM blocks""")
def _(spark, sf):
    b = blocks(spark, sf).drop("person_id", "pred_pct_proba")
    return r6(b, "pred_pct", "truth_closed_pct", "truth_pen_pct")


@query("d26_regression_metrics", "WITH" + TB + """
  SELECT scale, truth, count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias FROM (
    SELECT scale, 'closed' AS truth, pred_pct - truth_closed_pct AS e FROM blocks UNION ALL SELECT scale, 'pen', pred_pct - truth_pen_pct FROM blocks)
  WHERE e IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    return r6(ev.regression_metrics(blocks(spark, sf)), "mae", "rmse", "bias")


ENG = TIMELINE + OOF.replace(SAMPLES, "") + f""", asg AS (
  SELECT o.*, t.task_index, t.task_id, t.task_category FROM oof o JOIN timeline t ON t.session_id = o.session_id AND o.ts >= t.start_ms AND o.ts < t.end_ms
  QUALIFY row_number() OVER (PARTITION BY o._ord ORDER BY t.start_ms DESC) = 1), eng AS (
  SELECT session_id, person_id, task_index, task_id, task_category, count(*) AS n_windows, {D24} AS pred_pct, 100.0 * avg(label) AS true_pct FROM asg GROUP BY ALL)"""


def assigned(spark, sf):
    return lab.attach_tasks(oof(spark, sf), st.task_timeline(markers(spark, sf)), at="t_center_ms", width=2 * DAY)


@query("d27_engagement", "WITH" + ENG + """
  SELECT session_id, task_index, task_id, n_windows, round(pred_pct, 6) AS pred_pct, round(true_pct, 6) AS true_pct, round(pred_pct - true_pct, 6) AS error_pp FROM eng""")
def _(spark, sf):
    e = ev.engagement(assigned(spark, sf))
    return r6(e.select("session_id", "task_index", "task_id", "n_windows", "pred_pct", "true_pct", "error_pp"), "pred_pct", "true_pct", "error_pp")


@query("d28_person_task_matrix", "WITH" + ENG + """
  SELECT person_id, """ + ", ".join(
    f"round(avg(true_pct) FILTER (task_category = 'writing' AND task_id = '{t}'), 6) AS {t}_true, round(avg(pred_pct) FILTER (task_category = 'writing' AND task_id = '{t}'), 6) AS {t}_pred"
    for t in ("T0", "T2")) + ", round(avg(true_pct) FILTER (task_category = 'idle'), 6) AS idle_true FROM eng GROUP BY 1")
def _(spark, sf):
    m = ev.person_task_matrix(ev.engagement(assigned(spark, sf)), ["T0", "T2"])
    return r6(m, *[c for c in m.columns if c != "person_id"])


@query("d29_false_positive_rates", "WITH" + OT + """
  SELECT CASE WHEN grouping(task_id) = 1 THEN 'all' WHEN grouping(person_id) = 1 THEN 'task' ELSE 'person_task' END AS level,
         coalesce(person_id, -1) AS person_id, coalesce(task_id, '') AS task_id, count(*) AS n, CAST(sum(pred_cal) AS BIGINT) AS n_fp, round(avg(pred_cal), 6) AS fpr
  FROM ot WHERE task_category = 'idle' GROUP BY GROUPING SETS ((task_id), (person_id, task_id), ())""")
def _(spark, sf):
    o = ev.false_positive_rates(oof_tasks(spark, sf))
    return r6(o.na.fill(-1, ["person_id"]).na.fill("", ["task_id"]), "fpr")


@query("d29_pooled_rates", "WITH" + OT + """
  SELECT CASE WHEN task_id = 'view' THEN 'hard' ELSE 'easy' END AS kind, count(*) AS n, CAST(sum(pred_cal) AS BIGINT) AS n_fp, round(avg(pred_cal), 6) AS fpr
  FROM ot WHERE task_category = 'idle' GROUP BY 1""")
def _(spark, sf):
    return r6(ev.pooled_rate(oof_tasks(spark, sf), ["view"]), "fpr")


@query("d30_task_errors", "WITH" + OT + """
  SELECT task_id, task_category, count(*) AS n, count(*) FILTER (pred_raw = 1 AND label = 0) AS fp, count(*) FILTER (pred_raw = 0 AND label = 1) AS fn,
         round(avg(CASE WHEN pred_raw = label THEN 1 ELSE 0 END), 3) AS acc, round(count(*) FILTER (pred_raw = 1 AND label = 0) / count(*), 3) AS fp_rate,
         round(count(*) FILTER (pred_raw = 0 AND label = 1) / count(*), 3) AS fn_rate FROM ot GROUP BY 1, 2""")
def _(spark, sf):
    return ev.task_errors(oof_tasks(spark, sf))


@query("d31_error_analysis", "WITH" + OT + """, g AS (SELECT task_category, task_id, count(*) AS n, avg(label) AS true_share, avg(pred_cal) AS pred_share, avg(CASE WHEN pred_cal = label THEN 1 ELSE 0 END) AS acc,
    avg(proba_cal) AS mean_proba, count(*) FILTER (pred_cal = 1 AND label = 1) AS tp, count(*) FILTER (pred_cal = 0 AND label = 0) AS tn,
    count(*) FILTER (pred_cal = 1 AND label = 0) AS fp, count(*) FILTER (pred_cal = 0 AND label = 1) AS fn,
    avg(abs(proba_cal - 0.5)) FILTER (pred_cal = label) AS confidence_correct, avg(abs(proba_cal - 0.5)) FILTER (pred_cal <> label) AS confidence_wrong FROM ot GROUP BY 1, 2)
  SELECT task_category, task_id, n, round(true_share, 6) AS true_share, round(pred_share, 6) AS pred_share, round(acc, 6) AS acc, round(mean_proba, 6) AS mean_proba, tp, tn, fp, fn,
    round(confidence_correct, 6) AS confidence_correct, round(confidence_wrong, 6) AS confidence_wrong,
    round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 6) AS fp_rate_of_idle, round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) END, 6) AS fn_rate_of_writing,
    round(fp / nullif(sum(fp) OVER (), 0), 6)::DOUBLE AS fp_share, round(fn / nullif(sum(fn) OVER (), 0), 6)::DOUBLE AS fn_share FROM g""")
def _(spark, sf):
    e = ev.error_analysis(oof_tasks(spark, sf), "proba_cal", ["task_category", "task_id"])
    return r6(e, *[c for c in e.columns if c not in ("task_category", "task_id", "n", "tp", "tn", "fp", "fn")])


BOUND = OT + """, tc AS (SELECT *, lag(task_id) OVER (PARTITION BY session_id ORDER BY t_center_ms, _ord) AS pt FROM ot), bd AS (
  SELECT session_id, t_center_ms AS b FROM tc WHERE pt IS NULL OR pt <> task_id), dist AS (
  SELECT o._ord, o.label, o.pred_cal, min(abs(o.t_center_ms - bd.b)) AS boundary_ms FROM ot o JOIN bd ON bd.session_id = o.session_id GROUP BY ALL)"""


@query("c11_boundary_distance", "WITH" + BOUND + " SELECT _ord, boundary_ms FROM dist")
def _(spark, sf):
    return ev.boundary_distance(oof_tasks(spark, sf), width=WIDTH).select("_ord", "boundary_ms")


@query("d32_boundary_buckets", "WITH" + BOUND + f""", b AS (SELECT *, CASE WHEN boundary_ms / {HOUR}.0 < 2 THEN '0-2s' WHEN boundary_ms / {HOUR}.0 < 5 THEN '2-5s' WHEN boundary_ms / {HOUR}.0 < 15 THEN '5-15s' ELSE '>15s' END AS bucket FROM dist), g AS (
  SELECT bucket, count(*) AS n, avg(CASE WHEN pred_cal = label THEN 1 ELSE 0 END) AS accuracy, count(*) FILTER (pred_cal <> label) AS errors,
    count(*) FILTER (pred_cal = 0 AND label = 1) AS fn, count(*) FILTER (pred_cal = 1 AND label = 0) AS fp FROM b GROUP BY 1)
  SELECT bucket, n, round(accuracy, 6) AS accuracy, errors, fn, fp, round(errors / sum(errors) OVER (), 6)::DOUBLE AS share_of_errors, round(n / sum(n) OVER (), 6)::DOUBLE AS share_of_windows FROM g""")
def _(spark, sf):
    d = ev.boundary_buckets(ev.boundary_distance(oof_tasks(spark, sf), width=WIDTH), "proba_cal", HOUR)
    return r6(d, "accuracy", "share_of_errors", "share_of_windows")


@query("d52_block_accuracy", "WITH" + BLOCKS + OOF.replace(SAMPLES, "") + """, nb AS (
  SELECT *, CASE WHEN task_id = 'T1' THEN 'Pause ' || sum(CASE WHEN task_id = 'T1' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY start_ms) ELSE task_id END AS block FROM blocks), a AS (
  SELECT o.person_id, nb.block, CASE WHEN (o.proba_cal >= 0.5) = (o.label = 1) THEN 1 ELSE 0 END AS ok FROM oof o JOIN nb ON nb.session_id = o.session_id AND o.ts >= nb.start_ms AND o.ts < nb.end_ms)
  SELECT person_id, round(avg(ok) FILTER (block = 'T0'), 6) AS "T0", round(avg(ok) FILTER (block = 'Pause 1'), 6) AS "Pause 1", round(avg(ok) FILTER (block = 'Pause 2'), 6) AS "Pause 2" FROM a GROUP BY 1""")
def _(spark, sf):
    b = st.numbered_pauses(st.marker_blocks(markers(spark, sf)).withColumn("_ord", F.col("end_ms")), "T1")
    a = lab.attach_tasks(oof(spark, sf), b, at="t_center_ms", width=DAY, how="inner")
    return r6(ev.block_accuracy(a, "proba_cal", ["T0", "Pause 1", "Pause 2"]), "T0", "Pause 1", "Pause 2")


# ── smoothing and sequences ─────────────────────────────────────────────────

SMOOTH = OOF + """, num AS (SELECT *, row_number() OVER w AS rn, t_center_ms - lag(t_center_ms) OVER w AS dt FROM oof WINDOW w AS (PARTITION BY session_id ORDER BY t_center_ms, _ord)), stp AS (
  SELECT session_id, coalesce(nullif(median(dt), 0), 500.0) AS step FROM num GROUP BY 1), sz AS (
  SELECT num.*, sc.scale, greatest(1, CAST(round_even(sc.scale * {unit}.0 / step, 0) AS BIGINT)) AS n FROM num JOIN stp USING (session_id) CROSS JOIN (SELECT unnest([5.0, 10.0, 30.0])::DOUBLE AS scale) sc), sm AS (
  SELECT *, avg(proba_cal) OVER (PARTITION BY session_id, scale ORDER BY rn ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING) AS smooth FROM sz)"""
CAUSAL = SMOOTH.format(unit=UNIT, before="(n - 1)", after="0")
CENTRE = SMOOTH.format(unit=UNIT, before="(n // 2)", after="((n - 1) // 2)")
SM = dict(unit_ms=UNIT, width=WIDTH)


@query("e5_causal_smoothing", "WITH" + CAUSAL + " SELECT _ord, scale, round(smooth, 6) AS smooth FROM sm")
def _(spark, sf):
    return r6(ev.smoothed(oof(spark, sf), "proba_cal", **SM).select("_ord", "scale", "smooth"), "smooth")


BM = """, m AS (SELECT person_id, scale, avg(CASE WHEN (round(smooth, 12) >= 0.5) = (label = 1) THEN 1 ELSE 0 END) AS accuracy FROM sm GROUP BY 1, 2)"""


@query("e5_burst_metrics", "WITH" + CAUSAL + BM + f"""
  SELECT m.person_id, m.scale, round(accuracy, 6) AS accuracy, round(a.auc, 4) AS roc_auc FROM m JOIN {auc_sql('(SELECT * EXCLUDE (smooth), round(smooth, 12) AS smooth FROM sm)', 'person_id, scale', 'smooth')} a ON a.person_id = m.person_id AND a.scale = m.scale""")
def _(spark, sf):
    s = ev.smoothed(oof(spark, sf), "proba_cal", **SM).withColumn("smooth", F.round("smooth", 12))
    m = ev.metrics(s, ["person_id", "scale"], "smooth").select("person_id", "scale", "accuracy", "roc_auc")
    return r6(r6(m, "accuracy"), "roc_auc", d=4)


@query("e6_centred_smoothing", "WITH" + CENTRE + " SELECT _ord, scale, round(smooth, 6) AS smooth FROM sm")
def _(spark, sf):
    return r6(ev.smoothed(oof(spark, sf), "proba_cal", centred=True, **SM).select("_ord", "scale", "smooth"), "smooth")


@query("d53_burst_sweep", "WITH" + CAUSAL + BM + f""", f AS (
  SELECT m.person_id, m.scale, accuracy, a.auc AS roc_auc FROM m JOIN {auc_sql('(SELECT * EXCLUDE (smooth), round(smooth, 12) AS smooth FROM sm)', 'person_id, scale', 'smooth')} a ON a.person_id = m.person_id AND a.scale = m.scale)
  SELECT scale, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_pop(accuracy), 6) AS accuracy_sd, round(avg(roc_auc), 4) AS roc_auc_mean, round(stddev_pop(roc_auc), 4) AS roc_auc_sd FROM f GROUP BY 1""")
def _(spark, sf):
    s = ev.smoothed(oof(spark, sf), "proba_cal", **SM).withColumn("smooth", F.round("smooth", 12))
    m = ev.burst_sweep(ev.metrics(s, ["person_id", "scale"], "smooth"))
    return r6(r6(m, "accuracy_mean", "accuracy_sd"), "roc_auc_mean", "roc_auc_sd", d=4)


@query("e13_error_streaks", "WITH" + OT + """, k AS (SELECT *, CASE WHEN pred_cal = label THEN 'ok' WHEN pred_cal = 1 THEN 'FP' ELSE 'FN' END AS k FROM ot), g AS (
  SELECT *, sum(CASE WHEN k = pk THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY t_center_ms, _ord) AS run FROM (
    SELECT *, lag(k) OVER (PARTITION BY session_id ORDER BY t_center_ms, _ord) AS pk FROM k))
  SELECT session_id, k AS error_type, min(t_center_ms) AS start_ms, count(*) AS length FROM g WHERE k <> 'ok' GROUP BY session_id, run, k ORDER BY length DESC, start_ms, session_id LIMIT 12""")
def _(spark, sf):
    return ev.error_streaks(oof_tasks(spark, sf), "proba_cal", width=WIDTH)


@query("e17_temporal_split", "WITH" + OOF + """, n AS (SELECT _ord, row_number() OVER (PARTITION BY session_id ORDER BY t_center_ms, _ord) - 1 AS rn, CAST(trunc(count(*) OVER (PARTITION BY session_id) * (1.0::DOUBLE - 0.2::DOUBLE)) AS BIGINT) AS cut FROM oof)
  SELECT _ord, CASE WHEN rn >= cut THEN 'test' ELSE 'train' END AS role FROM n WHERE rn >= cut OR rn < greatest(0, cut - 4)""")
def _(spark, sf):
    return ev.temporal_split(oof(spark, sf), width=WIDTH).select("_ord", "role")


@query("e18_calibration_prefix", "WITH" + OOF + """, n AS (SELECT _ord, row_number() OVER (PARTITION BY session_id ORDER BY t_center_ms, _ord) - 1 AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM oof)
  SELECT _ord, CASE WHEN rn < n // 3 THEN 'calib' ELSE 'eval' END AS part FROM n""")
def _(spark, sf):
    return ev.calibration_prefix(oof(spark, sf), width=WIDTH).select("_ord", "part")


# ── scaling and folds ───────────────────────────────────────────────────────


NINE = ("ax", "ay", "az", "rx", "ry", "rz", "gx", "gy", "gz")


@query("e19_zscore_per_session", "WITH" + WATCH + " SELECT _ord, " + ", ".join(
    f"round(({c} - avg({c}) OVER w) / coalesce(nullif(stddev_samp({c}) OVER w, 0), 1), 6) AS {c}" for c in NINE) + " FROM watch WINDOW w AS (PARTITION BY session_id)")
def _(spark, sf):
    """All channels; gz is constant and stays at zero."""
    z = ev.zscore_per_session(watch(spark, sf), list(NINE))
    return r6(z.select("_ord", *NINE), *NINE)


@query("e20_pooled_zscore", "WITH" + WATCH + ", st AS (SELECT p.person_id, " + ", ".join(f"avg({c}) AS m_{c}, coalesce(nullif(stddev_samp({c}), 0), 1) AS s_{c}" for c in NINE) + """ FROM (SELECT DISTINCT person_id FROM watch) p JOIN watch w ON w.person_id <> p.person_id GROUP BY 1)
  SELECT _ord, """ + ", ".join(f"round(({c} - m_{c}) / s_{c}, 5) AS {c}" for c in NINE) + " FROM watch JOIN st USING (person_id)")
def _(spark, sf):
    w = watch(spark, sf)
    z = ev.apply_zscore(w, ev.pooled_stats_by_fold(w, list(NINE)), ["person_id"], list(NINE))
    return r6(z.select("_ord", *NINE), *NINE, d=5)


@query("c7_dimension_join", "SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def _(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    dim = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name")
    return table(spark, sf, "customer").join(dim, "c_nationkey", "left").select("c_custkey", "n_name", "r_name")


@query("c12_fold_sets", "WITH" + SAMPLES + """
  SELECT h.person_id AS held_out, CASE WHEN h.person_id = s.person_id THEN 'test' ELSE 'train' END AS role, count(*) AS n, round(avg(v), 6) AS mean_v
  FROM (SELECT DISTINCT person_id FROM samples) h CROSS JOIN samples s GROUP BY 1, 2""")
def _(spark, sf):
    s = samples(spark, sf)
    one = F.lit(1).cast("long")
    out = ev.fold_sums(s, {"n": one, "sv": F.col("v")}).selectExpr("held_out", "role", "n", "sv / n as mean_v")
    return r6(out, "mean_v")


@query("c13_metadata_lookup", "WITH" + SAMPLES + """, m AS (SELECT session_id, arg_min(event_type, _ord) AS protocol FROM samples WHERE session_id % 3 <> 0 GROUP BY 1)
  SELECT s.session_id, m.protocol, count(*) AS n FROM samples s LEFT JOIN m USING (session_id) GROUP BY 1, 2""")
def _(spark, sf):
    from ..kernels import attach

    s = samples(spark, sf)
    meta = s.filter("session_id % 3 <> 0").groupBy("session_id").agg(F.min_by("event_type", "_ord").alias("protocol"))
    return attach(s, meta, ["session_id"], "left").groupBy("session_id", "protocol").agg(F.count("*").alias("n"))


@query("g17_rotating_roles", "WITH" + SAMPLES + """, p AS (SELECT person_id, row_number() OVER (ORDER BY person_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT person_id FROM samples))
  SELECT h.person_id AS held_out, t.person_id, CASE WHEN t.i = h.i THEN 'test' WHEN t.i = (h.i + 1) % h.n THEN 'validation' ELSE 'train' END AS role FROM p h CROSS JOIN p t WHERE h.n >= 3""")
def _(spark, sf):
    return ev.rotating_roles(samples(spark, sf))


@query("g2_grouped_folds", "WITH" + SAMPLES + """ SELECT count(DISTINCT person_id) AS persons, 5::BIGINT AS folds, ceil(count(DISTINCT person_id) / 5.0)::BIGINT AS largest FROM samples""")
def _(spark, sf):
    f = ev.grouped_folds(samples(spark, sf), 5)
    sizes = f.groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("person_id").alias("d"))
    return sizes.agg(F.sum("d").alias("persons"), F.count("*").alias("folds"), F.max("n").alias("largest"))


# ── tables of runs ──────────────────────────────────────────────────────────


def runs(spark, sf):
    """Orders as model trials: priority = model, customer block = fold."""
    o = table(spark, sf, "orders")
    return o.selectExpr(
        "o_orderpriority as model", "o_custkey % 7 as window", "o_custkey % 15 as held_out", "o_orderkey as trial",
        "if(o_orderkey % 11 = 0, null, least(o_totalprice / 500000, 1.0D)) as accuracy", "(o_orderkey % 997) / 997.0D as roc_auc",
        "if(o_orderkey % 4 = 0, 0.5D, 0.2D) as dropout", "if(o_orderkey % 3 = 0, 128, 64) as batch_size",
        "concat('R', cast(o_custkey % 40 as string)) as run_id", "o_orderstatus as pool", "o_totalprice / 1000 as sec",
    )


RUNS = """runs AS (SELECT o_orderpriority AS model, o_custkey % 7 AS "window", o_custkey % 15 AS held_out, o_orderkey AS trial,
  CASE WHEN o_orderkey % 11 <> 0 THEN least(o_totalprice / 500000, 1.0) END AS accuracy, (o_orderkey % 997) / 997.0::DOUBLE AS roc_auc,
  CASE WHEN o_orderkey % 4 = 0 THEN 0.5 ELSE 0.2 END::DOUBLE AS dropout, CASE WHEN o_orderkey % 3 = 0 THEN 128 ELSE 64 END AS batch_size,
  'R' || (o_custkey % 40) AS run_id, o_orderstatus AS pool, o_totalprice / 1000 AS sec FROM orders)"""


@query("d40_leaderboard", "WITH " + RUNS + """ SELECT model, "window", round(avg(accuracy), 6) AS mean_acc, round(avg(roc_auc), 6) AS mean_auc, count(*) AS folds FROM runs GROUP BY 1, 2""")
def _(spark, sf):
    return r6(ev.leaderboard(runs(spark, sf), ["model", "window"]), "mean_acc", "mean_auc")


@query("d41_winners", "WITH " + RUNS + """, f AS (SELECT model, count(*) FILTER (accuracy IS NULL) AS infeasible FROM runs GROUP BY 1)
  SELECT r.model, r.trial, round(r.accuracy, 6) AS accuracy, f.infeasible, dropout IN (0.0, 0.5) OR batch_size IN (32, 128) AS at_boundary FROM runs r JOIN f USING (model) WHERE accuracy IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY r.model ORDER BY accuracy DESC, trial) = 1""")
def _(spark, sf):
    return r6(ev.winners(runs(spark, sf)).select("model", "trial", "accuracy", "infeasible", "at_boundary"), "accuracy")


@query("d42_seed_average", "WITH " + RUNS + " SELECT held_out, round(avg(accuracy), 6) AS accuracy, round(avg(roc_auc), 6) AS roc_auc FROM runs GROUP BY 1")
def _(spark, sf):
    return r6(ev.seed_average(runs(spark, sf)), "accuracy", "roc_auc")


@query("d44_diagnostic_correlation", "WITH " + RUNS + " SELECT model, round(corr(sec, accuracy), 6) AS r_sigma, round(corr(roc_auc, accuracy), 6) AS r_drift FROM runs GROUP BY 1")
def _(spark, sf):
    out = ev.diagnostic_correlation(runs(spark, sf), {"r_sigma": ("sec", "accuracy"), "r_drift": ("roc_auc", "accuracy")}, ["model"])
    return r6(out, "r_sigma", "r_drift")


@query("d47_class_kinematics", "WITH" + WATCH + ", l AS (" + " UNION ALL ".join(f"SELECT label, '{c}' AS feature, {c} AS value FROM watch" for c in ("ax", "ay", "az", "rx", "ry", "rz")) + """)
  SELECT feature, round(avg(value) FILTER (label = 1), 6) AS writing_mean, round(avg(value) FILTER (label = 0), 6) AS idle_mean, round(avg(value) FILTER (label = 1) / avg(value) FILTER (label = 0), 6) AS ratio FROM l GROUP BY 1""")
def _(spark, sf):
    return r6(ev.class_kinematics(watch(spark, sf), ["ax", "ay", "az", "rx", "ry", "rz"]), "writing_mean", "idle_mean", "ratio")


FG = "CASE WHEN {c} LIKE '%jerk%' THEN 'jerk' WHEN {c} LIKE '%zcr%' THEN 'zcr' WHEN {c} LIKE '%corr%' THEN 'correlation' WHEN {c} LIKE '%mag%' THEN 'magnitude' WHEN {c} LIKE '%tilt%' OR {c} LIKE '%grav%' THEN 'gravity' WHEN {c} LIKE '%dom_freq%' OR {c} LIKE '%spec_%' OR {c} LIKE '%band_%' THEN 'spectral' ELSE 'time_stats' END"


@query("d50_importance_groups", "WITH x AS (SELECT ['ax_jerk_std','ry_zcr','corr_ax_ay','acc_mag_std','tilt_x_mean','rz_spec_entropy','ax_mean'][CAST(p_partkey % 7 AS INT) + 1] AS feature, p_retailprice AS importance FROM part) SELECT " + FG.format(c="feature") + ' AS "group", round(sum(importance), 4) AS total, count(*) AS features, round(avg(importance), 6) AS mean FROM x GROUP BY 1')
def _(spark, sf):
    names = "array('ax_jerk_std','ry_zcr','corr_ax_ay','acc_mag_std','tilt_x_mean','rz_spec_entropy','ax_mean')"
    x = table(spark, sf, "part").selectExpr(f"{names}[cast(p_partkey % 7 as int)] as feature", "p_retailprice as importance")
    return r6(r6(ev.importance_by_group(x), "total", d=4), "mean")


EG = "CASE WHEN {c} LIKE 'corr@_%' ESCAPE '@' THEN 'correlation' WHEN {c} LIKE '%@_jerk@_%' ESCAPE '@' THEN 'jerk' WHEN {c} LIKE '%@_zcr' ESCAPE '@' THEN 'zcr' WHEN regexp_matches({c}, '(_dom_freq|_spec_centroid|_spec_entropy|_band_3_8)$') THEN 'spectral' WHEN {c} LIKE 'acc@_mag@_%' ESCAPE '@' OR {c} LIKE 'gyro@_mag@_%' ESCAPE '@' THEN 'magnitude' ELSE 'time_stats' END"
NAMES = "'ax_jerk_std','ry_zcr','corr_ax_ay','acc_mag_std','tilt_x_mean','rz_spec_entropy','ax_mean','acc_mag_jerk_max','gyro_mag_dom_freq'"


@query("d50_engineering_groups", f"WITH x AS (SELECT [{NAMES}][CAST(p_partkey % 9 AS INT) + 1] AS feature, p_retailprice AS importance FROM part) SELECT " + EG.format(c="feature") + ' AS "group", round(sum(importance), 4) AS total, count(*) AS features, round(avg(importance), 6) AS mean FROM x GROUP BY 1')
def _(spark, sf):
    x = table(spark, sf, "part").selectExpr(f"array({NAMES})[cast(p_partkey % 9 as int)] as feature", "p_retailprice as importance")
    return r6(r6(ev.importance_by_group(x, ev.ENGINEERING_RULES), "total", d=4), "mean")


@query("d51_weakest", "WITH " + RUNS + " SELECT held_out, round(avg(accuracy), 6) AS accuracy FROM runs GROUP BY 1 ORDER BY avg(accuracy), held_out LIMIT 4")
def _(spark, sf):
    return r6(ev.weakest(runs(spark, sf), ["held_out"], 4), "accuracy")


@query("d54_pool_statistics", "SELECT o_orderstatus AS pool, count(DISTINCT o_custkey % 15) AS n_subjects, count(DISTINCT o_custkey) AS n_sessions FROM orders GROUP BY 1")
def _(spark, sf):
    return ev.pool_statistics(table(spark, sf, "orders").selectExpr("o_orderstatus as pool", "o_custkey % 15 as person_id", "o_custkey as session_id"))


@query("d55_fold_time", "WITH " + RUNS + " SELECT model, pool, round(median(sec), 6) AS per_fold_sec, count(DISTINCT run_id) AS n_runs FROM runs GROUP BY 1, 2")
def _(spark, sf):
    return r6(ev.fold_time_estimate(runs(spark, sf)), "per_fold_sec")


@query("d56_run_history", "WITH " + RUNS + """, r AS (SELECT DISTINCT run_id FROM runs)
  SELECT r.run_id, round(c.a, 6) AS mean_acc, round(c.u, 6) AS mean_auc, c.n::DOUBLE AS folds, round(t.s, 4) AS total_sec FROM r LEFT JOIN (SELECT run_id, avg(accuracy) AS a, avg(roc_auc) AS u, count(*) AS n FROM runs WHERE run_id <> 'R3' GROUP BY 1) c USING (run_id)
  LEFT JOIN (SELECT run_id, sum(sec) AS s FROM runs WHERE run_id <> 'R5' GROUP BY 1) t USING (run_id)""")
def _(spark, sf):
    r = runs(spark, sf)
    out = ev.run_history(r.select("run_id").distinct(), r.filter("run_id <> 'R3'"), r.filter("run_id <> 'R5'"))
    return r6(r6(out.withColumn("folds", F.col("folds").cast("double")), "mean_acc", "mean_auc"), "total_sec", d=4)


@query("d57_feature_agreement", "WITH" + WATCH + ", l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS x, {c} + sequence / 1000.0::DOUBLE AS y FROM watch" for c in NINE[:8]) + ") SELECT feature, round(max(abs(x - y)), 6) AS max_abs_diff, round(corr(x, y), 6) AS corr FROM l GROUP BY 1")
def _(spark, sf):
    w = watch(spark, sf).select("_ord", *NINE[:8], "sequence")
    b = w.selectExpr("_ord", *[f"{c} + sequence / 1000.0D as {c}" for c in NINE[:8]])
    return r6(ev.feature_agreement(w, b, ["_ord"], NINE[:8]), "max_abs_diff", "corr")


@query("d58_residual_correlation", "WITH" + OOF + " SELECT person_id, round(corr(proba_raw - label, proba_cal - label), 6) AS residual_corr FROM oof GROUP BY 1")
def _(spark, sf):
    return r6(ev.residual_correlation(oof(spark, sf), "proba_raw", "proba_cal", ["person_id"]), "residual_corr")


@query("d59_window_comparison", "WITH " + RUNS + """, l AS (SELECT model, "window", unnest(['1s','5s','10s','30s']) AS scale, unnest([accuracy, roc_auc, accuracy / 2, dropout]) AS acc, unnest([roc_auc, accuracy, dropout, roc_auc / 2]) AS auc FROM runs), p AS (
  SELECT model, "window", scale, round(avg(acc), 6) AS acc_mean, round(avg(auc), 6) AS auc_mean, round(stddev_samp(acc), 6) AS acc_sd FROM l GROUP BY ALL), g AS (
  SELECT model, "window", round(avg(roc_auc), 6) AS train_acc, round(avg(dropout), 6) AS val_acc, round(avg(roc_auc) - avg(accuracy), 6) AS train_test_gap, round(avg(batch_size), 6) AS best_epoch FROM runs GROUP BY ALL)
  SELECT * FROM p JOIN g USING (model, "window")""")
def _(spark, sf):
    c = runs(spark, sf).selectExpr(
        "*", "roc_auc as acc_5s", "accuracy as auc_5s", "accuracy / 2 as acc_10s", "dropout as auc_10s", "dropout as acc_30s",
        "roc_auc / 2 as auc_30s", "roc_auc as train_acc", "dropout as val_acc", "batch_size as best_epoch",
    )
    out = ev.window_comparison(c)
    return r6(out, *[c for c in out.columns if c not in ("model", "window", "scale")])


@query("d60_fold_agreement", "WITH" + CV + """, p AS (SELECT a.held_out, a.roc_auc AS x, b.roc_auc AS y, rank() OVER (ORDER BY a.roc_auc) AS ra, rank() OVER (ORDER BY b.roc_auc) AS rb,
    row_number() OVER (ORDER BY a.roc_auc, held_out) AS la, row_number() OVER (ORDER BY b.roc_auc, held_out) AS lb FROM cva a JOIN cvb b USING (held_out))
  SELECT count(*) AS folds, round(corr(x, y), 5) AS pearson, round(corr(ra, rb), 5) AS spearman, count(*) FILTER (la <= 3 AND lb <= 3) AS shared_weakest, count(*) FILTER (y > x) AS b_better, round(avg(abs(y - x)), 6) AS mean_abs_diff FROM p""")
def _(spark, sf):
    out = ev.fold_agreement(cv(spark, sf), cv(spark, sf, "proba_raw"))
    return r6(r6(out, "pearson", "spearman", d=5), "mean_abs_diff")


# ── thresholds ──────────────────────────────────────────────────────────────


@query("g10_subject_threshold", "WITH" + OOF + """, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY t_center_ms, _ord) - 1 AS rn, count(*) OVER (PARTITION BY session_id) AS n FROM oof), h AS (
  SELECT session_id, person_id, CASE WHEN rn < n // 3 THEN 'calib' ELSE 'eval' END AS part, i, round(0.05 + 0.01 * i, 2)::DOUBLE AS thr,
    sum(CASE WHEN proba_raw >= round(0.05 + 0.01 * i, 2)::DOUBLE AND label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN proba_raw >= round(0.05 + 0.01 * i, 2)::DOUBLE AND label = 0 THEN 1 ELSE 0 END) AS fp,
    sum(label) AS p, sum(1 - label) AS q FROM n CROSS JOIN (SELECT unnest(range(91)) AS i) GROUP BY ALL), f AS (
  SELECT *, CASE WHEN tp + fp + p = 0 THEN 0.0 ELSE 2.0 * tp / (tp + fp + p) END AS f1, (tp + q - fp) / (p + q) AS acc FROM h), b AS (
  SELECT session_id, part, thr AS best FROM f QUALIFY row_number() OVER (PARTITION BY session_id, part ORDER BY round(f1, 9) DESC, round(abs(thr - 0.5), 4), i) = 1)
  SELECT f.session_id, f.person_id, c.best AS threshold_subj, e.best AS threshold_oracle, round(max(acc) FILTER (thr = 0.5), 4)::DOUBLE AS acc_base, round(max(acc) FILTER (thr = c.best), 4)::DOUBLE AS acc_subj,
    round(max(acc) FILTER (thr = e.best), 4)::DOUBLE AS acc_oracle, round(max(f1) FILTER (thr = 0.5), 4)::DOUBLE AS f1_base, round(max(f1) FILTER (thr = c.best), 4)::DOUBLE AS f1_subj, round(max(f1) FILTER (thr = e.best), 4)::DOUBLE AS f1_oracle
  FROM f JOIN b c ON c.session_id = f.session_id AND c.part = 'calib' JOIN b e ON e.session_id = f.session_id AND e.part = 'eval' WHERE f.part = 'eval' GROUP BY ALL""")
def _(spark, sf):
    out = ev.per_subject_threshold(oof(spark, sf), width=WIDTH)
    return r6(out, *[c for c in out.columns if c.startswith(("acc_", "f1_"))], d=4)


@query("g9_fusion", "WITH" + OOF + """, f AS (SELECT l.label, l.person_id, (l.proba_cal + r.proba_raw) / 2 AS p FROM oof l JOIN oof r ON r.session_id = l.session_id AND r._ord % 2 = 1 WHERE l._ord % 2 = 0
  QUALIFY row_number() OVER (PARTITION BY l._ord ORDER BY abs(r.ts - l.ts), r.ts, r._ord) = 1)
  SELECT person_id, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(CASE WHEN (p >= 0.5) = (label = 1) THEN 1 ELSE 0 END), 6) AS accuracy FROM f GROUP BY 1""")
def _(spark, sf):
    from ..kernels import nearest_asof

    o = oof(spark, sf)
    pair = nearest_asof(
        o.filter("_ord % 2 = 0"), o.filter("_ord % 2 = 1").select("session_id", "ts", "_ord", "proba_raw"), ["session_id"], "ts", "_ord",
        ["proba_raw"], width=WIDTH, drop_unmatched=True,
    ).withColumn("p", F.expr("(proba_cal + r_proba_raw) / 2"))
    out = ev.confusion(pair, ["person_id"], "p").select("person_id", "n", "accuracy").join(
        pair.groupBy("person_id").agg(F.avg("p").alias("mean_p")), "person_id"
    )
    return r6(out, "accuracy", "mean_p")


# ── HMM ─────────────────────────────────────────────────────────────────────

COUNTS = OOF + """, sq AS (SELECT *, row_number() OVER w AS rn, count(*) OVER (PARTITION BY session_id) AS n, lead(label) OVER w AS nx FROM oof WINDOW w AS (PARTITION BY session_id ORDER BY t_center_ms, _ord)), cnt AS (
  SELECT person_id, """ + ", ".join(f"count(*) FILTER (label = {i} AND nx = {j}) AS c{i}{j}" for i in (0, 1) for j in (0, 1)) + """, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM sq GROUP BY 1), oth AS (
  SELECT h.person_id, """ + ", ".join(f"sum(t.{c}) AS {c}" for c in ("c00", "c01", "c10", "c11", "n0", "n1")) + """ FROM cnt h JOIN cnt t ON t.person_id <> h.person_id GROUP BY 1), par AS (
  SELECT person_id, """ + ", ".join(f"(c{i}{j} + 1.0::DOUBLE) / (c{i}0 + c{i}1 + 2) AS a{i}{j}" for i in (0, 1) for j in (0, 1)) + ", (n0 + 1.0::DOUBLE) / (n0 + n1 + 2) AS pi0, (n1 + 1.0::DOUBLE) / (n0 + n1 + 2) AS pi1 FROM oth)"


@query("e22_transition_matrix", "WITH" + COUNTS + " SELECT person_id, " + ", ".join(f"round({a}, 8) AS {a}" for a in ("a00", "a01", "a10", "a11")) + " FROM par")
def _(spark, sf):
    p = hmm.parameters(hmm.leave_one_out(hmm.transition_counts(oof(spark, sf), ["person_id"], width=WIDTH)))
    return r6(p.drop("pi0", "pi1"), "a00", "a01", "a10", "a11", d=8)


@query("e23_class_priors", "WITH" + COUNTS + " SELECT person_id, round(pi0, 8) AS pi0, round(pi1, 8) AS pi1 FROM par")
def _(spark, sf):
    p = hmm.parameters(hmm.leave_one_out(hmm.transition_counts(oof(spark, sf), ["person_id"], width=WIDTH)))
    return r6(p.select("person_id", "pi0", "pi1"), "pi0", "pi1", d=8)


def observed(spark, sf):
    from ..kernels import attach

    o = oof(spark, sf)
    return attach(o, hmm.parameters(hmm.leave_one_out(hmm.transition_counts(o, ["person_id"], width=WIDTH))), ["person_id"])


EMIT = COUNTS + """, em AS (SELECT s.session_id, s._ord, s.rn, s.n, p.*, (1 - least(greatest(proba_cal, 0.001), 0.999)) / pi0 AS b0, least(greatest(proba_cal, 0.001), 0.999) / pi1 AS b1 FROM sq s JOIN par p USING (person_id))"""


@query("e24_scaled_likelihoods", "WITH" + EMIT + " SELECT _ord, round(b0, 6) AS b0, round(b1, 6) AS b1 FROM em")
def _(spark, sf):
    return r6(hmm.likelihoods(observed(spark, sf), "proba_cal").select("_ord", "b0", "b1"), "b0", "b1")


FWD = EMIT + """, fw AS (WITH RECURSIVE f AS (SELECT session_id, _ord, rn, pi0 * b0 / (pi0 * b0 + pi1 * b1) AS x0, pi1 * b1 / (pi0 * b0 + pi1 * b1) AS x1 FROM em WHERE rn = 1 UNION ALL
  SELECT e.session_id, e._ord, e.rn, (a00 * x0 + a10 * x1) * b0 / ((a00 * x0 + a10 * x1) * b0 + (a01 * x0 + a11 * x1) * b1), (a01 * x0 + a11 * x1) * b1 / ((a00 * x0 + a10 * x1) * b0 + (a01 * x0 + a11 * x1) * b1)
  FROM f JOIN em e ON e.session_id = f.session_id AND e.rn = f.rn + 1) SELECT * FROM f)"""


@query("e25_hmm_filter", "WITH" + FWD + " SELECT _ord, round(x1, 6) AS filtered FROM fw")
def _(spark, sf):
    return r6(hmm.decode(observed(spark, sf), "proba_cal", width=WIDTH).select("_ord", "filtered"), "filtered")


@query("e26_hmm_smoother", "WITH" + FWD + """, bw AS (WITH RECURSIVE g AS (SELECT session_id, _ord, rn, 1.0::DOUBLE AS y0, 1.0::DOUBLE AS y1 FROM em WHERE rn = n UNION ALL
  SELECT p.session_id, p._ord, p.rn, (e.a00 * e.b0 * y0 + e.a01 * e.b1 * y1) / ((e.a00 + e.a10) * e.b0 * y0 + (e.a01 + e.a11) * e.b1 * y1), (e.a10 * e.b0 * y0 + e.a11 * e.b1 * y1) / ((e.a00 + e.a10) * e.b0 * y0 + (e.a01 + e.a11) * e.b1 * y1)
  FROM g JOIN em e ON e.session_id = g.session_id AND e.rn = g.rn JOIN em p ON p.session_id = g.session_id AND p.rn = g.rn - 1) SELECT * FROM g)
  SELECT fw._ord, round(x1 * y1 / (x0 * y0 + x1 * y1), 6) AS smoothed FROM fw JOIN bw USING (_ord)""")
def _(spark, sf):
    return r6(hmm.decode(observed(spark, sf), "proba_cal", width=WIDTH).select("_ord", "smoothed"), "smoothed")


@query("e27_viterbi", "WITH" + EMIT + """, vt AS (WITH RECURSIVE v AS (SELECT session_id, _ord, rn, n, ln(pi0) + ln(b0) AS d0, ln(pi1) + ln(b1) AS d1, 0 AS k0, 0 AS k1 FROM em WHERE rn = 1 UNION ALL
  SELECT e.session_id, e._ord, e.rn, e.n, greatest(d0 + ln(a00), d1 + ln(a10)) + ln(b0), greatest(d0 + ln(a01), d1 + ln(a11)) + ln(b1), CASE WHEN d1 + ln(a10) > d0 + ln(a00) THEN 1 ELSE 0 END, CASE WHEN d1 + ln(a11) > d0 + ln(a01) THEN 1 ELSE 0 END
  FROM v JOIN em e ON e.session_id = v.session_id AND e.rn = v.rn + 1) SELECT * FROM v), pt AS (WITH RECURSIVE p AS (SELECT session_id, _ord, rn, CASE WHEN d1 > d0 THEN 1 ELSE 0 END AS s FROM vt WHERE rn = n UNION ALL
  SELECT q.session_id, q._ord, q.rn, CASE WHEN p.s = 0 THEN c.k0 ELSE c.k1 END FROM p JOIN vt c ON c.session_id = p.session_id AND c.rn = p.rn JOIN vt q ON q.session_id = p.session_id AND q.rn = p.rn - 1) SELECT * FROM p)
  SELECT _ord, s AS viterbi FROM pt""")
def _(spark, sf):
    return hmm.decode(observed(spark, sf), "proba_cal", width=WIDTH).select("_ord", "viterbi")


@query("e28_leak_free_evaluation")
def _(spark, sf):
    return hmm.leak_free_evaluation(oof(spark, sf), width=WIDTH)


@query("e29_dwell", "WITH" + COUNTS + " SELECT person_id, round(0.5 * (1 / (1 - a00) + 1 / (1 - a11)) * 0.5, 6) AS memory_sec FROM par")
def _(spark, sf):
    p = hmm.parameters(hmm.leave_one_out(hmm.transition_counts(oof(spark, sf), ["person_id"], width=WIDTH)))
    return r6(hmm.dwell(p).select("person_id", "memory_sec"), "memory_sec")
