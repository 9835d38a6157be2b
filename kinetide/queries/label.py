"""As-of and interval joins, label closing, alignment and motion peaks."""

from pyspark.sql import functions as F

from ..kernels import nearest_asof, quantiles
from ..operators import align
from ..operators import clean
from ..operators import label as lab
from ..operators import strokes as st
from ..plans.merge import merge_sessions
from ..schema import IMU
from ..schema import PEN as PEN_LAYOUT
from ..schema import WATCH as WATCH_LAYOUT
from ..session import fresh_path
from ..sources import scans
from .data import DAY, HOUR, OOF, PEN, SAMPLES, WATCH, WIDTH, markers, oof, pen, rnd, samples, watch
from .quality import BLOCKS, QP, TIMELINE, q_pen
from .registry import query

TOL = 2 * HOUR

# ── C: joins ────────────────────────────────────────────────────────────────


def sides(spark, sf):
    s = samples(spark, sf)
    return s.filter("event_type <> 'click'"), s.filter("event_type = 'click'")


NEAREST = SAMPLES + """, near AS (
  SELECT l._ord, l.session_id, l.ts, l.v AS lv, r.ts AS r_ts, r.v AS r_v, r._ord AS r_ord, abs(r.ts - l.ts) AS delta
  FROM samples l LEFT JOIN samples r ON r.session_id = l.session_id AND r.event_type = 'click' WHERE l.event_type <> 'click'
  QUALIFY row_number() OVER (PARTITION BY l._ord ORDER BY abs(r.ts - l.ts), r.ts, CASE WHEN r.ts <= l.ts THEN -r._ord ELSE r._ord END) = 1)"""


@query("c1_nearest_asof", "WITH" + NEAREST + f"""
  SELECT _ord, session_id, CASE WHEN delta <= {TOL} THEN r_ts END::DOUBLE AS r_ts, CASE WHEN delta <= {TOL} THEN r_v END AS r_v,
         CASE WHEN delta <= {TOL} THEN 1 ELSE 0 END AS label_writing FROM near""")
def _(spark, sf):
    l, r = sides(spark, sf)
    out = nearest_asof(l.select("_ord", "session_id", "ts"), r, ["session_id"], "ts", "_ord", ["v"], width=WIDTH, tolerance=TOL)
    return out.selectExpr("_ord", "session_id", "cast(r_ts as double) as r_ts", "r_v", "cast(r_ts is not null as int) as label_writing")


@query("c1_label_join", "WITH" + PEN + f""", w AS (SELECT * FROM samples WHERE event_type IN ('view','purchase')), n AS (
  SELECT w._ord, CASE WHEN p.dot_type IN ('PEN_DOWN','PEN_MOVE') THEN 1 ELSE 0 END AS writing, abs(p.ts - w.ts) AS d
  FROM w LEFT JOIN pen p ON p.session_id = w.session_id AND p.dot_type <> 'PEN_HOVER' AND p._ord % 2 = 1
  QUALIFY row_number() OVER (PARTITION BY w._ord ORDER BY abs(p.ts - w.ts), p.ts, p._ord) = 1)
  SELECT _ord, CASE WHEN d <= {TOL} THEN writing ELSE 0 END AS label_writing FROM n""")
def _(spark, sf):
    w = samples(spark, sf).filter("event_type in ('view', 'purchase')")
    p = pen(spark, sf).filter("dot_type <> 'PEN_HOVER' and _ord % 2 = 1")
    return lab.label_samples(w, p, tolerance=TOL, width=WIDTH).select("_ord", "label_writing")


@query("c2_pair_predictions", "WITH" + OOF + """
  SELECT l._ord, r.proba_cal AS r_proba_cal, abs(r.ts - l.ts) AS delta
  FROM oof l JOIN oof r ON r.session_id = l.session_id AND r._ord % 3 = 0 WHERE l._ord % 3 <> 0
  QUALIFY row_number() OVER (PARTITION BY l._ord ORDER BY abs(r.ts - l.ts), r.ts, r._ord) = 1""")
def _(spark, sf):
    o = oof(spark, sf)
    out = nearest_asof(
        o.filter("_ord % 3 <> 0").select("_ord", "session_id", "ts"), o.filter("_ord % 3 = 0"), ["session_id"], "ts", "_ord",
        ["proba_cal"], width=WIDTH, drop_unmatched=True,
    )
    return out.select("_ord", "r_proba_cal", "delta")


@query("c3_nearest_distance", "WITH" + NEAREST + f"""
  SELECT session_id, round(quantile_cont(delta, 0.5), 3) AS p50, round(quantile_cont(delta, 0.9), 3) AS p90,
         round(quantile_cont(delta, 0.99), 3) AS p99, round(avg(CASE WHEN delta <= {TOL} THEN 1.0 ELSE 0.0 END), 6) AS within_share
  FROM near GROUP BY 1""")
def _(spark, sf):
    l, r = sides(spark, sf)
    near = nearest_asof(l.select("_ord", "session_id", "ts"), r, ["session_id"], "ts", "_ord", [], width=WIDTH)
    q = quantiles(near, ["session_id"], "delta", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    s = near.groupBy("session_id").agg(rnd(F.avg(F.expr(f"coalesce(cast(delta <= {TOL} as int), 0)"))).alias("within_share"))
    return q.select("session_id", *[rnd(F.col(c), 3).alias(c) for c in ("p50", "p90", "p99")]).join(s, "session_id")


@query("c4_interval_join", "WITH" + TIMELINE + """
  SELECT s._ord, t.task_index::DOUBLE AS task_index, t.task_id, t.task_category FROM samples s LEFT JOIN timeline t ON t.session_id = s.session_id AND s.ts >= t.start_ms AND s.ts < t.end_ms
  QUALIFY row_number() OVER (PARTITION BY s._ord ORDER BY t.start_ms DESC NULLS LAST) = 1""")
def _(spark, sf):
    out = lab.attach_tasks(samples(spark, sf).select("session_id", "_ord", "ts"), st.task_timeline(markers(spark, sf)), width=2 * DAY)
    return out.selectExpr("_ord", "cast(task_index as double) as task_index", "task_id", "task_category")


@query("c5_interval_inner", "WITH" + BLOCKS + """
  SELECT s._ord, b.task_id FROM samples s JOIN blocks b ON b.session_id = s.session_id AND s.ts >= b.start_ms AND s.ts < b.end_ms""")
def _(spark, sf):
    out = lab.attach_tasks(samples(spark, sf), st.marker_blocks(markers(spark, sf)), width=DAY, how="inner")
    return out.select("_ord", "task_id")


@query("b9_exclude_task_blocks", "WITH" + BLOCKS + """
  SELECT _ord FROM samples s WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.task_id = 'T1' AND b.session_id = s.session_id AND s.ts >= b.start_ms AND s.ts < b.end_ms)""")
def _(spark, sf):
    w = samples(spark, sf).withColumn("t_center_ms", F.col("ts"))
    return clean.exclude_task(w, st.marker_blocks(markers(spark, sf)), "T1", width=DAY).select("_ord")


@query("c6_interval_anti", "WITH" + TIMELINE + """
  SELECT _ord FROM samples s WHERE NOT EXISTS (SELECT 1 FROM timeline b WHERE b.session_id = s.session_id AND s.ts >= b.start_ms AND s.ts < b.end_ms)""")
def _(spark, sf):
    from ..kernels import interval_anti

    s = samples(spark, sf).select("session_id", "_ord", "ts")
    return interval_anti(s, st.task_timeline(markers(spark, sf)), ["session_id"], "ts", width=2 * DAY).select("_ord")


# ── E: label track ──────────────────────────────────────────────────────────

CLOSE = SAMPLES + """, rr AS (
  SELECT *, sum(c) OVER (PARTITION BY session_id ORDER BY ts, _ord) AS run FROM (
    SELECT *, CASE WHEN label <> lag(label) OVER (PARTITION BY session_id ORDER BY ts, _ord) THEN 1 ELSE 0 END AS c FROM samples)), ru AS (
  SELECT session_id, run, min(ts) AS t0, max(ts) AS t1, min(label) AS l, max(run) OVER (PARTITION BY session_id) AS last FROM rr GROUP BY session_id, run)"""


@query("e1_close_labels", "WITH" + CLOSE + f"""
  SELECT _ord, CASE WHEN ru.run > 0 AND ru.run < last AND ((l = 0 AND t1 - t0 <= {12 * HOUR}) OR (l = 1 AND t1 - t0 <= {HOUR})) THEN 1 - label ELSE label END AS label_closed
  FROM rr JOIN ru ON ru.session_id = rr.session_id AND ru.run = rr.run""")
def _(spark, sf):
    out = lab.close_labels(samples(spark, sf), max_gap_ms=12 * HOUR, max_spike_ms=HOUR, width=WIDTH)
    return out.select("_ord", "label_closed")


@query("e9_writing_segments", "WITH" + CLOSE + """, nx AS (SELECT *, lead(ts) OVER (PARTITION BY session_id ORDER BY ts, _ord) AS n FROM rr)
  SELECT session_id, min(ts) AS start_ms, coalesce(arg_max(n, ts) FILTER (n IS NOT NULL AND ts = tl), max(ts)) AS end_ms FROM (
    SELECT *, max(ts) OVER (PARTITION BY session_id, run) AS tl FROM nx) WHERE label = 1 GROUP BY session_id, run""")
def _(spark, sf):
    return lab.writing_segments(samples(spark, sf), width=WIDTH)


@query("d46_label_flips", "WITH" + PEN + f""", w AS (SELECT session_id, _ord, ts FROM samples WHERE event_type IN ('view','purchase')), o AS (SELECT unnest([-{HOUR}, 0, {HOUR}]) AS off), n AS (
  SELECT w.session_id, w._ord, off, CASE WHEN p.dot_type IN ('PEN_DOWN','PEN_MOVE') THEN 1 ELSE 0 END AS writing, abs(p.ts + off - w.ts) AS d
  FROM w CROSS JOIN o JOIN pen p ON p.session_id = w.session_id AND p._ord % 2 = 1
  QUALIFY row_number() OVER (PARTITION BY w._ord, off ORDER BY abs(p.ts + off - w.ts), p.ts, p._ord) = 1), l AS (
  SELECT session_id, _ord, max(CASE WHEN off < 0 AND d <= {TOL} THEN writing ELSE 0 END) AS lo, max(CASE WHEN off = 0 AND d <= {TOL} THEN writing ELSE 0 END) AS b,
         max(CASE WHEN off > 0 AND d <= {TOL} THEN writing ELSE 0 END) AS hi FROM n GROUP BY 1, 2)
  SELECT session_id, round((avg(CAST(lo <> b AS INT)) + avg(CAST(hi <> b AS INT))) * 50.0, 6) AS flip_pct FROM l GROUP BY 1""")
def _(spark, sf):
    w = samples(spark, sf).filter("event_type in ('view', 'purchase')")
    p = pen(spark, sf).filter("_ord % 2 = 1")
    out = lab.label_flips(w, p, shift_ms=HOUR, tolerance=TOL, width=WIDTH)
    return out.select("session_id", rnd(F.col("flip_pct")).alias("flip_pct"))


@query("d48_merge_quality", "WITH" + PEN + f""", w AS (SELECT session_id, _ord, ts FROM samples WHERE event_type IN ('view','purchase')), n AS (
  SELECT w.session_id, CASE WHEN p.dot_type IN ('PEN_DOWN','PEN_MOVE') THEN 1 ELSE 0 END AS writing, abs(p.ts - w.ts) AS d
  FROM w JOIN pen p ON p.session_id = w.session_id AND p._ord % 2 = 1
  QUALIFY row_number() OVER (PARTITION BY w._ord ORDER BY abs(p.ts - w.ts), p.ts, p._ord) = 1)
  SELECT n.session_id, count(*) AS samples, round(quantile_cont(d, 0.5), 3) AS dt_median, round(quantile_cont(d, 0.99), 3) AS dt_p99, max(d) AS dt_max,
         round(avg(CAST(d <= {TOL} AS INT)), 6) AS within_share, round(avg(CASE WHEN d <= {TOL} THEN writing ELSE 0 END), 6) AS merged_writing,
         round(min(r.rw), 6) AS raw_writing
  FROM n JOIN (SELECT session_id, avg(CASE WHEN dot_type IN ('PEN_DOWN','PEN_MOVE') THEN 1 ELSE 0 END) AS rw FROM pen WHERE _ord % 2 = 1 GROUP BY 1) r USING (session_id) GROUP BY 1""")
def _(spark, sf):
    w = samples(spark, sf).filter("event_type in ('view', 'purchase')").select("session_id", "_ord", "ts")
    out = lab.merge_quality(w, pen(spark, sf).filter("_ord % 2 = 1"), tolerance=TOL, width=WIDTH)
    return out.select(
        "session_id", "samples", *[rnd(F.col(c), 3).alias(c) for c in ("dt_median", "dt_p99")], "dt_max",
        *[rnd(F.col(c)).alias(c) for c in ("within_share", "merged_writing", "raw_writing")],
    )


@query("d49_stroke_density", "WITH" + QP + """, f AS (
  SELECT *, CASE WHEN dot_type IN ('PEN_DOWN','PEN_MOVE') THEN 1 ELSE 0 END AS w, ts - lag(ts) OVER o AS dt,
         lag(CASE WHEN dot_type IN ('PEN_DOWN','PEN_MOVE') THEN 1 ELSE 0 END) OVER o AS pw FROM qp WINDOW o AS (PARTITION BY session_id ORDER BY ts, _ord)), g AS (
  SELECT *, sum(CASE WHEN w = pw THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY ts, _ord) AS run FROM f), r AS (
  SELECT session_id, max(ts) - min(ts) AS dur FROM g WHERE w = 1 GROUP BY session_id, run HAVING count(*) >= 2), s AS (
  SELECT session_id, round(avg(dt), 6) AS dt_mean, max(dt) AS dt_max, round(avg(CAST(dt > 30 AS INT)), 6) AS over_30_share, round(avg(CAST(dt > 50 AS INT)), 6) AS over_50_share,
         round(median(dt), 6)::DOUBLE AS dt_median, round(quantile_cont(dt, 0.9), 6)::DOUBLE AS dt_p90 FROM g WHERE w = 1 AND pw = 1 GROUP BY 1)
  SELECT d.*, s.* EXCLUDE (session_id) FROM (SELECT session_id, count(*) AS strokes, CAST(sum(dur) AS BIGINT) AS writing_ms, median(dur)::DOUBLE AS duration_median FROM r GROUP BY 1) d JOIN s USING (session_id)""")
def _(spark, sf):
    out = lab.stroke_density(q_pen(spark, sf)).drop("dt_p99")
    cols = ("dt_mean", "over_30_share", "over_50_share", "dt_median", "dt_p90")
    return out.select(*[rnd(F.col(c)).alias(c) if c in cols else F.col(c) for c in out.columns])


@query("i16_change_only", "WITH" + SAMPLES + """
  SELECT session_id, count(*) AS n, CAST(sum(_ord) AS BIGINT) AS s FROM (
    SELECT *, lag(event_type) OVER (PARTITION BY session_id ORDER BY _ord) AS prev FROM samples) WHERE prev IS NULL OR prev <> event_type GROUP BY 1""")
def _(spark, sf):
    out = lab.change_only(samples(spark, sf), ["event_type"])
    return out.groupBy("session_id").agg(F.count("*").alias("n"), F.sum("_ord").alias("s"))


# ── alignment: one log minute stands for one millisecond, persons for sessions ──


def a_watch(spark, sf):
    return watch(spark, sf).selectExpr(
        "person_id as session_id", "_ord", "ts div 60000 as ts", "local_ts div 60000 as local_ts", "ax", "ay", "az",
        "sqrt(rx*rx + ry*ry + rz*rz) + 0.35D * sqrt(ax*ax + ay*ay + az*az) as motion_mag",
    )


def a_pen(spark, sf):
    return pen(spark, sf).filter("_ord % 3 <> 0").selectExpr(
        "person_id as session_id", "_ord", "dot_type", "x", "y", "ts div 60000 + 40 as ts", "local_ts div 60000 + 45 as local_ts"
    )


A_OPTS = dict(width=5000)
ALIGN = WATCH + PEN.replace(SAMPLES, "") + """, aw AS (
  SELECT person_id AS session_id, _ord, ts // 60000 AS ts, local_ts // 60000 AS local_ts, ax, ay, az,
         sqrt(rx*rx + ry*ry + rz*rz) + 0.35 * sqrt(ax*ax + ay*ay + az*az) AS motion_mag FROM watch), ap AS (
  SELECT person_id AS session_id, _ord, dot_type, x, y, ts // 60000 + 40 AS ts, local_ts // 60000 + 45 AS local_ts FROM pen WHERE _ord % 3 <> 0), ar AS (
  SELECT *, row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY session_id) AS n, ts - lag(ts) OVER w AS dt FROM aw
  WINDOW w AS (PARTITION BY session_id ORDER BY ts, _ord)), rate AS (
  SELECT session_id, 1000.0::DOUBLE / median(dt) AS fs, greatest(2, CAST(trunc(0.2::DOUBLE * (1000.0::DOUBLE / median(dt))) AS INT)) AS w, median(sqrt(ax*ax + ay*ay + az*az)) AS g
  FROM ar GROUP BY 1), av AS (
  SELECT ar.session_id, rn, ts, n, fs, CASE WHEN count(*) OVER f = w THEN sqrt(var_samp(ax) OVER f ** 2 + var_samp(ay) OVER f ** 2 + var_samp(az) OVER f ** 2) / g ELSE 0 END AS v,
         CASE WHEN count(*) OVER f = w THEN stddev_samp(sqrt(ax*ax + ay*ay + az*az)) OVER f END AS sd
  FROM ar JOIN rate USING (session_id)
  WINDOW f AS (PARTITION BY ar.session_id ORDER BY rn ROWS BETWEEN (w // 2) PRECEDING AND ((w - 1) // 2) FOLLOWING)), sp AS (
  SELECT session_id, sid, min(ts) AS s, max(ts) AS e FROM (
    SELECT *, sum(CASE WHEN dot_type = 'PEN_DOWN' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY _ord) AS sid FROM ap
    WHERE dot_type IN ('PEN_DOWN','PEN_UP') OR (dot_type = 'PEN_MOVE' AND x <> -1 AND y <> -1)) WHERE sid > 0 GROUP BY 1, 2), mk AS (
  SELECT DISTINCT av.session_id, av.rn FROM av JOIN sp ON sp.session_id = av.session_id AND av.ts BETWEEN sp.s AND sp.e), cg AS (
  SELECT session_id, i, -20.0::DOUBLE + i * 0.5 AS delta, CAST(round_even((-20.0::DOUBLE + i * 0.5) * fs, 0) AS BIGINT) AS d
  FROM rate, (SELECT unnest(range(80)) AS i)), cd AS (
  SELECT g.session_id, g.d, avg(av.v) AS val FROM (SELECT DISTINCT session_id, d FROM cg) g JOIN mk ON mk.session_id = g.session_id
  JOIN av ON av.session_id = g.session_id AND av.rn = mk.rn + g.d GROUP BY 1, 2), cb AS (
  SELECT cg.session_id, cg.delta AS coarse FROM cg JOIN cd ON cd.session_id = cg.session_id AND cd.d = cg.d
  QUALIFY row_number() OVER (PARTITION BY cg.session_id ORDER BY val, i) = 1), fg AS (
  SELECT session_id, i, coarse, coarse - 5.0 + i * 0.01::DOUBLE AS delta, CAST(round_even((coarse - 5.0 + i * 0.01::DOUBLE) * fs, 0) AS BIGINT) AS d
  FROM cb JOIN rate USING (session_id), (SELECT unnest(range(1000)) AS i)), fd AS (
  SELECT g.session_id, g.d, avg(av.v) AS val FROM (SELECT DISTINCT session_id, d FROM fg) g JOIN mk ON mk.session_id = g.session_id
  JOIN av ON av.session_id = g.session_id AND av.rn = mk.rn + g.d GROUP BY 1, 2), curve AS (
  SELECT fg.session_id, i, fg.delta, coarse, val FROM fg LEFT JOIN fd ON fd.session_id = fg.session_id AND fd.d = fg.d), est AS (
  SELECT session_id, arg_min(delta, (val, i)) FILTER (val IS NOT NULL) AS delta_sec, min(val) AS mn, avg(val) AS mean, stddev_samp(val) AS sd, min(coarse) AS coarse_sec FROM curve GROUP BY 1)"""


@query("c9_offset_search", "WITH" + ALIGN + """
  SELECT session_id, round(delta_sec, 4) AS delta_sec, round(coarse_sec, 4) AS coarse_sec, round(mn, 6) AS min_variance, round(mean, 6) AS mean_variance,
         round((mn - mean) / sd, 4) AS sigma, (mn - mean) / sd <= -2 AS applied FROM est""")
def _(spark, sf):
    out = align.offset_search(a_watch(spark, sf), a_pen(spark, sf), **A_OPTS)
    return out.select(
        "session_id", *[rnd(F.col(c), d).alias(c) for c, d in (
            ("delta_sec", 4), ("coarse_sec", 4), ("min_variance", 6), ("mean_variance", 6), ("sigma", 4))], "applied",
    )


@query("a2_merge_from_csv", "WITH" + ALIGN + """, mw AS (
  SELECT person_id AS session_id, _ord, ts // 60000 AS ts, ax, ay, az, rx, ry, rz FROM watch
  QUALIFY row_number() OVER (PARTITION BY person_id, ts // 60000, ax, ay, az, rx, ry, rz ORDER BY _ord) = 1), off AS (
  SELECT session_id, CASE WHEN (mn - mean) / sd <= -2 THEN delta_sec ELSE 0 END AS d FROM est), pw AS (
  SELECT ap.session_id, ap._ord, ap.ts + coalesce(d, 0) * 1000.0::DOUBLE AS t, ap.dot_type IN ('PEN_DOWN', 'PEN_MOVE') AS writing FROM ap LEFT JOIN off USING (session_id)), near AS (
  SELECT m.*, CASE WHEN abs(t - ts) <= 40 AND writing THEN 1 ELSE 0 END AS label_writing FROM mw m LEFT JOIN pw p ON p.session_id = m.session_id
  QUALIFY row_number() OVER (PARTITION BY m._ord ORDER BY abs(t - ts), t, CASE WHEN t <= ts THEN -p._ord ELSE p._ord END) = 1)
  SELECT CAST(n.session_id AS VARCHAR) AS session_id, ts, round(ax, 6) AS ax, round(rz, 6) AS rz, label_writing, round(coalesce(d, 0), 2)::DOUBLE AS pen_offset_s FROM near n LEFT JOIN off USING (session_id)""")
def _(spark, sf):
    """Raw files of both streams, one per session, merged and labelled from end to end."""
    root = fresh_path(spark, "merge")
    file = F.concat(F.lit("S"), F.col("session_id").cast("string"))
    w = watch(spark, sf).selectExpr("person_id as session_id", "_ord", "ts div 60000 as ts", "local_ts div 60000 as local_ts_ms", *IMU)
    p = a_pen(spark, sf).selectExpr("session_id", "_ord", "ts as local_ts_ms", "ts - 7 as timestamp", "dot_type", "x", "y")
    for df, layout, d in ((w, WATCH_LAYOUT, "watch"), (p, PEN_LAYOUT, "pen")):
        cols = [F.col(f.name).cast("string") if f.name in df.columns else F.lit("").alias(f.name) for f in layout]
        df.withColumn("file", file).repartition("file").sortWithinPartitions("file", "_ord").select("file", *cols).write.partitionBy("file").option("header", True).csv(f"{root}/{d}")
    named = lambda d, layout: scans.read_stream_csv(spark, f"{root}/{d}/*/*.csv", layout).withColumn("session_id", F.regexp_extract("_file", r"file=S(\d+)/", 1))
    out = merge_sessions(scans.coerce_watch(named("watch", WATCH_LAYOUT)), scans.coerce_pen(named("pen", PEN_LAYOUT)), width=5000)
    return out.select("session_id", "ts", rnd(F.col("ax")).alias("ax"), rnd(F.col("rz")).alias("rz"), "label_writing", rnd(F.col("pen_offset_s"), 2).alias("pen_offset_s"))


@query("e30_rolling_variance", "WITH" + ALIGN + " SELECT session_id, rn, round(v, 6) AS v, round(sd, 6) AS motion_sd FROM av")
def _(spark, sf):
    v = align.motion_variance(a_watch(spark, sf), **A_OPTS)
    return v.select("session_id", "rn", rnd(F.col("v")).alias("v"), rnd(F.col("motion_sd")).alias("motion_sd"))


THIN = """, ks AS (SELECT unnest(range({p})) AS k), pick AS (
  SELECT DISTINCT session_id, CASE WHEN n <= {p} THEN NULL ELSE CAST(floor(k * ((n - 1) / {q}.0::DOUBLE)) AS BIGINT) END AS rn FROM (SELECT DISTINCT session_id, n FROM av), ks)"""


@query("e31_thinned_timeline", "WITH" + ALIGN + THIN.format(p=100, q=99) + """
  SELECT session_id, rn, round((ts - min(ts) OVER (PARTITION BY session_id)) / 1000.0, 6)::DOUBLE AS rel_s, round(sd, 6) AS motion_sd FROM av
  QUALIFY n <= 100 OR (session_id, rn) IN (SELECT (session_id, rn) FROM pick)""")
def _(spark, sf):
    t = align.diagnostic_timeline(align.motion_variance(a_watch(spark, sf), **A_OPTS), 100)
    return t.select("session_id", "rn", rnd(F.col("rel_s")).alias("rel_s"), rnd(F.col("motion_sd")).alias("motion_sd"))


@query("e32_alignment_curve", "WITH" + ALIGN + """, kv AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY i) - 1 AS rn, count(*) OVER (PARTITION BY session_id) AS n
    FROM curve WHERE val IS NOT NULL), ks AS (SELECT unnest(range(200)) AS k), pick AS (
  SELECT DISTINCT session_id, CAST(floor(k * ((n - 1) / 199.0::DOUBLE)) AS BIGINT) AS rn FROM (SELECT DISTINCT session_id, n FROM kv), ks)
  SELECT session_id, round(delta, 4) AS delta_sec, round(val, 6) AS value FROM kv
  WHERE n <= 200 OR (session_id, rn) IN (SELECT (session_id, rn) FROM pick)""")
def _(spark, sf):
    from pyspark.sql import Window

    curve = align.offset_search(a_watch(spark, sf), a_pen(spark, sf), keep_curve=True, **A_OPTS).filter("value is not null")
    w = Window.partitionBy("session_id")  # at most 1000 grid points
    rows = curve.withColumn("rn", F.row_number().over(w.orderBy("i")) - 1).withColumn("n", F.count("*").over(w))
    out = align.thin(rows, ["session_id"], "rn", "n", 200)
    return out.select("session_id", rnd(F.col("delta_sec"), 4).alias("delta_sec"), rnd(F.col("value")).alias("value"))


def halved(sql: str) -> str:
    """The alignment tables per half of a session: id * 10 + half."""
    middle = "mid AS (SELECT person_id AS pid, (min(local_ts // 60000) + max(local_ts // 60000)) / 2.0 AS mid FROM watch GROUP BY 1), aw AS ("
    for table, at in (("watch", "local_ts // 60000"), ("pen", "ts // 60000 + 40")):
        own = f"person_id * 10 + CASE WHEN {at} < mid THEN 1 ELSE 2 END AS session_id"
        head, name, tail = sql.rpartition("SELECT person_id AS session_id, _ord, ts // 60000 AS ts, local_ts") if table == "watch" else sql.rpartition("SELECT person_id AS session_id, _ord, dot_type")
        sql = head + name.replace("person_id AS session_id", own) + tail.replace(f"FROM {table}", f"FROM {table} JOIN mid ON pid = person_id", 1)
    return sql.replace("aw AS (", middle, 1).replace("FROM ar GROUP BY 1), av", "FROM ar GROUP BY 1 HAVING count(*) >= 50), av", 1)


@query("d45_half_drift", "WITH" + halved(ALIGN) + """, n AS (SELECT session_id, count(*) AS strokes FROM sp GROUP BY 1)
  SELECT session_id // 10 AS session_id, round(max(delta_sec) FILTER (session_id % 10 = 1), 4) AS delta_1, round(max(delta_sec) FILTER (session_id % 10 = 2), 4) AS delta_2,
         CASE WHEN count(*) = 2 THEN min(strokes) ELSE 0 END AS min_strokes,
         round(abs(max(delta_sec) FILTER (session_id % 10 = 2) - max(delta_sec) FILTER (session_id % 10 = 1)) * 1000, 2) AS drift_ms FROM est JOIN n USING (session_id) GROUP BY 1""")
def _(spark, sf):
    out = align.half_drift(a_watch(spark, sf), a_pen(spark, sf), **A_OPTS)
    return out.select("session_id", *[rnd(F.col(c), d).alias(c) for c, d in (("delta_1", 4), ("delta_2", 4), ("drift_ms", 2))], "min_strokes")


PEAKS = ALIGN + """, lim AS (
  SELECT session_id, median(motion_mag) + greatest(0.015, 4 * mad(motion_mag)) AS lim FROM aw GROUP BY 1), cand AS (
  SELECT a.session_id, a.ts, a.motion_mag AS m, row_number() OVER (PARTITION BY a.session_id ORDER BY a.ts, a._ord) AS r FROM aw a JOIN lim USING (session_id) WHERE motion_mag >= lim), chain AS (
  WITH RECURSIVE c AS (SELECT session_id, r, ts, m, ts AS anchor, r AS grp FROM cand WHERE r = 1 UNION ALL
    SELECT x.session_id, x.r, x.ts, x.m, CASE WHEN x.ts - c.anchor < 250 THEN c.anchor ELSE x.ts END, CASE WHEN x.ts - c.anchor < 250 THEN c.grp ELSE x.r END
    FROM c JOIN cand x ON x.session_id = c.session_id AND x.r = c.r + 1) SELECT * FROM c), peaks AS (
  SELECT session_id, arg_min(ts, (-m, r)) AS ts, round(max(m), 6) AS motion_mag FROM chain GROUP BY session_id, grp)"""


@query("e12_motion_peaks", "WITH" + PEAKS + """
  SELECT * FROM peaks QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY motion_mag DESC, ts) <= 10""")
def _(spark, sf):
    return align.motion_peaks(a_watch(spark, sf), width=5000, top=10)


@query("c10_tap_matching")
def _(spark, sf):
    w, p = a_watch(spark, sf), a_pen(spark, sf)
    return align.tap_estimate(align.tap_matches(w, p, st.pen_intervals(p), width=5000), w)
