"""Scans, stores, the session index and cleaning."""

from pyspark.sql import functions as F

from ..operators import clean
from ..sources import index, scans, store
from ..session import fresh_path
from .data import (
    MARKERS, OOF, PEN, SAMPLES, WATCH, WIDTH, markers, oof, pen, rnd, samples, watch,
)
from .registry import query

# ── A: scans, sources, sinks ────────────────────────────────────────────────


def person_files(spark, sf):
    """One pen and one watch folder per person, named like session files."""
    root = fresh_path(spark, "raw")
    s = samples(spark, sf).withColumn("sid", F.format_string("S%03d", F.col("person_id")))
    pens = s.filter("person_id % 3 <> 0").withColumn("file", F.concat("sid", F.lit("_pen.csv")))
    watches = s.filter("person_id % 4 <> 0").withColumn("file", F.concat("sid", F.lit("_watch.csv")))
    cols = ["file", "ts", "v", "k", "event_type"]
    for df, d in ((pens, "pen"), (watches, "watch")):
        df.select(*cols).repartition("file").write.partitionBy("file").option("header", True).csv(f"{root}/{d}")
    return root


@query("a1_session_pairs", "WITH" + SAMPLES + """
  SELECT DISTINCT printf('S%03d', person_id) AS session_id FROM samples WHERE person_id % 3 <> 0 AND person_id % 4 <> 0""")
def _(spark, sf):
    root = person_files(spark, sf)
    return scans.discover_sessions(spark, f"{root}/pen/*/*.csv", f"{root}/watch/*/*.csv").select("session_id")


@query("a1_newest_session", "WITH" + SAMPLES + """
  SELECT max(printf('S%03d', person_id)) AS session_id FROM samples WHERE person_id % 3 <> 0 AND person_id % 4 <> 0""")
def _(spark, sf):
    root = person_files(spark, sf)
    pairs = scans.discover_sessions(spark, f"{root}/pen/*/*.csv", f"{root}/watch/*/*.csv")
    return scans.newest_session(pairs).select("session_id")


def raw_watch(spark, sf):
    """Samples as dirty text: blanks, garbage, integers written as floats."""
    w = watch(spark, sf)
    k = F.col("sequence")
    txt = lambda c: F.col(c).cast("string")
    return w.select(
        "session_id", "_ord",
        F.when(k % 11 == 0, "").otherwise(F.concat(txt("ts"), F.lit(".0"))).alias("ts"),
        F.when(k % 5 == 0, "n/a").otherwise(txt("local_ts")).alias("local_ts_ms"),
        F.lit(None).cast("string").alias("local_ts"),
        F.when(k % 7 == 0, "").otherwise(txt("local_ts")).alias("server_received_ms"),
        txt("sequence").alias("sequence"),
        F.when(k % 13 == 0, "bad").otherwise(txt("ax")).alias("ax"), txt("ay").alias("ay"), txt("az").alias("az"),
        txt("rx").alias("rx"), F.when(k % 6 == 0, " ").otherwise(txt("ry")).alias("ry"), txt("rz").alias("rz"),
    )


@query("a2_watch_scan", "WITH" + WATCH + """
  SELECT _ord, CASE WHEN sequence % 11 <> 0 THEN ts END::DOUBLE AS ts,
         CASE WHEN sequence % 5 <> 0 THEN local_ts WHEN sequence % 7 <> 0 THEN local_ts END::DOUBLE AS local_ts,
         round(CASE WHEN sequence % 13 <> 0 THEN sqrt(ax*ax + ay*ay + az*az) END, 6) AS acc_mag,
         round(CASE WHEN sequence % 6 <> 0 THEN sqrt(rx*rx + ry*ry + rz*rz) END, 6) AS gyro_mag,
         round(coalesce(CASE WHEN sequence % 6 <> 0 THEN sqrt(rx*rx + ry*ry + rz*rz) END, 0)
               + 0.35 * coalesce(CASE WHEN sequence % 13 <> 0 THEN sqrt(ax*ax + ay*ay + az*az) END, 0), 6) AS motion_mag,
         sequence % 13 <> 0 AS has_accel, sequence % 6 <> 0 AS has_gyro, false AS has_gravity, sequence % 7 <> 0 AS has_server_ms
  FROM watch""")
def _(spark, sf):
    d = scans.coerce_watch(raw_watch(spark, sf))
    return d.select(
        "_ord", F.col("ts").cast("double"), F.col("local_ts").cast("double"),
        *[rnd(F.col(c)).alias(c) for c in ("acc_mag", "gyro_mag", "motion_mag")],
        "has_accel", "has_gyro", "has_gravity", "has_server_ms",
    )


@query("a3_pen_scan", "WITH" + PEN + """
  SELECT _ord, ts, CASE WHEN _ord % 3 = 2 THEN NULL ELSE local_ts END::DOUBLE AS local_ts, dot_type,
         CASE WHEN _ord % 4 <> 0 THEN x END AS x, _ord % 3 = 0 AS has_local_ts_ms FROM pen""")
def _(spark, sf):
    p = pen(spark, sf)
    o = F.col("_ord")
    iso = F.date_format(F.timestamp_millis("local_ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    raw = p.select(
        "session_id", "_ord", F.col("ts").cast("string").alias("timestamp"),
        F.when(o % 3 == 0, F.col("local_ts").cast("string")).otherwise("").alias("local_ts_ms"),
        F.when(o % 3 == 1, iso).otherwise("garbage").alias("local_ts"), "dot_type",
        F.when(o % 4 == 0, "--").otherwise(F.col("x").cast("string")).alias("x"),
        F.col("y").cast("string").alias("y"), F.lit("12").alias("pressure"),
    )
    return scans.coerce_pen(raw).select(
        "_ord", "ts", F.col("local_ts").cast("double"), "dot_type", "x", "has_local_ts_ms"
    )


@query("a4_stream_summary", "WITH" + WATCH + """
  SELECT session_id, count(*) AS row_count, count(*) FILTER (sequence % 7 <> 0) AS server_time_rows,
         min(local_ts) FILTER (sequence % 7 <> 0) AS server_start_ms, max(local_ts) FILTER (sequence % 7 <> 0) AS server_end_ms
  FROM watch GROUP BY 1""")
def _(spark, sf):
    return scans.stream_summary(raw_watch(spark, sf))


@query("a5_evolving_append", "WITH" + SAMPLES + """
  SELECT session_id, count(*) AS n, count(*) FILTER (label = 1) AS with_k, round(sum(k) FILTER (label = 1), 6) AS sum_k
  FROM samples GROUP BY 1""")
def _(spark, sf):
    path = fresh_path(spark, "evolving")
    s = samples(spark, sf)
    store.append(s.filter("label = 0").select("session_id", "ts", "v"), path)
    store.append(s.filter("label = 1").select("session_id", "ts", "v", "k"), path)
    return store.read_evolved(spark, path).groupBy("session_id").agg(
        F.count("*").alias("n"), F.count("k").alias("with_k"), rnd(F.sum("k")).alias("sum_k")
    )


@query("a6_row_counts", "SELECT user_id AS session_id, count(*) AS rows FROM events GROUP BY 1")
def _(spark, sf):
    return scans.row_counts(samples(spark, sf))


@query("a7_last_rows", "WITH" + SAMPLES + """
  SELECT session_id, ts, event_type, v FROM samples
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, _ord DESC) = 1""")
def _(spark, sf):
    return scans.last_rows(samples(spark, sf), ["ts", "event_type", "v"])


@query("a8_recent_dots", "WITH" + PEN + """
  SELECT session_id, _ord, x, y FROM pen WHERE x <> -1 AND y <> -1 AND dot_type IN ('PEN_DOWN','PEN_MOVE','PEN_UP')
  QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY _ord DESC) <= 10""")
def _(spark, sf):
    return scans.recent_dots(pen(spark, sf), 10).select("session_id", "_ord", "x", "y")


def session_index(spark, sf):
    """One index row per user."""
    u = F.col("session_id")
    return samples(spark, sf).groupBy("session_id", "person_id").agg(
        F.count("*").alias("watch_samples"), F.min("ts").alias("start_ms"), F.max("ts").alias("end_ms"),
        F.min("_ord").alias("_ord"),
    ).select(
        "*", F.concat(F.lit("recording "), u.cast("string")).alias("description"),
        F.when(u % 5 == 0, "skip").when(u % 2 == 0, "trainable").otherwise("usable").alias("verdict"),
        F.when(u % 9 == 0, "test").when(u % 2 == 0, "study").otherwise("free").alias("study_mode"),
        F.lit("").alias("flagged"), F.lit("").alias("flag_note"), (u % 7).cast("int").alias("subject_index"),
        F.when(u % 3 == 0, "100hz_grav").when(u % 3 == 1, "50hz").otherwise("100hz").alias("watch_profile"),
        ((F.col("end_ms") - F.col("start_ms")) / 1000.0).alias("duration_seconds"),
    )


INDEX = SAMPLES + """, idx AS (
  SELECT session_id, person_id, count(*) AS watch_samples, min(ts) AS start_ms, max(ts) AS end_ms, min(_ord) AS _ord,
         'recording ' || session_id AS description,
         CASE WHEN session_id % 5 = 0 THEN 'skip' WHEN session_id % 2 = 0 THEN 'trainable' ELSE 'usable' END AS verdict,
         CASE WHEN session_id % 9 = 0 THEN 'test' WHEN session_id % 2 = 0 THEN 'study' ELSE 'free' END AS study_mode,
         '' AS flagged, '' AS flag_note, CAST(session_id % 7 AS INT) AS subject_index,
         CASE session_id % 3 WHEN 0 THEN '100hz_grav' WHEN 1 THEN '50hz' ELSE '100hz' END AS watch_profile,
         (max(ts) - min(ts)) / 1000.0::DOUBLE AS duration_seconds
  FROM samples GROUP BY session_id, person_id)"""


@query("a9_index_upsert", "WITH" + INDEX + """
  SELECT session_id, CASE WHEN session_id % 4 = 0 AND session_id % 8 <> 0 THEN 'skip' ELSE verdict END AS verdict,
         CASE WHEN session_id % 4 = 0 THEN watch_samples + 1000 ELSE watch_samples END AS watch_samples FROM idx""")
def _(spark, sf):
    i = session_index(spark, sf)
    up = i.filter("session_id % 4 = 0").selectExpr(
        "session_id", "if(session_id % 8 <> 0, 'skip', null) as verdict", "watch_samples + 1000 as watch_samples"
    )
    return index.upsert(i, up).select("session_id", "verdict", "watch_samples")


@query("a9_index_delete", "WITH" + INDEX + " SELECT session_id, person_id FROM idx WHERE session_id % 4 <> 0")
def _(spark, sf):
    i = session_index(spark, sf)
    return index.delete(i, i.filter("session_id % 4 = 0")).select("session_id", "person_id")


@query("a9_flag_and_mark_test", "WITH" + INDEX + """
  SELECT session_id, CASE WHEN session_id % 6 = 0 THEN 'yes' ELSE '' END AS flagged,
         CASE WHEN session_id % 6 = 0 THEN 'skip' ELSE verdict END AS verdict,
         CASE WHEN session_id % 10 = 1 THEN 'test' ELSE study_mode END AS study_mode,
         CASE WHEN session_id % 10 = 1 THEN '[TEST] ' ELSE '' END || description AS description,
         CASE WHEN session_id % 10 <> 1 THEN subject_index END::DOUBLE AS subject_index FROM idx""")
def _(spark, sf):
    i = session_index(spark, sf)
    out = index.flag(i, i.filter("session_id % 6 = 0").selectExpr("session_id", "' noisy ' as note"))
    out = index.mark_test(out, i.filter("session_id % 10 = 1"))
    return out.select(
        "session_id", "flagged", "verdict", "study_mode", "description", F.col("subject_index").cast("double")
    )


@query("a10_marker_append", "WITH" + MARKERS + """
  SELECT event, count(*) AS n, count(*) FILTER (event <> 'pause') AS with_task FROM markers GROUP BY 1""")
def _(spark, sf):
    path = fresh_path(spark, "markers")
    m = markers(spark, sf)
    store.append(m.filter("event <> 'pause'").drop("_ord"), path)
    store.append(store.with_layout(m.filter("event = 'pause'").select("session_id", "timestamp_ms", "event"), m.drop("_ord")), path)
    return spark.read.parquet(path).groupBy("event").agg(F.count("*").alias("n"), F.count("task_id").alias("with_task"))


@query("a12_windows_by_profile", "WITH" + SAMPLES + """, w AS (
  SELECT *, CASE CAST(k AS BIGINT) % 3 WHEN 0 THEN '50hz' WHEN 1 THEN '100hz' ELSE '100hz_grav' END AS profile
  FROM samples WHERE NOT (session_id % 3 = 0 AND CAST(k AS BIGINT) % 3 = 2)), b AS (
  SELECT session_id, min(CASE profile WHEN '100hz_grav' THEN 1 WHEN '100hz' THEN 2 ELSE 3 END) AS r FROM w GROUP BY 1)
  SELECT w.session_id, w.profile, count(*) AS n, round(sum(v), 4) AS sum_v FROM w JOIN b USING (session_id)
  WHERE CASE profile WHEN '100hz_grav' THEN 1 WHEN '100hz' THEN 2 ELSE 3 END = r GROUP BY ALL""")
def _(spark, sf):
    path = fresh_path(spark, "windows")
    w = samples(spark, sf).withColumn(
        "profile", F.expr("case cast(k as bigint) % 3 when 0 then '50hz' when 1 then '100hz' else '100hz_grav' end")
    ).filter("not (session_id % 3 = 0 and cast(k as bigint) % 3 = 2)")
    store.write_windows(w, path)
    kept = store.read_windows(spark.read.parquet(path))
    return kept.groupBy("session_id", "profile").agg(
        F.count("*").alias("n"), rnd(F.sum("v"), 4).alias("sum_v")
    )


@query("a13_param_store", "WITH" + SAMPLES + """
  SELECT session_id, count(*) AS n, min(version) AS version FROM (
    SELECT session_id, CASE WHEN session_id % 2 = 0 THEN 1 ELSE 2 END AS version FROM samples) GROUP BY 1""")
def _(spark, sf):
    path = fresh_path(spark, "param")
    s = samples(spark, sf)
    ids = s.select("session_id").distinct()
    make = lambda v: lambda todo: s.join(todo, "session_id", "left_semi").selectExpr(
        "session_id", "v", f"{v} as version", "k as tilt_change"
    )
    store.ensure_param_windows(spark, path, ids.filter("session_id % 2 = 0"), "legacy", (2.0, 1.0, 2500.0), make(1))
    out = store.ensure_param_windows(spark, path, ids, "legacy", (2.0, 1.0, 2500.0), make(2))
    assert "tilt_change" not in out.columns
    return out.groupBy("session_id").agg(F.count("*").alias("n"), F.min("version").alias("version"))


@query("a14_missing_views", "WITH" + INDEX + """, req AS (
  SELECT session_id, unnest(CASE watch_profile WHEN '100hz_grav' THEN ['100hz_grav','50hz'] ELSE ['50hz'] END) AS profile
  FROM idx WHERE study_mode <> 'test' AND session_id % 8 <> 3)
  SELECT session_id, profile FROM req WHERE NOT (session_id % 4 = 0 AND profile = '50hz')""")
def _(spark, sf):
    i = session_index(spark, sf)
    have = i.filter("session_id % 4 = 0").selectExpr("session_id", "'50hz' as profile")
    return store.missing_views(i, i.filter("session_id % 8 <> 3"), have)


@query("a15_flat_migration", "WITH" + WATCH + """, d AS (
  SELECT session_id, abs(ts // 1800000 - lag(ts // 1800000) OVER (PARTITION BY session_id ORDER BY _ord)) AS dt FROM watch), m AS (
  SELECT session_id, median(dt) AS m FROM d WHERE dt IS NOT NULL AND session_id % 3 <> 0 GROUP BY 1), p AS (
  SELECT session_id, CASE WHEN abs(1000.0 / m - n) / n <= 0.2 THEN CAST(CAST(n AS INT) AS VARCHAR) || 'hz_grav' END AS profile
  FROM (SELECT *, CASE WHEN abs(1000.0 / m - 50) <= abs(1000.0 / m - 100) THEN 50.0 ELSE 100.0 END AS n FROM m))
  SELECT profile, count(*) AS sessions FROM (SELECT DISTINCT session_id FROM watch) LEFT JOIN p USING (session_id) GROUP BY 1""")
def _(spark, sf):
    w = watch(spark, sf)
    slow = w.filter("session_id % 3 <> 0").withColumn("ts", F.floor(F.col("ts") / 1800000))
    flat = w.select("session_id").distinct()
    return store.rehome_flat(flat, slow).groupBy("profile").agg(F.count("*").alias("sessions"))


@query("a16_csv_output", "WITH" + OOF + """
  SELECT session_id, count(*) AS n, round(avg(proba_cal), 6) AS p FROM oof GROUP BY 1""")
def _(spark, sf):
    path = fresh_path(spark, "oof-csv")
    store.write_csv(oof(spark, sf).select("session_id", "t_center_ms", "proba_cal"), path)
    back = spark.read.schema("session_id long, t_center_ms long, proba_cal double").option("header", True).csv(path)
    return back.groupBy("session_id").agg(F.count("*").alias("n"), rnd(F.avg("proba_cal")).alias("p"))


@query("a17_cascade_delete", "WITH" + SAMPLES + """
  SELECT 'samples' AS tbl, count(*) AS n, count(DISTINCT session_id) AS sessions FROM samples WHERE session_id % 5 <> 2
  UNION ALL SELECT 'markers', count(*), count(DISTINCT session_id) FROM samples
  WHERE event_type IN ('signup','error','view') AND session_id % 5 <> 2""")
def _(spark, sf):
    gone = session_index(spark, sf).filter("session_id % 5 = 2")
    parts = []
    for name, t in (("samples", samples(spark, sf)), ("markers", markers(spark, sf))):
        left = store.without_sessions(t, gone)
        parts.append(left.agg(
            F.lit(name).alias("tbl"), F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions")
        ))
    return parts[0].unionByName(parts[1])


# ── B: projections, filters, cleaning ───────────────────────────────────────


@query("b1_numeric_coercion", """SELECT doc_id, count(*) AS words, count(TRY_CAST(w AS DOUBLE)) AS numbers, max(n_chars) AS n
  FROM (SELECT doc_id, n_chars, trim(unnest(string_split(text, ' '))) AS w FROM documents) WHERE regexp_matches(w, '^[-+]?[0-9]*[.]?[0-9]+$') OR NOT regexp_matches(w, '[0-9]') GROUP BY doc_id""")
def _(spark, sf):
    """Every word of each whole text that is plainly a number or has no digit, coerced; and the count of letters as text."""
    from .data import table

    d = table(spark, sf, "documents").selectExpr("doc_id", "concat(' ', cast(n_chars as string), '.0 ') as n", "explode(split(text, ' ')) as w").withColumn("w", F.trim("w"))
    d = d.filter("w rlike '^[-+]?[0-9]*[.]?[0-9]+$' or not w rlike '[0-9]'")
    out = clean.coerce_numeric(d, ["w", "n"])
    return out.groupBy("doc_id").agg(F.count("*").alias("words"), F.count("w").alias("numbers"), F.max("n").cast("bigint").alias("n"))


@query("b2_capture_clock", "WITH" + WATCH + """
  SELECT _ord, coalesce(CASE WHEN sequence % 4 <> 0 THEN ts END, CASE WHEN sequence % 3 <> 0 THEN local_ts END) AS _wall
  FROM watch WHERE NOT (sequence % 4 = 0 AND sequence % 3 = 0)""")
def _(spark, sf):
    w = watch(spark, sf).selectExpr(
        "_ord", "if(sequence % 4 <> 0, ts, null) as ts", "if(sequence % 3 <> 0, local_ts, null) as local_ts_ms"
    )
    return clean.capture_clock(w).select("_ord", "_wall")


@query("b3_replay_dedup", "WITH" + WATCH + """
  SELECT session_id, count(*) AS n, min(ts) AS first_ts, max(_ord) AS max_ord FROM watch GROUP BY 1""")
def _(spark, sf):
    w = watch(spark, sf)
    again = w.filter("sequence % 4 = 0").withColumn("_ord", F.col("_ord") + 10_000_000)
    return clean.drop_replays(w.unionByName(again)).groupBy("session_id").agg(
        F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("_ord").alias("max_ord")
    )


@query("b4_pen_kinematics", "WITH" + PEN + """, d AS (
  SELECT *, (ts - lag(ts) OVER w) / 1000.0::DOUBLE AS dt, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy
  FROM pen WHERE x <> -1 AND y <> -1 WINDOW w AS (PARTITION BY session_id ORDER BY ts, _ord))
  SELECT _ord, round(sqrt(dx*dx + dy*dy), 6) AS distance, round(sqrt(dx*dx + dy*dy) / dt, 9) AS speed,
         CASE WHEN dot_type IN ('PEN_DOWN','PEN_MOVE') THEN 1 ELSE 0 END AS label_writing
  FROM d WHERE dt IS NOT NULL AND dt <> 0""")
def _(spark, sf):
    d = clean.pen_kinematics(pen(spark, sf), width=WIDTH)
    return d.select("_ord", rnd(F.col("distance")).alias("distance"), rnd(F.col("speed"), 9).alias("speed"), "label_writing")


@query("b5_device_timeline", "WITH" + WATCH + """, h AS (
  SELECT session_id, arg_min(ts, _ord) AS t0, arg_min(local_ts, _ord) AS l0 FROM watch GROUP BY 1)
  SELECT _ord, ts - t0 + (l0 - (t0 // 86400000) * 86400000) AS device_time_ms FROM watch JOIN h USING (session_id)""")
def _(spark, sf):
    w = watch(spark, sf)
    anchor = w.groupBy("session_id").agg(F.expr("min_by(ts, _ord) div 86400000 * 86400000").alias("anchor_local_ms"))
    return clean.device_timeline(w.join(anchor, "session_id"), anchored=True).select("_ord", "device_time_ms")


FRAME = ("session_id", "person_id", "_ord", "ts", "event_type", "v", "k", "label", "p")
HOLED = {"k": "CASE WHEN k > 30 THEN k END", "v": "CASE WHEN label = 1 THEN v END", "event_type": "CASE WHEN event_type <> 'view' THEN event_type END", "p": "CASE WHEN p < 0.2 THEN p END"}


@query("b6_frame_profile", "WITH" + SAMPLES + ", f AS (SELECT " + ", ".join(f"{HOLED.get(c, c)} AS {c}" for c in FRAME) + " FROM samples) " + " UNION ALL ".join(
    f"SELECT count(*) AS rows, '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS missing FROM f" for c in FRAME))
def _(spark, sf):
    return clean.frame_profile(samples(spark, sf).selectExpr(*[f"{HOLED.get(c, c)} as {c}" for c in FRAME]))


@query("b7_eligible_sessions", "WITH" + INDEX + """
  SELECT i.session_id, c.n AS n_windows FROM idx i JOIN (SELECT session_id, count(*) AS n FROM samples WHERE label = 1 GROUP BY 1) c
  USING (session_id) WHERE verdict IN ('trainable','usable') AND study_mode <> 'test' AND n >= 25""")
def _(spark, sf):
    out = clean.eligible_sessions(session_index(spark, sf), samples(spark, sf).filter("label = 1"), min_windows=25)
    return out.select("session_id", "n_windows")


def tilt_windows(spark, sf):
    return samples(spark, sf).selectExpr(
        "_ord", "session_id", "v", "if(session_id % 4 = 0 and k < 50, null, k) as tilt_x_mean", "k as tilt_change"
    )


@query("b8_pool_modern", "WITH" + SAMPLES + """, m AS (
  SELECT session_id FROM samples GROUP BY 1 HAVING bool_and(NOT (session_id % 4 = 0 AND k < 50)))
  SELECT _ord, v, k AS tilt_x_mean FROM samples SEMI JOIN m USING (session_id)""")
def _(spark, sf):
    return clean.filter_pool(tilt_windows(spark, sf), "modern").select("_ord", "v", "tilt_x_mean")


@query("b8_pool_legacy", "WITH" + SAMPLES + """, m AS (
  SELECT session_id FROM samples GROUP BY 1 HAVING NOT bool_and(NOT (session_id % 4 = 0 AND k < 50)))
  SELECT _ord, session_id, v FROM samples SEMI JOIN m USING (session_id)""")
def _(spark, sf):
    return clean.filter_pool(tilt_windows(spark, sf), "legacy")


@query("b8_pool_auto", "WITH" + SAMPLES + " SELECT _ord, session_id, v FROM samples")
def _(spark, sf):
    return clean.filter_pool(tilt_windows(spark, sf), "auto")


@query("b10_mixed_windows", "WITH" + SAMPLES + " SELECT _ord, k / 100 AS writing_share FROM samples WHERE NOT (k / 100 > 0.2 AND k / 100 < 0.8)")
def _(spark, sf):
    return clean.exclude_mixed(samples(spark, sf).selectExpr("_ord", "k / 100 as writing_share"), 0.2, 0.8)


@query("b11_feature_subset", "WITH" + WATCH + " SELECT _ord, az AS az_std, ay AS ay_zcr FROM watch")
def _(spark, sf):
    w = watch(spark, sf).selectExpr(
        "_ord", "ax as ax_mean", "az as az_std", "ay as ay_zcr", "rx as rx_std", "ax as acc_mag_mean", "ry as corr_rx_ry",
        "rz as gyro_mag_std",
    )
    names = [c for c in w.columns if c != "_ord"]
    return w.select("_ord", *clean.feature_subset(names, "invariant"))


@query("b12_total_acceleration", "WITH" + WATCH + """
  SELECT _ord, round(ax + gx, 6) AS ax, round(ay + gy, 6) AS ay, round(az + gz, 6) AS az FROM watch""")
def _(spark, sf):
    w = clean.total_acceleration(watch(spark, sf))
    return w.select("_ord", *[rnd(F.col(c)).alias(c) for c in ("ax", "ay", "az")])


@query("b13_unsessioned", "WITH" + SAMPLES + """
  SELECT CASE WHEN person_id % 3 = 0 THEN 'unsessioned' ELSE 'live-' || person_id END AS session_id, count(*) AS n FROM samples GROUP BY 1""")
def _(spark, sf):
    s = samples(spark, sf).withColumn("source", F.col("person_id"))
    active = s.select("person_id").distinct().filter("person_id % 3 <> 0").selectExpr(
        "person_id as source", "concat('live-', cast(person_id as string)) as session_id"
    )
    return clean.route_unsessioned(s, active).groupBy("session_id").agg(F.count("*").alias("n"))


@query("b14_session_search", "WITH" + INDEX + """
  SELECT session_id, verdict, duration_seconds FROM idx
  WHERE description LIKE '%ng 1%' AND verdict = 'usable' AND duration_seconds >= 300""")
def _(spark, sf):
    out = index.search(session_index(spark, sf), text="NG 1", verdict="usable", min_five=True, order_by="duration_seconds")
    return out.select("session_id", "verdict", "duration_seconds")


@query("b15_safe_ids", """SELECT page_id, CASE WHEN trim(url) = '' THEN 'unsessioned'
  ELSE left(regexp_replace(trim(url), '[^\\p{L}\\p{N}\\-_.]', '_', 'g'), 80) END AS safe_id FROM pages""")
def _(spark, sf):
    from ..functions import safe_id
    from .data import table

    return table(spark, sf, "pages").select("page_id", safe_id(F.col("url")).alias("safe_id"))


@query("b16_next_session_id", "WITH" + SAMPLES + """
  SELECT 'S' || printf('%03d', max(greatest(session_id, person_id + 2000)) + 1) AS next_id FROM samples""")
def _(spark, sf):
    s = samples(spark, sf)
    a = s.selectExpr("concat('S', lpad(cast(session_id as string), 5, '0')) as session_id").distinct()
    b = s.selectExpr("concat('S', cast(person_id + 2000 as string)) as session_id").distinct()
    bad = s.selectExpr("concat('X', cast(session_id + 9000 as string)) as session_id").distinct()
    return index.next_session_id(a, b, bad)


@query("b17_subject_index", "WITH" + INDEX + """
  SELECT person_id, CAST(row_number() OVER (ORDER BY min(_ord)) AS INT) AS subject_index FROM idx WHERE study_mode = 'study' GROUP BY 1""")
def _(spark, sf):
    return index.subject_index(session_index(spark, sf)).select("person_id", "subject_index")
