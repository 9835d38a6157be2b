"""Recording quality over the event log: 1.2e6 ms of log time stand for one sensor millisecond."""

from pyspark.sql import functions as F

from ..operators import issues as iss
from ..operators import quality as q
from ..operators import strokes as st
from .data import DAY, MARKERS, PEN, SAMPLES, markers, pen, rnd, samples
from ..session import staged
from .registry import query


def q_watch(spark, sf):
    s = samples(spark, sf)
    ts = F.expr("ts div 1200000")
    gone = F.col("session_id") % 19 == 0
    mag = lambda a, b: F.sqrt(a * a + b * b)
    v, k = F.col("v"), F.col("k")
    return s.select(
        "session_id", "_ord", ts.alias("ts"), (ts + (k % 7).cast("long")).alias("local_ts"),
        k.cast("long").alias("sequence"), v.alias("ax"), k.alias("ay"), F.lit(0.5).alias("az"),
        mag(v, k).alias("acc_mag"), F.when(~gone, F.floor(v)).cast("double").alias("gyro_mag"),
        F.when(F.col("session_id") % 3 == 0, F.lit(1.0)).alias("grav_mag"),
        F.when(F.col("session_id") % 3 == 0, F.lit(1.0)).alias("gx"), F.lit(None).cast("double").alias("gy"),
        F.lit(None).cast("double").alias("gz"), (F.col("session_id") % 5 != 0).alias("has_server_ms"),
    )


QW = SAMPLES + """, qw AS (
  SELECT session_id, _ord, ts // 1200000 AS ts, ts // 1200000 + CAST(k AS BIGINT) % 7 AS local_ts,
         CAST(k AS BIGINT) AS sequence, v AS ax, k AS ay, 0.5::DOUBLE AS az, sqrt(v*v + k*k) AS acc_mag,
         CASE WHEN session_id % 19 <> 0 THEN floor(v) END AS gyro_mag, CASE WHEN session_id % 3 = 0 THEN 1.0 END AS grav_mag,
         session_id % 5 <> 0 AS has_server_ms FROM samples)"""


def q_pen(spark, sf):
    p = pen(spark, sf).filter("_ord % 5 <> 0 and session_id % 17 <> 0")
    ts = F.expr("ts div 1200000")
    u = F.col("session_id")
    shift = F.when(u % 23 == 0, 10_000_000).otherwise(0)
    return p.select(
        "session_id", "_ord", "dot_type", "x", "y", (ts - F.lit(80_000_000_000)).alias("ts"),
        (ts + F.col("_ord") % 5 + shift).alias("local_ts"), (u % 6 != 0).alias("has_local_ts_ms"),
    )


QP = PEN + """, qp AS (
  SELECT session_id, _ord, dot_type, x, y, ts // 1200000 - 80000000000 AS ts,
         ts // 1200000 + _ord % 5 + CASE WHEN session_id % 23 = 0 THEN 10000000 ELSE 0 END AS local_ts,
         session_id % 6 <> 0 AS has_local_ts_ms FROM pen WHERE _ord % 5 <> 0 AND session_id % 17 <> 0)"""


def q_sessions(spark, sf):
    u = F.col("session_id")
    g = samples(spark, sf).groupBy("session_id").agg(
        F.expr("min(ts div 1200000)").alias("start_ms"), F.count("*").alias("n")
    )
    return g.select(
        "session_id", F.when(u % 10 == 0, "active").otherwise("done").alias("status"),
        F.when(u % 20 == 7, "yes").otherwise("").alias("flagged"), "start_ms",
        (F.col("start_ms") + F.when(u % 13 == 0, -90_000).otherwise(400_000)).alias("end_ms"),
        (F.col("n") + F.when(u % 11 == 0, 100).otherwise(0)).alias("watch_samples"),
        F.expr("cast(floor(n * 0.8D) as bigint)").alias("pen_samples"),
        F.when(u % 4 == 0, F.lit(9)).otherwise(0).cast("long").alias("airpods_samples"),
    )


QS = """, qs AS (
  SELECT session_id, CASE WHEN session_id % 10 = 0 THEN 'active' ELSE 'done' END AS status,
         CASE WHEN session_id % 20 = 7 THEN 'yes' ELSE '' END AS flagged, min(ts // 1200000) AS start_ms,
         min(ts // 1200000) + CASE WHEN session_id % 13 = 0 THEN -90000 ELSE 400000 END AS end_ms,
         count(*) + CASE WHEN session_id % 11 = 0 THEN 100 ELSE 0 END AS watch_samples,
         CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) AS pen_samples, CASE WHEN session_id % 4 = 0 THEN 9 ELSE 0 END AS airpods_samples
  FROM samples GROUP BY session_id)"""


def q_airpods(spark, sf):
    """Head stream: only every fourth user has it, some without server time."""
    s = samples(spark, sf).filter("session_id % 4 = 0")
    t = F.when(F.col("session_id") % 8 == 0, F.expr("ts div 1200000"))
    return s.groupBy("session_id").agg(
        F.count("*").alias("row_count"), F.count(t).alias("server_time_rows")
    )


def q_sync(spark, sf):
    return samples(spark, sf).select("session_id").distinct().selectExpr(
        "session_id", "(session_id % 10) / 2.0D - 4.5D as sigma", "0.0D as delta_ms"
    )


CLOCK = """, {p}c AS (
  SELECT session_id, min(local_ts) AS start_ms, max(local_ts) AS end_ms, min(ts) AS source_start_ms, max(ts) AS source_end_ms,
         count(*) AS rows, arg_min(local_ts - ts, _ord) AS offset_start_ms, arg_max(local_ts - ts, _ord) AS offset_end_ms,
         median(local_ts - ts) AS med, min(local_ts - ts) AS offset_min_ms, max(local_ts - ts) AS offset_max_ms,
         mad(local_ts - ts) AS mad
  FROM {p} GROUP BY 1)"""
WC, PC = CLOCK.format(p="qw"), CLOCK.format(p="qp")


@query("d1_clock_summary", "WITH" + QW + WC + """
  SELECT session_id, rows, start_ms, end_ms, source_start_ms, source_end_ms, round((end_ms - start_ms) / 1000.0, 3)::DOUBLE AS duration_seconds,
         offset_start_ms, offset_end_ms, offset_end_ms - offset_start_ms AS drift_ms, round(med, 3)::DOUBLE AS offset_median_ms,
         offset_min_ms, offset_max_ms, round(mad, 3)::DOUBLE AS offset_mad_ms FROM qwc""")
def _(spark, sf):
    return q.clock_summary(q_watch(spark, sf)).drop("source_duration_seconds", "rows_with_local_ts", "rows_with_source_ts")


@query("d2_mad", "WITH" + SAMPLES + """
  SELECT event_type, round(median(v), 6) AS median, round(mad(v), 6) AS mad FROM samples GROUP BY 1""")
def _(spark, sf):
    from ..kernels import mad

    d = mad(samples(spark, sf), ["event_type"], "v")
    return d.select("event_type", rnd(F.col("median")).alias("median"), rnd(F.col("mad")).alias("mad"))


@query("d3_rate_from_span", "WITH" + QW + """
  SELECT session_id, round(CASE WHEN count(*) > 1 AND max(ts) > min(ts) THEN (count(*) - 1) * 1000.0::DOUBLE / (max(ts) - min(ts)) ELSE 50.0 END, 6) AS fs_hz
  FROM qw GROUP BY 1""")
def _(spark, sf):
    return q.rate_from_span(q_watch(spark, sf)).select("session_id", rnd(F.col("fs_hz")).alias("fs_hz"))


RATE = """, dif AS (SELECT session_id, ts - lag(ts) OVER (PARTITION BY session_id ORDER BY _ord) AS dt FROM qw), rate AS (
  SELECT session_id, median(dt) AS median_dt_ms, 1000.0 / median(dt) AS fs_hz FROM dif WHERE dt > 0 GROUP BY 1), rated AS (
  SELECT *, CASE WHEN abs(fs_hz - 50) <= abs(fs_hz - 100) THEN 50.0 ELSE 100.0 END::DOUBLE AS target_hz FROM rate)"""


@query("d4_rate_from_diffs", "WITH" + QW + RATE + " SELECT session_id, round(median_dt_ms, 6)::DOUBLE AS median_dt_ms, round(fs_hz, 6)::DOUBLE AS fs_hz FROM rate")
def _(spark, sf):
    return q.rate_from_diffs(q_watch(spark, sf)).select(
        "session_id", rnd(F.col("median_dt_ms")).alias("median_dt_ms"), rnd(F.col("fs_hz")).alias("fs_hz")
    )


@query("d5_nearest_rate", "WITH" + QW + RATE + " SELECT session_id, target_hz, abs(fs_hz - target_hz) / target_hz <= 0.2 AS rate_ok FROM rated")
def _(spark, sf):
    return q.rate_from_diffs(q_watch(spark, sf)).selectExpr(
        "session_id", f"{q.nearest_rate('fs_hz')} as target_hz", f"{q.rate_in_range('fs_hz')} as rate_ok"
    )


@query("d6_profile", "WITH" + QW + """, dif AS (
  SELECT session_id, abs(ts - lag(ts) OVER (PARTITION BY session_id ORDER BY _ord)) AS dt FROM qw), r AS (
  SELECT session_id, CASE WHEN median(dt) >= 0.5 THEN 1000.0 / median(dt) ELSE 1.0 / median(dt) END AS fs FROM dif WHERE dt IS NOT NULL GROUP BY 1), n AS (
  SELECT *, CASE WHEN abs(fs - 50) <= abs(fs - 100) THEN 50 ELSE 100 END AS hz FROM r)
  SELECT session_id, CASE WHEN abs(fs - hz) / hz <= 0.2 THEN hz || 'hz' || CASE WHEN session_id % 3 = 0 THEN '_grav' ELSE '' END END AS profile FROM n""")
def _(spark, sf):
    return q.detect_profile(q_watch(spark, sf)).select("session_id", "profile")


BATCH = """, bt AS (
  SELECT session_id, sequence, count(*) AS n, min(_ord) AS fo, arg_min(local_ts, _ord) AS fl, arg_max(local_ts, _ord) AS ll FROM qw GROUP BY 1, 2), reg AS (
  SELECT session_id, sequence AS after_seq, lead(sequence) OVER (PARTITION BY session_id ORDER BY sequence) AS next_seq, fl FROM bt), runs AS (
  SELECT * FROM (SELECT session_id, _ord, sequence, lag(sequence) OVER (PARTITION BY session_id ORDER BY _ord) AS p FROM qw)
  WHERE p IS NULL OR p <> sequence)"""


@query("d7_gap_regions", "WITH" + QW + BATCH + """
  SELECT session_id, after_seq, next_seq, next_seq - after_seq - 1 AS missing, fl AS around_local_ts_ms FROM reg WHERE next_seq - after_seq > 1""")
def _(spark, sf):
    return q.gap_regions(q_watch(spark, sf))


@query("d7_sequence_summary", "WITH" + QW + BATCH + """
  SELECT b.*, coalesce(g.sequence_gaps, 0) AS sequence_gaps, coalesce(g.gap_regions, 0) AS gap_regions FROM (
    SELECT session_id, count(*) AS sequence_batches, max(n) AS max_batch_size, min(sequence) AS seq_min, max(sequence) AS seq_max FROM bt GROUP BY 1) b
  LEFT JOIN (SELECT session_id, CAST(sum(next_seq - after_seq - 1) AS BIGINT) AS sequence_gaps, count(*) AS gap_regions FROM reg
             WHERE next_seq - after_seq > 1 GROUP BY 1) g USING (session_id)""")
def _(spark, sf):
    return q.sequence_summary(q_watch(spark, sf))


@query("d8_arrival_gaps", "WITH" + QW + BATCH + """
  SELECT r.session_id, r._ord, r.p AS after_seq, r.sequence AS next_seq, r.sequence - r.p - 1 AS missing,
         a.ll AS after_local_ts_ms, b.fl AS before_local_ts_ms
  FROM runs r JOIN bt a ON a.session_id = r.session_id AND a.sequence = r.p JOIN bt b ON b.session_id = r.session_id AND b.sequence = r.sequence
  WHERE r.sequence > r.p + 1""")
def _(spark, sf):
    return q.arrival_gaps(q_watch(spark, sf))


@query("d8_arrival_summary", "WITH" + QW + BATCH + """
  SELECT r.*, s.size_min, s.size_max, s.size_mean FROM (
    SELECT session_id, count(*) AS runs, min(sequence) AS seq_min, max(sequence) AS seq_max, max(sequence) - min(sequence) + 1 AS expected_batches,
           CAST(coalesce(sum(greatest(sequence - p - 1, 0)), 0) AS BIGINT) AS missing_batches FROM runs GROUP BY 1) r
  JOIN (SELECT session_id, min(n) AS size_min, max(n) AS size_max, round(avg(n), 6) AS size_mean FROM bt GROUP BY 1) s USING (session_id)""")
def _(spark, sf):
    return q.arrival_summary(q_watch(spark, sf)).withColumn("size_mean", rnd(F.col("size_mean")))


@query("d9_counter_resets", "WITH" + QW + BATCH + """
  SELECT r.session_id, count(*) AS resets FROM runs r JOIN bt b ON b.session_id = r.session_id AND b.sequence = r.sequence
  WHERE r.sequence < r.p AND b.fo < r._ord GROUP BY 1""")
def _(spark, sf):
    return q.counter_resets(q_watch(spark, sf))


def coarse_watch(spark, sf):
    """Time and magnitudes rounded so that copies occur."""
    return q_watch(spark, sf).selectExpr(
        "session_id", "ts div 400 as ts", "floor(gyro_mag / 40) as acc_mag", "1.0D as gyro_mag", "cast(null as double) as grav_mag"
    )


@query("d10_duplicates", "WITH" + QW + """
  SELECT session_id, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT session_id, count(*) AS n FROM qw GROUP BY session_id, ts // 400, floor(gyro_mag / 40)) GROUP BY 1""")
def _(spark, sf):
    return q.duplicate_samples(coarse_watch(spark, sf))


@query("d11_completeness", "WITH" + QW + """
  SELECT session_id, count(*) AS watch_rows, count(ts) AS watch_ts_rows, count(acc_mag) AS accel_rows, count(gyro_mag) AS gyro_rows,
         count(grav_mag) AS gravity_rows, count(*) FILTER (has_server_ms) AS watch_server_rows FROM qw GROUP BY 1""")
def _(spark, sf):
    return q.completeness(q_watch(spark, sf))


FACTS = QP + QW.replace(SAMPLES, "") + QS + WC + PC + RATE + BATCH + """, ivl0 AS (
  SELECT *, lag(CASE WHEN dot_type = 'PEN_DOWN' THEN 1 ELSE 0 END) OVER w AS opens, lag(ts) OVER w AS t0, lag(local_ts) OVER w AS l0, lag(moves) OVER w AS m0
  FROM (SELECT *, sum(CASE WHEN dot_type IN ('PEN_MOVE','PEN_HOVER') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY _ord) AS moves FROM qp)
  WHERE dot_type IN ('PEN_DOWN','PEN_UP') WINDOW w AS (PARTITION BY session_id ORDER BY _ord)), ivl AS (
  SELECT session_id, t0 AS source_start_ms, ts AS source_end_ms, l0 AS local_start_ms, local_ts AS local_end_ms, greatest(0, ts - t0) AS duration_ms,
         CAST(moves - m0 + 2 AS BIGINT) AS dot_count FROM ivl0 WHERE dot_type = 'PEN_UP' AND opens = 1), facts AS (
  SELECT s.session_id, s.status, s.flagged, s.start_ms AS s0, s.end_ms AS s1, s.watch_samples, s.pen_samples, s.airpods_samples,
         w.rows AS watch_rows, w.start_ms AS w0, w.end_ms AS w1, round((w.source_end_ms - w.source_start_ms) / 1000.0, 3) AS wdur,
         coalesce(p.rows, 0) AS pen_rows, p.start_ms AS p0, p.end_ms AS p1, p.med - w.med AS gap,
         (p.offset_end_ms - p.offset_start_ms) - (w.offset_end_ms - w.offset_start_ms) AS rel_drift,
         r.fs_hz, r.target_hz, abs(r.fs_hz - r.target_hz) / r.target_hz <= 0.2 AS rate_ok,
         (SELECT coalesce(sum(next_seq - after_seq - 1), 0) FROM reg g WHERE g.session_id = s.session_id AND next_seq - after_seq > 1) AS sequence_gaps,
         (SELECT count(*) FROM runs x JOIN bt b ON b.session_id = x.session_id AND b.sequence = x.sequence
          WHERE x.session_id = s.session_id AND x.sequence < x.p AND b.fo < x._ord) AS resets,
         (SELECT count(*) - count(DISTINCT (ts, acc_mag, coalesce(gyro_mag, -1))) FROM qw WHERE qw.session_id = s.session_id) AS duplicates,
         (SELECT avg(CASE WHEN local_ts BETWEEN w.start_ms AND w.end_ms THEN 1.0 ELSE 0.0 END) FROM qp WHERE qp.session_id = s.session_id) AS in_range_pct,
         (SELECT coalesce(sum(duration_ms), 0) FROM ivl WHERE ivl.session_id = s.session_id) AS writing_ms,
         (s.session_id - 9) / 2.0 AS unused, (s.session_id % 10) / 2.0 - 4.5 AS sigma,
         CASE WHEN s.end_ms > s.start_ms THEN (s.end_ms - s.start_ms) / 1000.0 END AS duration_seconds,
         s.session_id % 4 = 0 AS has_air
  FROM qs s JOIN qwc w USING (session_id) LEFT JOIN qpc p USING (session_id) LEFT JOIN rated r USING (session_id))"""

ISSUES = FACTS + """, rules AS (
  SELECT session_id, duration_seconds, flagged, sigma, fs_hz, target_hz, rate_ok, unnest([
    CASE WHEN pen_rows = 0 THEN ['no_pen_samples','bad','warn'] END,
    CASE WHEN session_id % 19 = 0 THEN ['missing_gyroscope','bad','bad'] END,
    CASE WHEN NOT rate_ok THEN ['watch_rate_out_of_range','warn','warn'] END,
    CASE WHEN sequence_gaps > 0 THEN ['sequence_gaps','warn','warn'] END,
    CASE WHEN duplicates > 0 THEN ['duplicate_samples',NULL,'warn'] END,
    CASE WHEN resets > 0 THEN ['sequence_counter_reset',NULL,'warn'] END,
    CASE WHEN status <> 'active' AND abs(watch_rows - watch_samples) > greatest(20, CAST(floor(greatest(watch_rows, watch_samples) * 0.02::DOUBLE) AS BIGINT)) THEN ['watch_count_mismatch',NULL,'warn'] END,
    CASE WHEN status <> 'active' AND abs(pen_rows - pen_samples) > greatest(20, CAST(floor(greatest(pen_rows, pen_samples) * 0.02::DOUBLE) AS BIGINT)) THEN ['pen_count_mismatch',NULL,'warn'] END,
    CASE WHEN pen_rows > 0 AND session_id % 6 = 0 THEN ['legacy_pen_time',NULL,'warn'] END,
    CASE WHEN session_id % 5 = 0 THEN ['legacy_watch_time',NULL,'warn'] END,
    CASE WHEN status <> 'active' AND watch_rows < CAST(floor(wdur * target_hz) AS BIGINT) * 0.7::DOUBLE THEN ['low_watch_coverage','warn','warn'] END,
    CASE WHEN pen_rows > 0 AND session_id % 6 = 0 THEN ['pen_clock_mismatch','info','info'] END,
    CASE WHEN in_range_pct < 0.8 THEN ['pen_dots_outside_watch_range','warn',NULL] END,
    CASE WHEN has_air AND session_id % 8 <> 0 THEN ['legacy_airpods_time',NULL,'warn'] END,
    CASE WHEN status <> 'active' AND has_air AND CAST(floor(wdur * 25) AS BIGINT) > 0 AND watch_rows < CAST(floor(wdur * 25) AS BIGINT) * 0.7::DOUBLE THEN ['low_airpods_coverage',NULL,'warn'] END,
    CASE WHEN status <> 'active' AND has_air AND abs(watch_rows - airpods_samples) > 20 THEN ['airpods_count_mismatch',NULL,'warn'] END,
    CASE WHEN status <> 'active' AND sigma > -1 THEN ['sync_failed','bad',NULL] END,
    CASE WHEN status <> 'active' AND sigma > -2 AND sigma <= -1 THEN ['low_sync_confidence','warn',NULL] END,
    CASE WHEN status <> 'active' AND (w0 < s0 - 60000 OR w1 > s1 + 60000 OR coalesce(p0 < s0 - 60000 OR p1 > s1 + 60000, false)) THEN ['data_outside_session_window','bad','bad'] END,
    CASE WHEN {deep} AND NOT (w0 <= p1 AND p0 <= w1) THEN ['streams_do_not_overlap','bad','bad'] END,
    CASE WHEN {deep} AND abs(gap) > 1000 THEN ['source_clocks_not_shared','info','info'] END]) AS i FROM facts), issues AS (
  SELECT session_id, i[1] AS code, i[2] AS ml_severity, i[3] AS recording_severity FROM rules WHERE i IS NOT NULL), sev AS (
  SELECT * FROM (VALUES ('bad', 3), ('warn', 2), ('info', 1)) t(s, r)), scored AS (
  SELECT f.session_id, coalesce(max(m.r), 0) AS ml, coalesce(max(r.r), 0) AS rec,
         coalesce(string_agg(code, ';' ORDER BY code) FILTER (ml_severity = 'bad'), '') AS ml_blockers,
         coalesce(string_agg(code, ';' ORDER BY code) FILTER (ml_severity = 'warn'), '') AS ml_warnings,
         coalesce(string_agg(code, ';' ORDER BY code) FILTER (ml_severity = 'info'), '') AS ml_info,
         coalesce(string_agg(code, ';' ORDER BY code) FILTER (recording_severity = 'bad'), '') AS recording_blockers,
         coalesce(string_agg(code, ';' ORDER BY code) FILTER (recording_severity = 'warn'), '') AS recording_warnings,
         coalesce(string_agg(code, ';' ORDER BY code) FILTER (recording_severity = 'info'), '') AS recording_info,
         coalesce(string_agg(code, ';' ORDER BY code), '') AS codes
  FROM facts f LEFT JOIN issues i USING (session_id) LEFT JOIN sev m ON m.s = i.ml_severity LEFT JOIN sev r ON r.s = i.recording_severity
  GROUP BY 1), named AS (
  SELECT *, ['ok','info','warn','bad'][ml + 1] AS ml_status, ['ok','info','warn','bad'][rec + 1] AS recording_status FROM scored)"""
FLAT = ISSUES.replace("{deep}", "false")


def facts(spark, sf):
    """Computed once as a table of one row per session; every view reads it."""
    f = q.session_facts(
        q_sessions(spark, sf), q_watch(spark, sf), q_pen(spark, sf), q_airpods(spark, sf), q_sync(spark, sf)
    )
    return staged(f, "facts")


@query("d12_coverage", "WITH" + FACTS + """
  SELECT session_id, CAST(floor(wdur * target_hz) AS DOUBLE) AS expected_samples, round(watch_rows / floor(wdur * target_hz), 6)::DOUBLE AS coverage FROM facts""")
def _(spark, sf):
    w = q_watch(spark, sf)
    c = q.clock_summary(w).select("session_id", "rows", "source_duration_seconds")
    r = q.rate_from_diffs(w).selectExpr("session_id", f"{q.nearest_rate('fs_hz')} as hz")
    return c.join(r, "session_id").selectExpr(
        "session_id", "cast(floor(source_duration_seconds * hz) as double) as expected_samples",
        "round(rows / floor(source_duration_seconds * hz), 6) as coverage",
    )


@query("d13_containment_overlap", "WITH" + FACTS + """
  SELECT session_id, round(in_range_pct, 6)::DOUBLE AS in_range_pct, round(greatest(0, (least(w1, p1) - greatest(w0, p0)) / 1000.0), 3)::DOUBLE AS overlap
  FROM facts WHERE p0 IS NOT NULL""")
def _(spark, sf):
    w, p = q_watch(spark, sf), q_pen(spark, sf)
    wc, pc = q.clock_summary(w), q.clock_summary(p)
    both = wc.alias("w").join(pc.alias("p"), "session_id").selectExpr("session_id", f"{q.overlap_seconds('w', 'p')} as overlap")
    return both.join(q.containment(p, wc), "session_id").select("session_id", rnd(F.col("in_range_pct")).alias("in_range_pct"), "overlap")


@query("d14_writing_time", "WITH" + FACTS + """
  SELECT session_id, round(writing_ms / 1000.0, 3)::DOUBLE AS writing_seconds,
         round(round(writing_ms / 1000.0, 3) / round((p1 - p0) / 1000.0, 3), 6)::DOUBLE AS writing_fraction FROM facts WHERE p0 IS NOT NULL""")
def _(spark, sf):
    p = q_pen(spark, sf)
    return q.writing_time(p, q.clock_summary(p)).withColumn("writing_fraction", rnd(F.col("writing_fraction")))


@query("d15_count_reconciliation", """WITH disk AS (SELECT l_orderkey AS session_id, count(*) * 10 AS n FROM lineitem GROUP BY 1), idx AS (
  SELECT o_orderkey AS session_id, CAST(floor(o_totalprice / 1000) AS BIGINT) AS m FROM orders)
  SELECT session_id, abs(n - m) AS delta, greatest(20, CAST(floor(greatest(n, m) * 0.02::DOUBLE) AS BIGINT)) AS tolerance,
         abs(n - m) > greatest(20, CAST(floor(greatest(n, m) * 0.02::DOUBLE) AS BIGINT)) AS mismatch FROM disk JOIN idx USING (session_id)""")
def _(spark, sf):
    from .data import table

    disk = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("session_id")).agg((F.count("*") * 10).alias("n"))
    idx = table(spark, sf, "orders").selectExpr("o_orderkey as session_id", "cast(floor(o_totalprice / 1000) as bigint) as m")
    delta, tol = q.count_check("n", "m")
    return disk.join(idx, "session_id").selectExpr("session_id", f"{delta} as delta", f"{tol} as tolerance", f"{delta} > {tol} as mismatch")


@query("d16_clock_years", """SELECT o_custkey AS session_id, CAST(min(year(o_orderdate)) AS INT) AS year_min, CAST(max(year(o_orderdate)) AS INT) AS year_max,
  CAST(count(DISTINCT year(o_orderdate)) AS INT) AS n_years FROM orders GROUP BY 1""")
def _(spark, sf):
    from .data import millis, table

    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("session_id"), millis("o_orderdate").alias("ts"))
    return q.clock_years(o).selectExpr("session_id", "year_min", "year_max", "size(years) as n_years")


@query("d17_issues", "WITH" + FLAT + " SELECT * FROM issues")
def _(spark, sf):
    return iss.find_issues(facts(spark, sf)).select("session_id", "code", "ml_severity", "recording_severity")


@query("d18_scores", "WITH" + FLAT + """
  SELECT session_id, ml_status, recording_status, ml_blockers, ml_warnings, ml_info, recording_blockers, recording_warnings, recording_info FROM named""")
def _(spark, sf):
    f = facts(spark, sf)
    return iss.score(f, iss.find_issues(f))


@query("d19_verdicts", "WITH" + FLAT + """
  SELECT session_id, ml_status, recording_status, duration_seconds::DOUBLE AS duration_seconds, sigma::DOUBLE AS alignment_sigma,
    CASE WHEN flagged = 'yes' THEN 'skip' WHEN ml_status = 'bad' THEN 'skip'
         WHEN ml_status = 'ok' AND sigma <= -3 AND duration_seconds >= 300 THEN 'trainable' ELSE 'usable' END AS verdict,
    codes AS issue_codes,
    CASE WHEN rate_ok THEN CAST(CAST(target_hz AS INT) AS VARCHAR) || 'hz' || CASE WHEN session_id % 3 = 0 THEN '_grav' ELSE '' END ELSE '' END AS watch_profile
  FROM named JOIN facts USING (session_id)""")
def _(spark, sf):
    f = facts(spark, sf)
    i = iss.find_issues(f)
    return q.verdicts(f, i, iss.score(f, i))


@query("d20_quality_summary", "WITH" + FLAT + """
  SELECT score, count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s = 'info') AS info, count(*) FILTER (s = 'warn') AS warn, count(*) FILTER (s = 'bad') AS bad
  FROM (SELECT 'ml' AS score, ml_status AS s FROM named UNION ALL SELECT 'recording', recording_status FROM named) GROUP BY 1""")
def _(spark, sf):
    f = facts(spark, sf)
    return q.quality_summary(iss.score(f, iss.find_issues(f)))


@query("d21_activity_lane", "WITH" + QW + WC + """, b AS (
  SELECT q.session_id, CAST(floor((local_ts - start_ms) / ((end_ms - start_ms) / 200.0::DOUBLE)) AS INT) AS bin, sqrt(avg(ax*ax + ay*ay + az*az)) AS rms
  FROM qw q JOIN qwc c USING (session_id) WHERE local_ts < end_ms GROUP BY 1, 2)
  SELECT g.session_id, g.bin, round(coalesce(rms, 0) / max(rms) OVER (PARTITION BY g.session_id), 3) AS level
  FROM (SELECT session_id, CAST(unnest(range(200)) AS INT) AS bin FROM qwc) g LEFT JOIN b ON b.session_id = g.session_id AND b.bin = g.bin""")
def _(spark, sf):
    w = q_watch(spark, sf)
    return q.activity_lane(w, q.clock_summary(w))


@query("d22_validation", "WITH" + FACTS + """
  SELECT session_id, (p0 - w0)::DOUBLE AS start_offset_ms, (w1 - p1)::DOUBLE AS end_offset_ms, w0 <= p1 AND p0 <= w1 AS streams_overlap,
         round(greatest(0, (least(w1, p1) - greatest(w0, p0)) / 1000.0), 3)::DOUBLE AS common_overlap_seconds, rel_drift::DOUBLE AS relative_drift_ms,
         round(gap, 3)::DOUBLE AS clock_offset_gap_ms, round((greatest(w1, p1) - least(w0, p0)) / 1000.0, 3)::DOUBLE AS duration_s
  FROM facts WHERE p0 IS NOT NULL""")
def _(spark, sf):
    v = q.validation(facts(spark, sf)).filter("pen_start_s is not null")
    return v.selectExpr(
        "session_id", "cast(start_offset_ms as double) as start_offset_ms", "cast(end_offset_ms as double) as end_offset_ms", "streams_overlap",
        "common_overlap_seconds", "cast(relative_drift_ms as double) as relative_drift_ms",
        "cast(clock_offset_gap_ms as double) as clock_offset_gap_ms", "duration_s",
    )


@query("d22_chart_intervals", "WITH" + FACTS + """
  SELECT session_id, round((local_start_ms - least(w0, p0)) / 1000.0, 3)::DOUBLE AS start_s, round((local_end_ms - least(w0, p0)) / 1000.0, 3)::DOUBLE AS end_s,
         round(greatest(0, local_end_ms - local_start_ms) / 1000.0, 3)::DOUBLE AS duration_s, dot_count FROM ivl JOIN facts USING (session_id)""")
def _(spark, sf):
    p = q_pen(spark, sf)
    starts = q.clock_summary(q_watch(spark, sf)).selectExpr("session_id", "start_ms as watch_start_ms").join(
        q.clock_summary(p).selectExpr("session_id", "start_ms as pen_start_ms"), "session_id"
    )
    return q.chart_intervals(p, starts)


@query("d23_full_report", "WITH" + ISSUES.replace("{deep}", "true") + " SELECT session_id, code FROM issues")
def _(spark, sf):
    f = facts(spark, sf)
    first = iss.find_issues(f)
    deep = iss.find_issues(f, iss.RULES + iss.VALIDATION_RULES)
    return q.merge_issues(first, deep).select("session_id", "code")


# ── strokes, intervals, markers ─────────────────────────────────────────────


@query("e2_stroke_ids", "WITH" + PEN + """
  SELECT * FROM (SELECT _ord, CAST(sum(CASE WHEN dot_type = 'PEN_DOWN' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ts, _ord) - 1 AS BIGINT) AS stroke_id
  FROM pen WHERE dot_type IN ('PEN_DOWN','PEN_UP') OR (dot_type = 'PEN_MOVE' AND x <> -1 AND y <> -1)) WHERE stroke_id >= 0""")
def _(spark, sf):
    return st.stroke_ids(pen(spark, sf), width=10 * DAY).select("_ord", "stroke_id")


@query("e3_pen_intervals", "WITH" + FACTS + " SELECT * FROM ivl")
def _(spark, sf):
    return st.pen_intervals(q_pen(spark, sf))


BLOCKS = MARKERS + """, blocks AS (
  SELECT session_id, pt AS task_id, pc AS task_category, p0 AS start_ms, timestamp_ms AS end_ms FROM (
    SELECT *, lag(event) OVER w AS pe, lag(task_id) OVER w AS pt, lag(task_category) OVER w AS pc, lag(timestamp_ms) OVER w AS p0
    FROM markers WHERE event IN ('task_start','task_end') WINDOW w AS (PARTITION BY session_id ORDER BY timestamp_ms, _ord))
  WHERE event = 'task_end' AND pe = 'task_start')"""
TIMELINE = MARKERS + """, s AS (SELECT * FROM markers WHERE event = 'task_start' QUALIFY row_number() OVER (PARTITION BY session_id, task_index ORDER BY timestamp_ms, _ord) = 1), e AS (
  SELECT * FROM markers WHERE event = 'task_end' QUALIFY row_number() OVER (PARTITION BY session_id, task_index ORDER BY timestamp_ms, _ord) = 1), b AS (
  SELECT e.session_id, e.task_index, max(m.timestamp_ms) AS before FROM e LEFT JOIN markers m ON m.session_id = e.session_id AND m.timestamp_ms < e.timestamp_ms GROUP BY 1, 2), timeline AS (
  SELECT e.session_id, e.task_index, coalesce(s.task_id, e.task_id) AS task_id, coalesce(s.task_category, e.task_category) AS task_category,
         coalesce(s.timestamp_ms, b.before + 5000) AS start_ms, e.timestamp_ms AS end_ms, s.task_id IS NULL AS reconstructed
  FROM e LEFT JOIN s ON s.session_id = e.session_id AND s.task_index = e.task_index JOIN b ON b.session_id = e.session_id AND b.task_index = e.task_index
  WHERE s.task_id IS NOT NULL OR b.before IS NOT NULL)"""


@query("e4_marker_blocks", "WITH" + BLOCKS + " SELECT * FROM blocks")
def _(spark, sf):
    return st.marker_blocks(markers(spark, sf))


@query("e7_task_timeline", "WITH" + TIMELINE + " SELECT * FROM timeline")
def _(spark, sf):
    return st.task_timeline(markers(spark, sf))


@query("e8_task_blocks", "WITH" + MARKERS + """
  SELECT session_id, task_index, min(timestamp_ms) FILTER (event = 'task_start') AS start_ms, max(timestamp_ms) FILTER (event = 'task_end') AS end_ms,
         arg_min(task_id, timestamp_ms) FILTER (event = 'task_start') AS task_id FROM markers GROUP BY 1, 2
  HAVING count(*) FILTER (event = 'task_start') > 0 AND count(*) FILTER (event = 'task_end') > 0""")
def _(spark, sf):
    return st.task_blocks(markers(spark, sf))
