from pyspark.sql import functions as F

from ..plans import focus as f
from .data import HOUR, SAMPLES, chunked, rnd, samples
from .registry import query

TODAY, GAP = "2024-01-30", 12 * HOUR
OPTS = dict(max_gap_ms=GAP)


def log(spark, sf):
    s = samples(spark, sf)
    return chunked(s.select(
        "session_id", "_ord", "ts", F.least(F.col("v") / 207.3, F.lit(1.0)).alias("proba"),
        F.col("event_type").isin("click", "purchase", "view").cast("int").alias("writing"),
    ))


LOG = SAMPLES + """, log AS (
  SELECT session_id, _ord, ts, least(v / 207.3, 1.0) AS proba, CAST(event_type IN ('click','purchase','view') AS INT) AS writing,
         CAST(to_timestamp(ts / 1000.0) AS DATE) AS day, hour(to_timestamp(ts / 1000.0)) AS hour,
         row_number() OVER (PARTITION BY session_id, CAST(to_timestamp(ts / 1000.0) AS DATE) ORDER BY ts, _ord) AS rn
  FROM samples)"""

RUNS = LOG + f""", marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id, day ORDER BY ts, _ord) > {GAP} THEN 1 ELSE 0 END AS b
  FROM log WHERE writing = 1), numbered AS (
  SELECT *, sum(b) OVER (PARTITION BY session_id, day ORDER BY ts, _ord) AS island FROM marked), runs AS (
  SELECT session_id, day, min(ts) AS start_ms, max(ts) AS end_ms, (max(ts) - min(ts)) / 1000.0::DOUBLE AS duration_s,
         max(rn) - min(rn) + 1 AS n_ticks
  FROM numbered GROUP BY session_id, day, island HAVING (max(ts) - min(ts)) / 1000.0 >= 1.0)"""

HISTORY = RUNS + f""", daily AS (
  SELECT o.session_id, strftime(g.d, '%Y-%m-%d') AS date, strftime(g.d, '%a') AS weekday,
         coalesce(round(sum(r.duration_s), 1), 0.0)::DOUBLE AS writing_seconds, g.d = DATE '{TODAY}' AS is_today
  FROM (SELECT DISTINCT session_id FROM log) o
  CROSS JOIN (SELECT CAST(unnest(generate_series(DATE '{TODAY}' - 29, DATE '{TODAY}', INTERVAL 1 DAY)) AS DATE) AS d) g
  LEFT JOIN runs r ON r.session_id = o.session_id AND r.day = g.d GROUP BY ALL)"""


@query("e10_focus_stretches", "WITH" + RUNS + """
  SELECT session_id, strftime(day, '%Y-%m-%d') AS date, start_ms, end_ms, duration_s, n_ticks FROM runs""")
def _(spark, sf):
    r = f.stretches(log(spark, sf), count_ticks=True, **OPTS)
    return r.select("session_id", F.date_format("day", "yyyy-MM-dd").alias("date"), "start_ms", "end_ms", "duration_s", "n_ticks")


@query("e11_stretch_intensity", "WITH" + RUNS + """, grid AS (
  SELECT session_id, day, start_ms, end_ms, n_ticks, CAST(unnest(range(0, least(24, n_ticks))) AS BIGINT) AS bin FROM runs), hits AS (
  SELECT r.session_id, r.day, r.start_ms,
         least(least(24, r.n_ticks) - 1, CAST(floor((l.ts - r.start_ms)::DOUBLE / greatest(1, r.end_ms - r.start_ms) * least(24, r.n_ticks)) AS BIGINT)) AS bin,
         avg(l.proba) AS m
  FROM runs r JOIN log l ON l.session_id = r.session_id AND l.day = r.day AND l.ts BETWEEN r.start_ms AND r.end_ms GROUP BY ALL)
  SELECT g.session_id, g.start_ms, g.bin,
         round(coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY g.session_id, g.day, g.start_ms ORDER BY g.bin), 0.0), 3) AS intensity
  FROM grid g LEFT JOIN hits h ON g.session_id = h.session_id AND g.day = h.day AND g.start_ms = h.start_ms AND g.bin = h.bin""")
def _(spark, sf):
    l = log(spark, sf)
    return f.intensity(l, f.stretches(l, count_ticks=True, **OPTS), width=6 * HOUR).select("session_id", "start_ms", "bin", "intensity")


@query("h1_day_report", "WITH" + RUNS + """
  SELECT l.session_id, l.tick_count, coalesce(r.n, 0) AS n_stretches,
         round(coalesce(r.s, 0.0), 1)::DOUBLE AS total_writing_seconds, coalesce(r.m, 0.0)::DOUBLE AS longest_s
  FROM (SELECT session_id, count(*) AS tick_count FROM log WHERE day = DATE '2024-01-15' GROUP BY 1) l
  LEFT JOIN (SELECT session_id, count(*) AS n, sum(duration_s) AS s, max(duration_s) AS m FROM runs
             WHERE day = DATE '2024-01-15' GROUP BY 1) r USING (session_id)""")
def _(spark, sf):
    return f.day_report(log(spark, sf), "2024-01-15", **OPTS)


@query("h2_day_history", "WITH" + HISTORY + """
  SELECT *, max(writing_seconds) OVER (PARTITION BY session_id) AS max_seconds FROM daily""")
def _(spark, sf):
    return f.day_history(log(spark, sf), today=TODAY, days=30, **OPTS)


@query("h3_week", "WITH" + HISTORY + f"""
  SELECT *, max(writing_seconds) OVER (PARTITION BY session_id) AS max_seconds FROM daily
  WHERE CAST(date AS DATE) > DATE '{TODAY}' - 7""")
def _(spark, sf):
    return f.day_history(log(spark, sf), today=TODAY, days=7, **OPTS)


@query("h4_time_of_day", "WITH" + LOG + f""", c AS (
  SELECT session_id, hour, count(*)::DOUBLE AS s FROM log
  WHERE writing = 1 AND day BETWEEN DATE '{TODAY}' - 13 AND DATE '{TODAY}' GROUP BY ALL)
  SELECT o.session_id, CAST(g.h AS INT) AS hour, coalesce(c.s, 0.0)::DOUBLE AS seconds,
         coalesce(max(c.s) OVER (PARTITION BY o.session_id), 0.0)::DOUBLE AS max_seconds
  FROM (SELECT DISTINCT session_id FROM log) o CROSS JOIN (SELECT unnest(range(24)) AS h) g
  LEFT JOIN c ON c.session_id = o.session_id AND c.hour = g.h""")
def _(spark, sf):
    return f.time_of_day(log(spark, sf), today=TODAY, days=14)


GOAL = 10800.0


@query("e15_goal_progress", "WITH" + HISTORY + f"""
  SELECT session_id, date, round(least(1.0, greatest(0.0, writing_seconds / {GOAL})), 6) AS fraction,
         CAST(round(writing_seconds / {GOAL} * 100) AS BIGINT) AS percent, writing_seconds >= {GOAL} AS is_met FROM daily""")
def _(spark, sf):
    d = f.goal_progress(f.day_history(log(spark, sf), today=TODAY, days=30, **OPTS), GOAL)
    return d.select("session_id", "date", rnd(F.col("fraction")).alias("fraction"), "percent", "is_met")


@query("e14_goal_streaks", "WITH" + HISTORY + f""", g AS (
  SELECT session_id, CAST(date AS DATE) AS d,
         CAST(date AS DATE) - CAST(row_number() OVER (PARTITION BY session_id ORDER BY date) AS INT) AS grp
  FROM daily WHERE writing_seconds >= {GOAL}), r AS (
  SELECT session_id, count(*) AS n, max(d) AS t FROM g GROUP BY session_id, grp), b AS (
  SELECT session_id, max(n) AS longest, max(n) FILTER (t >= DATE '{TODAY}' - 1) AS cur FROM r GROUP BY 1)
  SELECT s.session_id, coalesce(cur, 0) AS current_streak, coalesce(longest, 0) AS longest_streak
  FROM (SELECT DISTINCT session_id FROM daily) s LEFT JOIN b USING (session_id)""")
def _(spark, sf):
    return f.goal_streaks(f.day_history(log(spark, sf), today=TODAY, days=30, **OPTS), GOAL, TODAY)


@query("e16_period_over_period", "WITH" + HISTORY + """, x AS (
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY date DESC) AS b FROM daily)
  SELECT session_id, round(sum(CASE WHEN b <= 7 THEN writing_seconds ELSE 0 END), 3) AS this_week,
         round(CASE WHEN count(*) >= 14 THEN sum(CASE WHEN b BETWEEN 8 AND 14 THEN writing_seconds ELSE 0 END) END, 3) AS last_week,
         round(sum(CASE WHEN b <= 30 THEN writing_seconds ELSE 0 END), 3) AS this_month,
         round(CASE WHEN count(*) >= 60 THEN sum(CASE WHEN b BETWEEN 31 AND 60 THEN writing_seconds ELSE 0 END) END, 3)::DOUBLE AS last_month
  FROM x GROUP BY 1""")
def _(spark, sf):
    r = f.period_over_period(f.day_history(log(spark, sf), today=TODAY, days=30, **OPTS))
    return r.select("session_id", *[rnd(F.col(c), 3).alias(c) for c in ("this_week", "last_week", "this_month", "last_month")])
