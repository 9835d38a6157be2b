"""Writing-time queries over the inference log (one row per scoring tick).

Columns in: session_id (log owner), ts, _ord, proba, writing.  All calendar
logic takes a time zone.  Rows per owner and calendar day are unbounded, so
runs of ticks use the chunked kernels; rows per owner *by day* are bounded by
the calendar and use plain windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import Ordering, interval_join, summarise_islands
from ..kernels.islands import gap_exceeds
from ..kernels.order import row_numbers
from ..schema import STRETCH_GAP_MS, STRETCH_MIN_SECONDS

DAYS_MIN, DAYS_MAX = 1, 365
BINS_MAX = 24


def with_day(log: DataFrame, zone: str = "UTC") -> DataFrame:
    local = F.from_utc_timestamp(F.timestamp_millis("ts"), zone)
    return log.withColumn("day", F.to_date(local)).withColumn("hour", F.hour(local))


def stretches(
    log: DataFrame,
    *,
    max_gap_ms: float = STRETCH_GAP_MS,
    min_seconds: float = STRETCH_MIN_SECONDS,
    zone: str = "UTC",
    count_ticks: bool = False,
) -> DataFrame:
    """Runs of writing ticks inside one local day; idle ticks within the gap are forgiven.

    ``count_ticks`` adds ``n_ticks``: every tick, idle ones included, from start to end.
    """
    seq = Ordering(("session_id", "day"), ("ts", "_ord"))
    ticks = with_day(log, zone)
    counted = []
    if count_ticks:
        ticks = row_numbers(ticks, seq)
        counted = [(F.max("rn") - F.min("rn") + 1).alias("n_ticks")]
    runs = summarise_islands(
        ticks.filter(F.col("writing") == 1), seq, ["ts"], gap_exceeds("ts", max_gap_ms),
        [
            F.min("ts").alias("start_ms"), F.max("ts").alias("end_ms"), *counted,
        ],
    )
    return (
        runs.withColumn("duration_s", (F.col("end_ms") - F.col("start_ms")) / 1000.0)
        .filter(F.col("duration_s") >= min_seconds)
        .drop("island")
    )


def intensity(
    log: DataFrame, runs: DataFrame, *, width: int, zone: str = "UTC"
) -> DataFrame:
    """Mean probability in up to 24 equal bins of each stretch; empty bins repeat the last one."""
    key = ["session_id", "day", "start_ms"]
    blocks = runs.withColumn("_to", F.col("end_ms") + 1)
    hits = interval_join(
        with_day(log, zone), blocks, ["session_id", "day"], "ts", ["start_ms", "end_ms", "n_ticks"],
        end="_to", width=width, how="inner",
    )
    n_bins = F.least(F.lit(BINS_MAX), F.col("n_ticks"))
    span = F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms"))
    at = F.floor((F.col("ts") - F.col("start_ms")) / span * n_bins)
    means = (
        hits.withColumn("bin", F.least(n_bins - 1, at))
        .groupBy(*key, "bin").agg(F.avg("proba").alias("_mean"))
    )
    grid = runs.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), n_bins - 1)).alias("bin"))
    # At most 24 rows per stretch.
    fill = Window.partitionBy(*key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    value = F.coalesce(F.last("_mean", ignorenulls=True).over(fill), F.lit(0.0))
    return grid.join(means, [*key, "bin"], "left").select(
        *key, "bin", F.round(value, 3).alias("intensity")
    )


def day_report(log: DataFrame, date: str, *, zone: str = "UTC", **options) -> DataFrame:
    """Ticks, stretches and writing seconds of one local day, per log owner."""
    local = with_day(log, zone).filter(F.col("day") == F.to_date(F.lit(date)))
    ticks = local.groupBy("session_id").agg(F.count("*").alias("tick_count"))
    runs = stretches(local.drop("day", "hour"), zone=zone, **options)
    total = runs.groupBy("session_id").agg(
        F.count("*").alias("n_stretches"), F.sum("duration_s").alias("_s"),
        F.max("duration_s").alias("longest_s"),
    )
    return ticks.join(total, "session_id", "left").select(
        "session_id", "tick_count",
        F.coalesce("n_stretches", F.lit(0).cast("long")).alias("n_stretches"),
        F.round(F.coalesce("_s", F.lit(0.0)), 1).alias("total_writing_seconds"),
        F.coalesce("longest_s", F.lit(0.0)).alias("longest_s"),
    )


def day_grid(owners: DataFrame, today: str, days: int) -> DataFrame:
    """Every owner with each of the last ``days`` days (clamped to 1..365)."""
    n = max(DAYS_MIN, min(days, DAYS_MAX))
    last = F.to_date(F.lit(today))
    return owners.withColumn("day", F.explode(F.sequence(F.date_sub(last, n - 1), last)))


def day_history(
    log: DataFrame, *, today: str, days: int = 7, zone: str = "UTC", **options
) -> DataFrame:
    """Writing seconds per local day, exactly ``days`` rows per owner, gaps as zero."""
    n = max(DAYS_MIN, min(days, DAYS_MAX))
    lower = F.date_sub(F.to_date(F.lit(today)), n - 1)
    kept = with_day(log, zone).filter(F.col("day").between(lower, F.to_date(F.lit(today))))
    sums = (
        stretches(kept.drop("day", "hour"), zone=zone, **options)
        .groupBy("session_id", "day").agg(F.round(F.sum("duration_s"), 1).alias("_s"))
    )
    grid = day_grid(log.select("session_id").distinct(), today, days)
    per_owner = Window.partitionBy("session_id")  # at most 365 rows
    return (
        grid.join(sums, ["session_id", "day"], "left")
        .withColumn("writing_seconds", F.coalesce("_s", F.lit(0.0)))
        .select(
            "session_id", F.date_format("day", "yyyy-MM-dd").alias("date"),
            F.date_format("day", "E").alias("weekday"), "writing_seconds",
            (F.col("day") == F.to_date(F.lit(today))).alias("is_today"),
            F.max("writing_seconds").over(per_owner).alias("max_seconds"),
        )
    )


def time_of_day(
    log: DataFrame, *, today: str, days: int = 7, zone: str = "UTC", tick_seconds: float = 1.0
) -> DataFrame:
    """Writing seconds per hour of day over the last ``days`` days, 24 rows per owner."""
    n = max(DAYS_MIN, min(days, DAYS_MAX))
    last = F.to_date(F.lit(today))
    ticks = with_day(log, zone).filter(
        (F.col("writing") == 1) & F.col("day").between(F.date_sub(last, n - 1), last)
    )
    counts = ticks.groupBy("session_id", "hour").agg((F.count("*") * F.lit(tick_seconds)).alias("_s"))
    grid = log.select("session_id").distinct().withColumn(
        "hour", F.explode(F.sequence(F.lit(0), F.lit(23)))
    )
    return grid.join(counts, ["session_id", "hour"], "left").select(
        "session_id", "hour", F.coalesce("_s", F.lit(0.0)).alias("seconds"),
        F.coalesce(F.max("_s").over(Window.partitionBy("session_id")), F.lit(0.0)).alias("max_seconds"),
    )


def goal_progress(daily: DataFrame, goal_seconds: float) -> DataFrame:
    """Clamped fraction, rounded percent and met flag of a daily goal."""
    if goal_seconds <= 0:
        return daily.select(
            "*", F.lit(0.0).alias("fraction"), F.lit(0).cast("long").alias("percent"),
            F.lit(False).alias("is_met"),
        )
    raw = F.col("writing_seconds") / F.lit(float(goal_seconds))
    return daily.select(
        "*", F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)).alias("fraction"),
        F.round(raw * 100).cast("long").alias("percent"),
        (F.col("writing_seconds") >= goal_seconds).alias("is_met"),
    )


def goal_streaks(daily: DataFrame, goal_seconds: float, today: str) -> DataFrame:
    """Current and longest run of days that met the goal.

    ``daily`` is gap-free per owner.  An unmet today does not end the current run.
    """
    met = goal_progress(daily, goal_seconds).withColumn("_d", F.to_date("date"))
    w = Window.partitionBy("session_id").orderBy("_d")
    runs = (
        met.filter("is_met")
        .withColumn("_g", F.date_sub("_d", F.row_number().over(w)))
        .groupBy("session_id", "_g")
        .agg(F.count("*").alias("_len"), F.max("_d").alias("_to"))
    )
    now = F.to_date(F.lit(today))
    live = F.col("_to").isin(now, F.date_sub(now, 1))
    best = runs.groupBy("session_id").agg(
        F.max("_len").alias("longest"), F.max(F.when(live, F.col("_len"))).alias("current")
    )
    zero = F.lit(0).cast("long")
    return daily.select("session_id").distinct().join(best, "session_id", "left").select(
        "session_id", F.coalesce("current", zero).alias("current_streak"),
        F.coalesce("longest", zero).alias("longest_streak"),
    )


def period_over_period(daily: DataFrame) -> DataFrame:
    """This and last week, this and last 30 days; earlier periods need enough days."""
    back = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("date")))
    x = F.col("writing_seconds")
    span = lambda lo, hi: F.sum(F.when((F.col("_b") > lo) & (F.col("_b") <= hi), x).otherwise(0.0))
    n = F.count("*")
    return daily.withColumn("_b", back).groupBy("session_id").agg(
        span(0, 7).alias("this_week"),
        F.when(n >= 14, span(7, 14)).alias("last_week"),
        span(0, 30).alias("this_month"),
        F.when(n >= 60, span(30, 60)).alias("last_month"),
    )
