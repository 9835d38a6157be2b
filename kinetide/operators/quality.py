"""Recording quality: clocks, rates, batch sequences, facts, verdicts and views.

Everything is computed for all sessions at once; a report on one session is a
filter on these frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import Ordering, attach, mad, quantiles, scan
from ..kernels.order import CHUNK
from ..schema import (
    COUNT_TOLERANCE_FLOOR, COUNT_TOLERANCE_SHARE, GRAVITY, HEAD_RATE_HZ, RATE_TOLERANCE,
    SIGMA_TRAINABLE, TRAINABLE_SECONDS,
)
from ..session import staged
from .strokes import ARRIVAL, by_arrival, pen_intervals

BATCH_CHUNK = 1 << 16
HEAT_BINS = 200


# ── clocks and rates ─────────────────────────────────────────────────────────

def clock_summary(stream: DataFrame) -> DataFrame:
    """Local and device time range, offset statistics and drift per session."""
    pos = F.col("_ord")
    offset = F.col("local_ts") - F.col("ts")
    ends = stream.groupBy("session_id").agg(
        F.min("local_ts").alias("start_ms"), F.max("local_ts").alias("end_ms"),
        F.min("ts").alias("source_start_ms"), F.max("ts").alias("source_end_ms"),
        F.count("*").alias("rows"), F.count("local_ts").alias("rows_with_local_ts"),
        F.count("ts").alias("rows_with_source_ts"),
        F.min_by(offset, F.when(offset.isNotNull(), pos)).alias("offset_start_ms"),
        F.max_by(offset, F.when(offset.isNotNull(), pos)).alias("offset_end_ms"),
        F.min(offset).alias("offset_min_ms"), F.max(offset).alias("offset_max_ms"),
    )
    spread = mad(stream.select("session_id", offset.alias("_off")), ["session_id"], "_off", "offset_mad_ms")
    return ends.join(spread, "session_id", "left").selectExpr(
        "session_id", "rows", "start_ms", "end_ms", "source_start_ms", "source_end_ms",
        "case when rows_with_local_ts > 1 then round((end_ms - start_ms) / 1000.0D, 3) end as duration_seconds",
        "case when rows_with_source_ts > 1 then round((source_end_ms - source_start_ms) / 1000.0D, 3) end "
        "as source_duration_seconds",
        "offset_start_ms", "offset_end_ms", "offset_end_ms - offset_start_ms as drift_ms",
        "round(median, 3) as offset_median_ms", "offset_min_ms", "offset_max_ms",
        "round(offset_mad_ms, 3) as offset_mad_ms", "rows_with_local_ts", "rows_with_source_ts",
    )


def rate_from_span(stream: DataFrame, fallback: float = 50.0) -> DataFrame:
    """(n - 1) per second of the device time range."""
    return stream.groupBy("session_id").agg(
        F.expr(
            "case when count(ts) > 1 and max(ts) > min(ts) "
            f"then (count(ts) - 1) * 1000.0D / (max(ts) - min(ts)) else {float(fallback)}D end"
        ).alias("fs_hz")
    )


def rate_from_diffs(stream: DataFrame, *, mode: str = "positive") -> DataFrame:
    """1000 over the median step in arrival order.

    ``positive`` ignores steps that do not move forward; ``absolute`` uses their
    size and reads steps below 0.5 as seconds.
    """
    rows = scan(by_arrival(stream.filter("ts is not null").select("session_id", "ts", "_ord")), ARRIVAL, prev={"_p": ["ts"]})
    steps = rows.selectExpr("session_id", "ts - _p.ts as dt").filter("dt is not null")
    if mode == "positive":
        steps = steps.filter("dt > 0")
        rate = "1000.0D / median_dt_ms"
    else:
        steps = steps.withColumn("dt", F.abs("dt"))
        rate = "case when median_dt_ms >= 0.5 then 1000.0D / median_dt_ms when median_dt_ms > 0 then 1.0D / median_dt_ms end"
    return quantiles(steps, ["session_id"], "dt", {"median_dt_ms": 0.5}).selectExpr("*", f"{rate} as fs_hz")


def nearest_rate(hz: str) -> str:
    """SQL for the closer of the two valid rates, 50 when not observable."""
    return f"case when {hz} is null or abs({hz} - 50) <= abs({hz} - 100) then 50.0D else 100.0D end"


def rate_in_range(hz: str) -> str:
    return f"({hz} is null or abs({hz} - ({nearest_rate(hz)})) / ({nearest_rate(hz)}) <= {RATE_TOLERANCE})"


def detect_profile(samples: DataFrame) -> DataFrame:
    """Profile name from content; NULL when the rate fits no valid one."""
    grav = [c for c in GRAVITY if c in samples.columns]
    has = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in grav]) if len(grav) == 3 else F.lit(False)
    gravity = samples.groupBy("session_id").agg(F.bool_or(has).alias("has_gravity"))
    rate = rate_from_diffs(samples, mode="absolute")
    return gravity.join(rate, "session_id", "left").selectExpr(
        "session_id", "fs_hz", "has_gravity",
        f"case when fs_hz is not null and {rate_in_range('fs_hz')} then concat("
        f"cast(cast({nearest_rate('fs_hz')} as int) as string), 'hz', if(has_gravity, '_grav', '')) end as profile",
    )


# ── batch sequences ──────────────────────────────────────────────────────────

def batches(watch: DataFrame) -> DataFrame:
    """One row per (session, batch number)."""
    known = F.when(F.col("local_ts").isNotNull(), F.col("_ord"))
    return watch.filter("sequence is not null").groupBy("session_id", "sequence").agg(
        F.count("*").alias("batch_size"), F.min("_ord").alias("first_ord"),
        F.min_by("local_ts", known).alias("first_local_ms"), F.max_by("local_ts", known).alias("last_local_ms"),
    )


def gap_regions(watch: DataFrame) -> DataFrame:
    """Numbers never seen between the lowest and highest, as regions."""
    b = batches(watch).withColumn(CHUNK, F.floor(F.col("sequence") / BATCH_CHUNK))
    out = scan(b, Ordering(("session_id",), ("sequence",)), nxt={"_n": ["sequence"]})
    return out.filter("_n.sequence - sequence > 1").selectExpr(
        "session_id", "sequence as after_seq", "_n.sequence as next_seq",
        "_n.sequence - sequence - 1 as missing", "first_local_ms as around_local_ts_ms",
    )


def sequence_summary(watch: DataFrame) -> DataFrame:
    regions = gap_regions(watch).groupBy("session_id").agg(
        F.sum("missing").alias("sequence_gaps"), F.count("*").alias("gap_regions")
    )
    b = batches(watch).groupBy("session_id").agg(
        F.count("*").alias("sequence_batches"), F.max("batch_size").alias("max_batch_size"),
        F.min("sequence").alias("seq_min"), F.max("sequence").alias("seq_max"),
    )
    return b.join(regions, "session_id", "left").na.fill(0, ["sequence_gaps", "gap_regions"])


def arrival_runs(watch: DataFrame) -> DataFrame:
    """First row of each run of one batch number in arrival order, with the number before."""
    rows = watch.filter("sequence is not null").select("session_id", "_ord", "sequence", "local_ts")
    out = scan(by_arrival(rows), ARRIVAL, prev={"_p": ["sequence"]})
    return out.filter("_p is null or _p.sequence <> sequence").selectExpr(
        "session_id", "_ord", "sequence", "_p.sequence as prev_sequence"
    )


def arrival_gaps(watch: DataFrame) -> DataFrame:
    """Steps of more than one between consecutive runs in arrival order."""
    b = batches(watch)
    after = b.selectExpr("session_id", "sequence as prev_sequence", "last_local_ms as after_local_ts_ms")
    before = b.selectExpr("session_id", "sequence", "first_local_ms as before_local_ts_ms")
    gaps = arrival_runs(watch).filter("sequence > prev_sequence + 1")
    return gaps.join(after, ["session_id", "prev_sequence"], "left").join(before, ["session_id", "sequence"], "left").selectExpr(
        "session_id", "_ord", "prev_sequence as after_seq", "sequence as next_seq",
        "sequence - prev_sequence - 1 as missing", "after_local_ts_ms", "before_local_ts_ms",
    )


def arrival_summary(watch: DataFrame) -> DataFrame:
    """Run, expected and missing batch counts with the batch size spread."""
    runs = arrival_runs(watch).groupBy("session_id").agg(
        F.count("*").alias("runs"), F.min("sequence").alias("seq_min"), F.max("sequence").alias("seq_max"),
        F.sum(F.expr("greatest(sequence - prev_sequence - 1, 0)")).alias("missing"),
    )
    sizes = batches(watch).groupBy("session_id").agg(
        F.min("batch_size").alias("size_min"), F.max("batch_size").alias("size_max"),
        F.avg("batch_size").alias("size_mean"),
    )
    return runs.join(sizes, "session_id").selectExpr(
        "session_id", "runs", "seq_min", "seq_max", "seq_max - seq_min + 1 as expected_batches",
        "coalesce(missing, 0) as missing_batches", "size_min", "size_max", "size_mean",
    )


def counter_resets(watch: DataFrame) -> DataFrame:
    """Runs that step back to a number already used."""
    first = batches(watch).select("session_id", "sequence", "first_ord")
    back = arrival_runs(watch).filter("sequence < prev_sequence")
    return (
        back.join(first, ["session_id", "sequence"]).filter("first_ord < _ord")
        .groupBy("session_id").agg(F.count("*").alias("resets"))
    )


def duplicate_samples(watch: DataFrame) -> DataFrame:
    """Extra deliveries of one (ts, magnitudes); copies collapse before the shuffle."""
    groups = watch.filter("ts is not null").groupBy("session_id", "ts", "acc_mag", "gyro_mag", "grav_mag").count()
    return groups.groupBy("session_id").agg(F.sum(F.col("count") - 1).alias("duplicates"))


def completeness(watch: DataFrame) -> DataFrame:
    return watch.groupBy("session_id").agg(
        F.count("*").alias("watch_rows"), F.count("ts").alias("watch_ts_rows"),
        F.count("acc_mag").alias("accel_rows"), F.count("gyro_mag").alias("gyro_rows"),
        F.count("grav_mag").alias("gravity_rows"),
        F.count_if(F.col("has_server_ms")).alias("watch_server_rows"),
    )


# ── ranges ───────────────────────────────────────────────────────────────────

def containment(pen: DataFrame, watch_clock: DataFrame) -> DataFrame:
    """Share of pen dots inside the watch's local time range."""
    span = watch_clock.select("session_id", "start_ms", "end_ms")
    inside = F.expr("coalesce(cast(local_ts between start_ms and end_ms as int), 0)")
    return (
        attach(pen.filter("local_ts is not null"), span, ["session_id"], "left")
        .groupBy("session_id").agg(F.avg(inside).alias("in_range_pct"))
    )


def overlap_seconds(a: str, b: str) -> str:
    """Common wall-clock seconds of two clocks' ranges; zero when apart."""
    return (
        f"round(greatest(0.0D, (least({a}.end_ms, {b}.end_ms) - greatest({a}.start_ms, {b}.start_ms)) / 1000.0D), 3)"
    )


def writing_time(pen: DataFrame, pen_clock: DataFrame) -> DataFrame:
    total = pen_intervals(pen).groupBy("session_id").agg(F.sum("duration_ms").alias("_ms"))
    return pen_clock.select("session_id", "duration_seconds").join(total, "session_id", "left").selectExpr(
        "session_id", "round(coalesce(_ms, 0) / 1000.0D, 3) as writing_seconds",
        "case when duration_seconds > 0 then round(coalesce(_ms, 0) / 1000.0D, 3) / duration_seconds end as writing_fraction",
    )


def count_check(actual: str, indexed: str) -> tuple[str, str]:
    """SQL for |disk - index| and its tolerance."""
    delta = f"abs({actual} - {indexed})"
    tol = (
        f"greatest({COUNT_TOLERANCE_FLOOR}, cast(floor(greatest({actual}, {indexed}) * {COUNT_TOLERANCE_SHARE}D) as bigint))"
    )
    return delta, tol


def clock_years(pen: DataFrame) -> DataFrame:
    year = F.expr("year(timestamp_millis(ts))")
    return pen.filter("ts is not null").groupBy("session_id").agg(
        F.array_sort(F.collect_set(year)).alias("years")
    ).selectExpr("session_id", "years", "years[0] as year_min", "element_at(years, -1) as year_max")


def activity_lane(watch: DataFrame, clock: DataFrame, bins: int = HEAT_BINS) -> DataFrame:
    """RMS acceleration in equal time bins over the local range, relative to the peak bin."""
    span = clock.filter("end_ms > start_ms").select("session_id", "start_ms", "end_ms")
    at = "cast(floor((local_ts - start_ms) / ((end_ms - start_ms) / {n}D)) as int)".format(n=float(bins))
    rms = (
        attach(watch, span, ["session_id"]).filter("local_ts >= start_ms and local_ts < end_ms")
        .selectExpr("session_id", f"{at} as bin", "ax*ax + ay*ay + az*az as _sq").filter(f"bin < {bins}")
        .groupBy("session_id", "bin").agg(F.sqrt(F.avg("_sq")).alias("rms"))
    )
    # At most ``bins`` levels per session, looked up in place: a grid of bins would be a join side far above its estimate.
    lanes = rms.filter("session_id is not null").groupBy("session_id").agg(
        F.max("rms").alias("peak"), F.map_from_entries(F.collect_list(F.struct("bin", "rms"))).alias("_levels")
    ).filter("peak > 0")
    return lanes.select("session_id", "peak", "_levels", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).selectExpr(
        "session_id", "bin", "round(coalesce(_levels[bin], 0.0D) / peak, 3) as level"
    )


# ── facts, verdict, views ────────────────────────────────────────────────────

def session_facts(
    sessions: DataFrame, watch: DataFrame, pen: DataFrame, airpods: DataFrame | None = None,
    sync: DataFrame | None = None,
) -> DataFrame:
    """One wide row per session with everything the issue rules look at.

    sessions   session_id, status, start_ms, end_ms, watch_samples, pen_samples, airpods_samples
    airpods    stream_summary rows;  sync: session_id, sigma, delta_ms
    """
    # One row per session each, read by several facts.
    wc, pc = staged(clock_summary(watch), "watch-clock"), staged(clock_summary(pen), "pen-clock")
    pen_rows = pen.groupBy("session_id").agg(
        F.count("*").alias("pen_rows"), F.count("ts").alias("pen_ts_rows"),
        F.count_if(F.col("has_local_ts_ms")).alias("pen_server_rows"),
    )
    side = lambda df, p: df.selectExpr(
        "session_id", *[f"{c} as {p}_{c}" for c in (
            "start_ms", "end_ms", "source_start_ms", "source_end_ms", "duration_seconds",
            "source_duration_seconds", "drift_ms", "offset_median_ms",
        )]
    )
    parts = [
        completeness(watch), pen_rows, side(wc, "watch"), side(pc, "pen"),
        rate_from_diffs(watch).select("session_id", "median_dt_ms", "fs_hz"), sequence_summary(watch),
        counter_resets(watch), duplicate_samples(watch), writing_time(pen, pc),
        clock_years(pen).select("session_id", "years"), containment(pen, wc),
    ]
    if airpods is not None:
        parts.append(airpods.selectExpr(
            "session_id", "row_count as airpods_rows", "server_time_rows as airpods_server_rows",
            "true as airpods_exists",
        ))
    if sync is not None:
        parts.append(sync.select("session_id", "sigma", "delta_ms"))
    out = reduce(lambda a, b: a.join(b, "session_id", "left"), parts, sessions)
    if airpods is None:
        out = out.selectExpr("*", "0L as airpods_rows", "0L as airpods_server_rows", "false as airpods_exists")
    if sync is None:
        out = out.selectExpr("*", "cast(null as double) as sigma", "cast(null as double) as delta_ms")
    zero = [
        "watch_rows", "watch_ts_rows", "accel_rows", "gyro_rows", "gravity_rows", "watch_server_rows", "pen_rows",
        "pen_ts_rows", "pen_server_rows", "sequence_gaps", "gap_regions", "resets", "duplicates", "airpods_rows",
        "airpods_server_rows", "watch_samples", "pen_samples", "airpods_samples",
    ]
    expected = "coalesce(watch_source_duration_seconds, duration_seconds)"
    return out.na.fill(0, zero).na.fill(False, ["airpods_exists"]).selectExpr(
        "*", "status = 'active' as is_active",
        "case when end_ms > start_ms then (end_ms - start_ms) / 1000.0D end as duration_seconds",
        f"{nearest_rate('fs_hz')} as target_hz",
        f"{rate_in_range('fs_hz')} as rate_ok",
        *[
            f"{sql} as {s}_count_{n}"
            for s in ("watch", "pen", "airpods")
            for n, sql in zip(("delta", "tolerance"), count_check(f"{s}_rows", f"{s}_samples"))
        ],
        "case when watch_start_ms is not null and pen_start_ms is not null then round(greatest(0.0D, "
        "(least(watch_end_ms, pen_end_ms) - greatest(watch_start_ms, pen_start_ms)) / 1000.0D), 3) end as common_overlap_seconds",
        "year(timestamp_millis(start_ms)) as start_year",
    ).selectExpr(
        "*", f"cast(floor({expected} * target_hz) as bigint) as expected_samples",
        f"cast(floor({expected} * {HEAD_RATE_HZ}D) as bigint) as airpods_expected",
        "watch_start_ms <= pen_end_ms and pen_start_ms <= watch_end_ms as streams_overlap",
        "pen_offset_median_ms - watch_offset_median_ms as clock_offset_gap_ms",
        "pen_drift_ms - watch_drift_ms as relative_drift_ms",
    )


def verdicts(facts: DataFrame, issues: DataFrame, scores: DataFrame) -> DataFrame:
    """skip / trainable / usable with the index columns of each session."""
    codes = issues.groupBy("session_id").agg(
        F.array_join(F.array_sort(F.collect_set("code")), ";").alias("issue_codes"),
        F.bool_or(F.col("code").isin("sync_failed", "streams_do_not_overlap")).alias("_blocked"),
    )
    s = scores.select("session_id", "ml_status", "recording_status")
    return facts.join(s, "session_id", "left").join(codes, "session_id", "left").selectExpr(
        "session_id", "coalesce(ml_status, 'ok') as ml_status", "coalesce(recording_status, 'ok') as recording_status",
        "round(duration_seconds, 1) as duration_seconds", "round(sigma, 2) as alignment_sigma",
        "case when coalesce(flagged, '') = 'yes' then 'skip' "
        "when coalesce(ml_status, 'ok') = 'bad' or coalesce(_blocked, false) then 'skip' "
        f"when coalesce(ml_status, 'ok') = 'ok' and sigma <= {SIGMA_TRAINABLE} and duration_seconds >= {TRAINABLE_SECONDS} "
        "then 'trainable' else 'usable' end as verdict",
        "coalesce(issue_codes, '') as issue_codes",
        "case when fs_hz is not null and rate_ok then concat(cast(cast(target_hz as int) as string), 'hz', "
        "if(gravity_rows > 0, '_grav', '')) else '' end as watch_profile",
    )


def validation(facts: DataFrame) -> DataFrame:
    """Stream offsets, drifts and the chart frame of each session."""
    return facts.selectExpr(
        "session_id", "pen_start_ms - watch_start_ms as start_offset_ms", "watch_end_ms - pen_end_ms as end_offset_ms",
        "streams_overlap", "round(in_range_pct, 4) as in_range_pct", "common_overlap_seconds",
        "round(relative_drift_ms, 3) as relative_drift_ms", "round(clock_offset_gap_ms, 3) as clock_offset_gap_ms",
        "least(watch_start_ms, pen_start_ms) as session_start_ms",
        "round((watch_start_ms - least(watch_start_ms, pen_start_ms)) / 1000.0D, 3) as watch_start_s",
        "round((watch_end_ms - least(watch_start_ms, pen_start_ms)) / 1000.0D, 3) as watch_end_s",
        "round((pen_start_ms - least(watch_start_ms, pen_start_ms)) / 1000.0D, 3) as pen_start_s",
        "round((pen_end_ms - least(watch_start_ms, pen_start_ms)) / 1000.0D, 3) as pen_end_s",
        "round((greatest(watch_end_ms, pen_end_ms) - least(watch_start_ms, pen_start_ms)) / 1000.0D, 3) as duration_s",
    )


def chart_intervals(pen: DataFrame, facts: DataFrame) -> DataFrame:
    """Pen intervals in seconds from the first stream start."""
    start = facts.selectExpr("session_id", "least(watch_start_ms, pen_start_ms) as _t0").filter("_t0 is not null")
    return (
        pen_intervals(pen).filter("local_start_ms is not null and local_end_ms is not null")
        .join(start, "session_id").selectExpr(
            "session_id", "round((local_start_ms - _t0) / 1000.0D, 3) as start_s",
            "round((local_end_ms - _t0) / 1000.0D, 3) as end_s",
            "round(greatest(0, local_end_ms - local_start_ms) / 1000.0D, 3) as duration_s", "dot_count",
        )
    )


def quality_summary(scores: DataFrame) -> DataFrame:
    """Sessions per status, for both scores."""
    both = scores.selectExpr("stack(2, 'ml', ml_status, 'recording', recording_status) as (score, status)")
    return both.groupBy("score").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "info", "warn", "bad")]
    )


def merge_issues(primary: DataFrame, other: DataFrame) -> DataFrame:
    """All primary issues plus those whose code the session does not have yet."""
    extra = other.join(primary.select("session_id", "code"), ["session_id", "code"], "left_anti")
    return primary.unionByName(extra.select(primary.columns))


def severity(c: Column) -> Column:
    return F.when(c == "bad", 3).when(c == "warn", 2).when(c == "info", 1).otherwise(0)
