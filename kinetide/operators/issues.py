"""Quality issues: a rule table evaluated over the facts of all sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import COVERAGE_MIN, PEN_IN_RANGE_MIN, SIGMA_OK, SIGMA_WEAK
from .quality import severity

_PCT_COVER, _PCT_PEN = f"{COVERAGE_MIN:.0%}", f"{PEN_IN_RANGE_MIN:.0%}"

# Issue codes with their two severities.
# code, what is checked, expectation, severity for training, severity for recording
SPECS = [
    ("no_watch_samples", "watch stream has samples", "rows > 0", "bad", "bad"),
    ("no_pen_samples", "pen stream has dots", "dots > 0", "bad", "warn"),
    ("watch_no_device_time", "watch device time is present", "rows with ts > 0", "bad", "bad"),
    ("pen_no_device_time", "pen device time is present", "dots with timestamp > 0", "bad", "bad"),
    ("missing_gyroscope", "rotation rate is present", "gyro rows > 0", "bad", "bad"),
    ("missing_accelerometer", "acceleration is present", "accel rows > 0", "bad", "bad"),
    ("watch_rate_out_of_range", "sample rate near a valid rate", "within 20 % of 50 or 100 Hz", "warn", "warn"),
    ("sequence_gaps", "no missing batch numbers", "gaps = 0", "warn", "warn"),
    ("duplicate_samples", "no sample delivered twice", "duplicates = 0", None, "warn"),
    ("sequence_counter_reset", "batch counter never steps back", "resets = 0", None, "warn"),
    ("watch_count_mismatch", "watch rows agree with the index", "within tolerance", None, "warn"),
    ("pen_count_mismatch", "pen dots agree with the index", "within tolerance", None, "warn"),
    ("legacy_pen_time", "pen rows carry receive time", "server time rows > 0", None, "warn"),
    ("legacy_watch_time", "watch rows carry receive time", "server time rows > 0", None, "warn"),
    ("low_watch_coverage", "watch rows cover the duration", f"at least {_PCT_COVER} of expected", "warn", "warn"),
    ("pen_clock_mismatch", "pen clock year equals session year", "information", None, None),
    ("pen_dots_outside_watch_range", "pen dots lie in the watch range", f"at least {_PCT_PEN}", "warn", None),
    ("watch_read_error", "watch file is readable", "no error", "bad", "bad"),
    ("pen_read_error", "pen file is readable", "no error", "bad", "bad"),
    ("streams_do_not_overlap", "watch and pen ranges overlap", "overlap > 0", "bad", "bad"),
    ("data_outside_session_window", "data lies in the session window", "start - 60 s to end + 60 s", "bad", "bad"),
    ("no_airpods_samples", "head stream has samples", "rows > 0", None, "warn"),
    ("legacy_airpods_time", "head rows carry receive time", "server time rows > 0", None, "warn"),
    ("low_airpods_coverage", "head rows cover the duration", f"at least {_PCT_COVER} of expected", None, "warn"),
    ("airpods_count_mismatch", "head rows agree with the index", "within tolerance", None, "warn"),
    ("low_sync_confidence", "alignment has a clear minimum", f"sigma <= {SIGMA_OK:g}", "warn", None),
    ("sync_failed", "alignment has any minimum", f"sigma <= {SIGMA_WEAK:g}", "bad", None),
    ("source_clocks_not_shared", "device clocks share an epoch", "gap < 1 s", None, None),
]
# Informative issues carry "info" in both scores.
OVERRIDES = {"pen_clock_mismatch": "info", "source_clocks_not_shared": "info"}

_OUTSIDE = (
    "(watch_start_ms < start_ms - 60000 or watch_end_ms > end_ms + 60000 "
    "or pen_start_ms < start_ms - 60000 or pen_end_ms > end_ms + 60000)"
)


def _mismatch(stream: str) -> str:
    return f"{stream}_count_delta > {stream}_count_tolerance"


# code, condition over facts, observed text, only for finished sessions
RULES = [
    ("watch_read_error", "watch_error is not null", "watch_error", False),
    ("pen_read_error", "pen_error is not null", "pen_error", False),
    ("no_watch_samples", "watch_rows = 0", "'0'", False),
    ("no_pen_samples", "pen_rows = 0", "'0'", False),
    ("watch_no_device_time", "watch_rows > 0 and watch_ts_rows = 0", "'0 rows'", False),
    ("pen_no_device_time", "pen_rows > 0 and pen_ts_rows = 0", "'0 rows'", False),
    ("missing_gyroscope", "watch_rows > 0 and gyro_rows = 0", "'0 rows'", False),
    ("missing_accelerometer", "watch_rows > 0 and accel_rows = 0", "'0 rows'", False),
    ("watch_rate_out_of_range", "not rate_ok", "concat(cast(round(fs_hz, 1) as string), ' Hz')", False),
    ("sequence_gaps", "sequence_gaps > 0", "concat(cast(sequence_gaps as string), ' in ', cast(gap_regions as string))", False),
    ("duplicate_samples", "duplicates > 0", "cast(duplicates as string)", False),
    ("sequence_counter_reset", "resets > 0", "cast(resets as string)", False),
    ("watch_count_mismatch", _mismatch("watch"), "concat(cast(watch_rows as string), ' vs ', cast(watch_samples as string))", True),
    ("pen_count_mismatch", _mismatch("pen"), "concat(cast(pen_rows as string), ' vs ', cast(pen_samples as string))", True),
    ("legacy_pen_time", "pen_rows > 0 and pen_server_rows = 0", "'0 rows'", False),
    ("legacy_watch_time", "watch_rows > 0 and watch_server_rows = 0", "'0 rows'", False),
    ("low_watch_coverage", f"expected_samples > 0 and watch_rows < expected_samples * {COVERAGE_MIN}D",
     "concat(cast(watch_rows as string), ' of ', cast(expected_samples as string))", True),
    ("pen_clock_mismatch", "size(years) > 0 and start_year is not null and not array_contains(years, start_year) and pen_server_rows = 0",
     "concat_ws(',', cast(slice(years, 1, 3) as array<string>))", False),
    ("pen_dots_outside_watch_range", f"in_range_pct < {PEN_IN_RANGE_MIN}D", "cast(round(in_range_pct, 3) as string)", False),
    ("no_airpods_samples", "airpods_exists and airpods_rows = 0", "'0'", False),
    ("legacy_airpods_time", "airpods_rows > 0 and airpods_server_rows = 0", "'0 rows'", False),
    ("low_airpods_coverage", f"airpods_exists and airpods_expected > 0 and airpods_rows < airpods_expected * {COVERAGE_MIN}D",
     "concat(cast(airpods_rows as string), ' of ', cast(airpods_expected as string))", True),
    ("airpods_count_mismatch", f"airpods_exists and {_mismatch('airpods')}",
     "concat(cast(airpods_rows as string), ' vs ', cast(airpods_samples as string))", True),
    ("sync_failed", f"sigma > {SIGMA_WEAK}", "cast(round(sigma, 2) as string)", True),
    ("low_sync_confidence", f"sigma > {SIGMA_OK} and sigma <= {SIGMA_WEAK}", "cast(round(sigma, 2) as string)", True),
    ("data_outside_session_window", _OUTSIDE, "'outside'", True),
]
# Only in the deeper validation view.
VALIDATION_RULES = [
    ("streams_do_not_overlap", "not streams_overlap", "'0 ms'", False),
    ("source_clocks_not_shared", "abs(clock_offset_gap_ms) > 1000",
     "concat(cast(round(abs(clock_offset_gap_ms) / 86400000.0D, 1) as string), ' d')", False),
]


def _spec_frame(df: DataFrame) -> DataFrame:
    rows = [
        (c, check, want, OVERRIDES.get(c, ml), OVERRIDES.get(c, rec)) for c, check, want, ml, rec in SPECS
    ]
    return df.sparkSession.createDataFrame(
        rows, "code string, check string, threshold string, ml_severity string, recording_severity string"
    )


def find_issues(facts: DataFrame, rules=None) -> DataFrame:
    """Long rows (session, code, observed, check, threshold, severities).

    All rules are evaluated in one projection per session; the 28-row rule table
    has a fixed size and is broadcast.
    """
    for extra in ("watch_error", "pen_error"):
        if extra not in facts.columns:
            facts = facts.withColumn(extra, F.lit(None).cast("string"))
    items = [
        f"case when coalesce(({cond}){' and not is_active' if finished else ''}, false) "
        f"then named_struct('code', '{code}', 'observed', {observed}) end"
        for code, cond, observed, finished in (rules or RULES)
    ]
    hits = facts.selectExpr("session_id", f"inline(filter(array({', '.join(items)}), x -> x is not null))")
    out = hits.join(F.broadcast(_spec_frame(facts)), "code")
    worst = F.greatest(severity(F.col("ml_severity")), severity(F.col("recording_severity")))
    names = F.array(*[F.lit(s) for s in ("info", "info", "warn", "bad")])
    return out.select(
        "session_id", "code", "observed", "check", "threshold", "ml_severity", "recording_severity",
        names[worst].alias("severity"),
    )


def score(sessions: DataFrame, issues: DataFrame) -> DataFrame:
    """Two status columns with the codes behind them; no issue means ok."""
    names = F.array(*[F.lit(s) for s in ("ok", "info", "warn", "bad")])
    cols = []
    for view, col in (("ml", "ml_severity"), ("recording", "recording_severity")):
        cols.append(F.max(severity(F.col(col))).alias(f"_{view}"))
        for bucket, sev in (("blockers", "bad"), ("warnings", "warn"), ("info", "info")):
            codes = F.array_sort(F.collect_list(F.when(F.col(col) == sev, F.col("code"))))
            cols.append(F.array_join(codes, ";").alias(f"{view}_{bucket}"))
    rolled = issues.groupBy("session_id").agg(*cols)
    out = sessions.select("session_id").join(rolled, "session_id", "left")
    return out.select(
        "session_id",
        *[names[F.coalesce(F.col(f"_{v}"), F.lit(0))].alias(f"{v}_status") for v in ("ml", "recording")],
        *[
            F.coalesce(F.col(f"{v}_{b}"), F.lit("")).alias(f"{v}_{b}")
            for v in ("ml", "recording") for b in ("blockers", "warnings", "info")
        ],
    )
