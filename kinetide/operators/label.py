"""Labelling samples from pen dots and markers, and cleaning the label track."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..kernels import Ordering, interval_join, islands, nearest_asof, quantiles, scan, with_chunks
from ..kernels.islands import state_changes
from ..kernels.order import CHUNK
from ..schema import LABEL_GAP_MS, LABEL_TOLERANCE_MS, SENSOR_CHUNK_MS, WRITING_DOTS
from .strokes import TIME, by_arrival

_WRITING = ", ".join(f"'{d}'" for d in WRITING_DOTS)


def pen_labels(pen: DataFrame, offset_ms: str = "0") -> DataFrame:
    """Pen dots on the watch clock with their writing flag."""
    return pen.filter("ts is not null").selectExpr(
        "session_id", "_ord", f"ts + {offset_ms} as ts", f"cast(dot_type in ({_WRITING}) as int) as pen_writing"
    )


def label_samples(
    watch: DataFrame, pen: DataFrame, *, tolerance: float = LABEL_TOLERANCE_MS,
    width: int = SENSOR_CHUNK_MS, max_rows: int | None = 1_000_000,
) -> DataFrame:
    """Each sample takes the writing flag of the nearest dot within the tolerance, else 0."""
    out = nearest_asof(
        watch, pen_labels(pen), ["session_id"], "ts", "_ord", ["pen_writing"],
        width=width, tolerance=tolerance, max_rows=max_rows,
    )
    return out.withColumn("label_writing", F.coalesce("r_pen_writing", F.lit(0))).drop(
        "r_ts", "r__ord", "r_pen_writing"
    )


def attach_tasks(
    samples: DataFrame, blocks: DataFrame, *, at: str = "ts", width: int = SENSOR_CHUNK_MS,
    how: str = "left",
) -> DataFrame:
    """Task columns of the block ``[start, end)`` a row falls into."""
    cols = [c for c in ("task_index", "task_id", "task_name", "task_category", "block") if c in blocks.columns]
    return interval_join(
        samples, blocks, ["session_id"], at, cols, width=width, how=how
    )


def close_labels(
    samples: DataFrame, label: str = "label", *, max_gap_ms: float = LABEL_GAP_MS, max_spike_ms: float = 0,
    width: int = SENSOR_CHUNK_MS, max_rows: int | None = 1_000_000,
) -> DataFrame:
    """Fill short interior idle runs and, if asked, erase short interior writing runs.

    Decided on the original runs; the first and last run of a session stay.
    Runs are summarised per chunk first, so one run holding most of a session
    is never gathered, and the decision returns on (run, chunk).
    """
    rows = with_chunks(samples.drop(CHUNK), ["session_id"], "ts", "_ord", width, max_rows)
    runs = islands(rows, TIME, [label], state_changes(label), "_run")
    part = runs.groupBy("session_id", "_run", CHUNK).agg(
        F.min("ts").alias("_t0"), F.max("ts").alias("_t1"), F.first(label).alias("_l")
    )
    whole = Window.partitionBy("session_id", "_run")
    last = part.groupBy("session_id").agg(F.max("_run").alias("_last"))
    flips = (
        part.withColumn("_len", F.max("_t1").over(whole) - F.min("_t0").over(whole))
        .join(last, "session_id").filter("_run > 1 and _run < _last")
        .filter(
            f"(_l = 0 and _len <= {max_gap_ms}) or (_l = 1 and {max_spike_ms} > 0 and _len <= {max_spike_ms})"
        )
        .select("session_id", "_run", CHUNK, (1 - F.col("_l")).alias("_new"))
    )
    return (
        runs.join(flips, ["session_id", "_run", CHUNK], "left")
        .withColumn(f"{label}_closed", F.coalesce("_new", label))
        .drop("_new", "_run", CHUNK)
    )


def writing_segments(
    samples: DataFrame, label: str = "label", *, width: int = SENSOR_CHUNK_MS, max_rows: int | None = 1_000_000
) -> DataFrame:
    """Ranges of label 1; each ends where the next idle sample starts, else at its own end."""
    rows = with_chunks(samples.drop(CHUNK), ["session_id"], "ts", "_ord", width, max_rows)
    nxt = scan(rows, TIME, nxt={"_n": ["ts"]}).withColumn("_next", F.col("_n.ts")).drop("_n")
    runs = islands(nxt, TIME, [label], state_changes(label), "_run")
    return (
        runs.filter(F.col(label) == 1).groupBy("session_id", "_run")
        .agg(F.min("ts").alias("start_ms"), F.max("ts").alias("_e"), F.max_by("_next", F.struct("ts", "_ord")).alias("_n"))
        .select("session_id", "start_ms", F.coalesce("_n", "_e").alias("end_ms"))
    )


def label_flips(
    watch: DataFrame, pen: DataFrame, *, shift_ms: float = 50, tolerance: float = LABEL_TOLERANCE_MS,
    width: int = SENSOR_CHUNK_MS, max_rows: int | None = 1_000_000,
) -> DataFrame:
    """Percent of labels that change when the pen clock is off by plus or minus ``shift_ms``.

    The three label tracks are one as-of join with the offset as an extra key.
    """
    offsets = F.explode(F.array(F.lit(-shift_ms), F.lit(0), F.lit(shift_ms))).alias("_off")
    w = watch.select("session_id", "_ord", "ts", offsets)
    p = pen_labels(pen).select("session_id", "_ord", "ts", "pen_writing", offsets)
    p = p.withColumn("ts", F.col("ts") + F.col("_off"))
    hit = nearest_asof(
        w, p, ["session_id", "_off"], "ts", "_ord", ["pen_writing"], width=width, tolerance=tolerance, max_rows=max_rows
    )
    labels = hit.groupBy("session_id", "_ord").agg(
        *[
            F.max(F.when(F.col("_off") == o, F.coalesce("r_pen_writing", F.lit(0)))).alias(n)
            for o, n in ((-shift_ms, "_lo"), (0, "_base"), (shift_ms, "_hi"))
        ]
    )
    return labels.groupBy("session_id").agg(
        (F.expr("avg(cast(_lo <> _base as int)) + avg(cast(_hi <> _base as int))") * 50.0).alias("flip_pct")
    )


def merge_quality(
    watch: DataFrame, pen: DataFrame, *, tolerance: float = LABEL_TOLERANCE_MS,
    width: int = SENSOR_CHUNK_MS, max_rows: int | None = 1_000_000,
) -> DataFrame:
    """Distance to the nearest dot, coverage within tolerance, raw and merged writing share."""
    near = nearest_asof(
        watch, pen_labels(pen), ["session_id"], "ts", "_ord", ["pen_writing"], width=width, max_rows=max_rows
    )
    q = quantiles(near, ["session_id"], "delta", {"dt_median": 0.5, "dt_p90": 0.9, "dt_p99": 0.99})
    agg = near.groupBy("session_id").agg(
        F.count("*").alias("samples"), F.max("delta").alias("dt_max"),
        F.avg(F.expr(f"coalesce(cast(delta <= {tolerance} as int), 0)")).alias("within_share"),
        F.avg(F.expr(f"case when delta <= {tolerance} then r_pen_writing else 0 end")).alias("merged_writing"),
    )
    raw = pen_labels(pen).groupBy("session_id").agg(F.avg("pen_writing").alias("raw_writing"))
    return agg.join(q, "session_id", "left").join(raw, "session_id", "left")


def stroke_density(pen: DataFrame) -> DataFrame:
    """Step lengths inside runs of writing dots and run durations, per session.

    Runs of fewer than two dots do not count.
    """
    flagged = pen.withColumn("_w", F.expr(f"cast(dot_type in ({_WRITING}) as int)"))
    rows = with_chunks(flagged.drop(CHUNK), ["session_id"], "ts", "_ord", SENSOR_CHUNK_MS * 144)
    rows = scan(rows, TIME, prev={"_p": ["ts", "_w"]})
    steps = rows.filter("_w = 1 and _p._w = 1").selectExpr("session_id", "ts - _p.ts as dt")
    runs = islands(rows.drop("_p"), TIME, ["_w"], state_changes("_w")).filter("_w = 1").groupBy("session_id", "island").agg(
        (F.max("ts") - F.min("ts")).alias("duration"), F.count("*").alias("_n")
    ).filter("_n >= 2")
    a = steps.groupBy("session_id").agg(
        F.avg("dt").alias("dt_mean"), F.max("dt").alias("dt_max"),
        F.avg(F.expr("cast(dt > 30 as int)")).alias("over_30_share"),
        F.avg(F.expr("cast(dt > 50 as int)")).alias("over_50_share"),
    )
    q = quantiles(steps, ["session_id"], "dt", {"dt_median": 0.5, "dt_p90": 0.9, "dt_p99": 0.99})
    d = runs.groupBy("session_id").agg(F.count("*").alias("strokes"), F.sum("duration").alias("writing_ms"))
    dq = quantiles(runs, ["session_id"], "duration", {"duration_median": 0.5})
    return d.join(dq, "session_id").join(a, "session_id").join(q, "session_id")


def change_only(stream: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose ``cols`` differ from the row delivered before them."""
    out = scan(by_arrival(stream.drop(CHUNK)), Ordering(("session_id",), ("_ord",)), prev={"_p": cols})
    cur = F.struct(*cols)
    return out.filter(F.col("_p").isNull() | ~F.col("_p").eqNullSafe(cur)).drop("_p", CHUNK)
