"""From raw streams to labelled samples: clock, replays, pen offset, nearest dot, task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import attach
from ..operators import align, clean, label, strokes
from ..schema import LABEL_TOLERANCE_MS, SENSOR_CHUNK_MS
from ..session import staged


def merge_sessions(
    watch: DataFrame, pen: DataFrame, markers: DataFrame | None = None, *, aligned: bool = True,
    tolerance: float = LABEL_TOLERANCE_MS, width: int = SENSOR_CHUNK_MS, max_rows: int | None = 1_000_000,
) -> DataFrame:
    """Every motion sample with ``label_writing``, the pen offset of its session and, with ``markers``, its task.

    ``watch`` and ``pen`` as ``coerce_watch`` and ``coerce_pen`` give them.  A sample stands at its own clock,
    at its arrival only where that is missing, and once however often it was delivered.  Dots stand at their
    arrival plus the offset that puts strokes on the calmest motion, where that is significant; a sample takes
    the flag of the nearest dot within ``tolerance``, else 0.  Sessions without dots or without an offset keep
    all their samples.
    """
    arrived = pen.filter("local_ts is not null").withColumn("ts", F.col("local_ts"))
    samples = watch.withColumn("_wall", F.coalesce("ts", "local_ts")).filter("_wall is not null")
    none = F.lit(None).cast("double")
    if aligned:
        # The search and the labels read both streams a dozen times: raw text is read and parsed once.
        samples, arrived = staged(samples, "merge-samples"), staged(arrived, "merge-dots")
        found = align.offset_search(samples.withColumn("ts", F.col("_wall")), arrived, width=width, max_rows=max_rows)
        found = staged(found.select("session_id", F.col("delta_applied").alias("pen_offset_s"), F.col("sigma").alias("pen_offset_sigma")), "pen-offsets")
        arrived = attach(arrived, found.select("session_id", "pen_offset_s"), ["session_id"], "left").withColumn(
            "ts", F.col("ts") + F.coalesce("pen_offset_s", F.lit(0.0)) * 1000.0).drop("pen_offset_s")
    once = clean.drop_replays(samples).withColumnRenamed("ts", "_own").withColumnRenamed("_wall", "ts")
    if aligned:
        once = staged(once, "merge-once")  # its chunks are counted before it is joined
    out = label.label_samples(once, arrived, tolerance=tolerance, width=width, max_rows=max_rows)
    if markers is not None:
        out = label.attach_tasks(out, strokes.task_timeline(markers), width=width)
    if aligned:
        out = attach(out, found, ["session_id"], "left").withColumn("pen_offset_s", F.coalesce("pen_offset_s", F.lit(0.0)))
    else:
        out = out.withColumn("pen_offset_s", F.lit(0.0)).withColumn("pen_offset_sigma", none)
    return out.drop("ts").withColumnRenamed("_own", "ts")
