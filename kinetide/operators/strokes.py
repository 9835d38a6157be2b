"""Pen strokes, pen intervals and marker pairings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import Ordering, scan, with_chunks
from ..kernels.order import CHUNK
from ..schema import SENSOR_CHUNK_MS

ARRIVAL = Ordering(("session_id",), ("_ord",))
TIME = Ordering(("session_id",), ("ts", "_ord"))
ARRIVAL_CHUNK = 1 << 20
RECONSTRUCT_AFTER_MS = 5000


def by_arrival(df: DataFrame) -> DataFrame:
    """Chunks of the arrival ordinal; unique ordinals bound their size."""
    return with_chunks(df, ["session_id"], "_ord", "_ord", ARRIVAL_CHUNK, None)


def stroke_ids(
    pen: DataFrame, *, width: int = SENSOR_CHUNK_MS, max_rows: int | None = 1_000_000
) -> DataFrame:
    """Stroke number = DOWN events so far minus one; invalid moves and leading dots are dropped."""
    dots = pen.filter(
        "dot_type = 'PEN_DOWN' or dot_type = 'PEN_UP' "
        "or (dot_type = 'PEN_MOVE' and x <> -1 and y <> -1)"
    )
    dots = with_chunks(dots.drop(CHUNK), ["session_id"], "ts", "_ord", width, max_rows)
    down = F.when(F.col("dot_type") == "PEN_DOWN", 1).otherwise(0)
    return scan(dots, TIME, sums={"_n": down}).filter("_n > 0").selectExpr("*", "_n - 1 as stroke_id").drop("_n")


def strokes(dots: DataFrame) -> DataFrame:
    """Time span and size of each stroke."""
    return dots.groupBy("session_id", "stroke_id").agg(
        F.min("ts").alias("start_ms"), F.max("ts").alias("end_ms"), F.count("*").alias("dot_count")
    )


def pen_intervals(pen: DataFrame) -> DataFrame:
    """DOWN..UP spans in arrival order; a second DOWN restarts, orphans are ignored."""
    inside = F.when(F.col("dot_type").isin("PEN_MOVE", "PEN_HOVER"), 1).otherwise(0)
    counted = scan(by_arrival(pen), ARRIVAL, sums={"_moves": inside})
    edges = counted.filter(F.col("dot_type").isin("PEN_DOWN", "PEN_UP")).selectExpr(
        "*", "dot_type = 'PEN_DOWN' and ts is not null as _opens"
    )
    paired = scan(edges, ARRIVAL, prev={"_d": ["_opens", "ts", "local_ts", "_moves"]})
    return paired.filter("dot_type = 'PEN_UP' and _d._opens").selectExpr(
        "session_id", "_d.ts as source_start_ms", "coalesce(ts, _d.ts) as source_end_ms",
        "_d.local_ts as local_start_ms", "coalesce(local_ts, _d.local_ts) as local_end_ms",
        "greatest(0, coalesce(ts, _d.ts) - _d.ts) as duration_ms",
        "_moves - _d._moves + 2 as dot_count",
    )


def marker_blocks(markers: DataFrame) -> DataFrame:
    """State machine: a start opens (and replaces an open one), an end, abort or study end closes."""
    edges = markers.filter(F.col("event").isin("task_start", "task_end", "abort", "study_end"))
    edges = with_chunks(edges, ["session_id"], "timestamp_ms", "_ord", SENSOR_CHUNK_MS * 144)
    seq = Ordering(("session_id",), ("timestamp_ms", "_ord"))
    out = scan(edges, seq, prev={"_p": ["event", "timestamp_ms", "task_id", "task_category"]})
    return out.filter("event <> 'task_start' and _p.event = 'task_start'").selectExpr(
        "session_id", "_p.task_id as task_id", "_p.task_category as task_category",
        "_p.timestamp_ms as start_ms", "timestamp_ms as end_ms",
    )


def task_timeline(markers: DataFrame) -> DataFrame:
    """First end of each task index with the first start of that index.

    A missing start is rebuilt from the latest earlier event plus a fixed pause;
    an end without any earlier event, and a start without an end, are dropped.
    """
    seq = Ordering(("session_id",), ("timestamp_ms", "_ord"))
    pos = F.struct("timestamp_ms", "_ord")
    cols = F.struct("timestamp_ms", "task_id", "task_category")
    # Latest strictly earlier time: events of one instant share their predecessor.
    instants = markers.select("session_id", "timestamp_ms").distinct().withColumn("_ord", F.lit(0))
    instants = with_chunks(instants, ["session_id"], "timestamp_ms", "_ord", SENSOR_CHUNK_MS, None)
    before = scan(instants, seq, prev={"_b": ["timestamp_ms"]}).selectExpr(
        "session_id", "timestamp_ms", "_b.timestamp_ms as _before"
    )
    rows = markers.groupBy("session_id", "task_index").agg(
        F.min_by(cols, F.when(F.col("event") == "task_start", pos)).alias("_s"),
        F.min_by(cols, F.when(F.col("event") == "task_end", pos)).alias("_e"),
    ).filter("_e is not null").withColumn("timestamp_ms", F.col("_e.timestamp_ms"))
    return (
        rows.join(before, ["session_id", "timestamp_ms"], "left")
        .filter("_s is not null or _before is not null")
        .selectExpr(
            "session_id", "task_index",
            "if(_s is null, _e.task_id, _s.task_id) as task_id",
            "if(_s is null, _e.task_category, _s.task_category) as task_category",
            f"if(_s is null, _before + {RECONSTRUCT_AFTER_MS}, _s.timestamp_ms) as start_ms",
            "timestamp_ms as end_ms", "_s is null as reconstructed",
        )
    )


def task_blocks(markers: DataFrame) -> DataFrame:
    """Earliest start and latest end per task index; both must exist."""
    at = lambda e: F.when(F.col("event") == e, F.col("timestamp_ms"))
    return markers.groupBy("session_id", "task_index").agg(
        F.min(at("task_start")).alias("start_ms"), F.max(at("task_end")).alias("end_ms"),
        F.min_by("task_id", F.when(F.col("event") == "task_start", F.struct("timestamp_ms", "_ord"))).alias("task_id"),
    ).filter("start_ms is not null and end_ms is not null")


def numbered_pauses(blocks: DataFrame, pause: str = "pause") -> DataFrame:
    """Block labels with pauses counted per session: "Pause 1", "Pause 2", ..."""
    seq = Ordering(("session_id",), ("start_ms", "_ord"))
    chunked = with_chunks(blocks, ["session_id"], "start_ms", "_ord", SENSOR_CHUNK_MS * 144)
    is_pause = F.when(F.col("task_id") == pause, 1).otherwise(0)
    return scan(chunked, seq, sums={"_n": is_pause}).withColumn(
        "block", F.when(F.col("task_id") == pause, F.concat(F.lit("Pause "), F.col("_n").cast("string")))
        .otherwise(F.col("task_id")),
    ).drop("_n", CHUNK)
