"""Gaps-and-islands over chunked keys in a single ordered pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import Ordering

Breaks = Callable[[Column, Column], Column]


def islands(
    df: DataFrame, seq: Ordering, cols: Sequence[str], starts: Breaks, name: str = "island"
) -> DataFrame:
    """Number consecutive runs per key, from 1.

    ``starts(prev, cur)`` receives structs of ``cols`` of two neighbouring rows
    and says whether ``cur`` opens a new run.  Only the first and last row and
    the number of breaks of each chunk are compared across chunk borders.
    """
    w = seq.local
    cur = F.struct(*cols)
    marked = df.withColumn("_lag", F.lag(cur).over(w))
    step = F.when(F.col("_lag").isNull(), 0).otherwise(
        F.when(starts(F.col("_lag"), cur), 1).otherwise(0)
    )
    marked = marked.withColumn("_step", step.cast("long"))
    summary = marked.groupBy(*seq.group).agg(
        F.sum("_step").alias("_inner"),
        F.min_by(cur, seq.position).alias("_head"),
        F.max_by(cur, seq.position).alias("_tail"),
    )
    summary = summary.withColumn("_before", F.lag("_tail").over(seq.outer))
    opens = F.when(F.col("_before").isNull(), 1).otherwise(
        F.when(starts(F.col("_before"), F.col("_head")), 1).otherwise(0)
    )
    summary = summary.withColumn("_open", opens.cast("long"))
    behind = seq.outer.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        *seq.group,
        (
            F.coalesce(F.sum(F.col("_inner") + F.col("_open")).over(behind), F.lit(0))
            + F.col("_open")
        ).alias("_offset"),
    )
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        marked.join(summary, seq.group, "left")  # left: rows with a NULL key stay, each chunk a sequence of its own
        .withColumn(name, F.coalesce("_offset", F.lit(1)) + F.sum("_step").over(upto))
        .drop("_lag", "_step", "_offset")
    )


def summarise_islands(
    df: DataFrame, seq: Ordering, cols: Sequence[str], starts: Breaks, aggs: Sequence[Column]
) -> DataFrame:
    """One row per run.  Map-side combine shrinks a long run before its shuffle."""
    return (
        islands(df, seq, cols, starts)
        .groupBy(*seq.keys, "island")
        .agg(*aggs)
    )


def state_changes(column: str) -> Breaks:
    return lambda prev, cur: ~prev[column].eqNullSafe(cur[column])


def gap_exceeds(ts: str, max_gap: float) -> Breaks:
    return lambda prev, cur: (cur[ts] - prev[ts]) > F.lit(max_gap)
