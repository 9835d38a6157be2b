"""Range joins of points with half-open intervals, bucketed on time.

An interval is listed once per time bucket it touches; a point looks only at its
own (key, bucket).  The join is a plain equi-join, so a hot key is spread over
its buckets and adaptive execution may still turn a small side into a broadcast
once it has measured it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _spread(blocks: DataFrame, start: str, end: str, width: int) -> DataFrame:
    lo = F.floor(F.col(start) / F.lit(width))
    # Half-open: an end exactly on a bucket border does not reach into it.
    hi = F.ceil(F.col(end) / F.lit(width)) - 1
    return blocks.filter(F.col(end) > F.col(start)).withColumn("_b", F.explode(F.sequence(lo, hi)))


def _within(point: Column, closed: bool) -> Column:
    upper = point <= F.col("_e") if closed else point < F.col("_e")
    return (point >= F.col("_s")) & upper


def interval_join(
    points: DataFrame,
    blocks: DataFrame,
    keys: Sequence[str],
    at: str,
    value_cols: Sequence[str],
    *,
    start: str = "start_ms",
    end: str = "end_ms",
    width: int,
    how: str = "left",
) -> DataFrame:
    """Attach the block covering each point; with overlaps the latest start wins, then the greatest values.

    The blocks of a (key, bucket) travel as one row with an array, so a point meets one row and is never
    repeated, whatever overlaps and however many equal points there are.  ``width`` bounds the array: it
    should span few blocks.  A hot (key, bucket) is many points against that one row, a join that adaptive
    execution splits.
    """
    side = _spread(blocks, start, end, width).groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_bb")).agg(
        F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e"), F.struct(*value_cols).alias("v"))).alias("_blocks"))
    p = points.withColumn("_b", F.floor(F.col(at) / F.lit(width)))
    cond = F.col("_b") == F.col("_bb")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    covering = F.filter("_blocks", lambda b: (F.col(at) >= b["s"]) & (F.col(at) < b["e"]))
    joined = p.join(side, cond, "left").withColumn("_v", F.array_max(F.transform(covering, lambda b: F.struct(b["s"], b["v"]))))
    if how == "inner":
        joined = joined.filter(F.col("_v").isNotNull())
    base = [F.col(c) for c in points.columns if c not in value_cols]
    return joined.select(*base, *[F.col(f"_v.v.{c}").alias(c) for c in value_cols])


def interval_anti(
    points: DataFrame,
    blocks: DataFrame,
    keys: Sequence[str],
    at: str,
    *,
    start: str = "start_ms",
    end: str = "end_ms",
    width: int,
) -> DataFrame:
    """Drop points covered by any block."""
    side = _spread(blocks, start, end, width).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_bb"),
        F.col(start).alias("_s"), F.col(end).alias("_e"),
    )
    p = points.withColumn("_b", F.floor(F.col(at) / F.lit(width)))
    cond = F.col("_b") == F.col("_bb")
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    return p.join(side, cond & _within(F.col(at), False), "left_anti").drop("_b")
