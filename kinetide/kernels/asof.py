"""Nearest as-of join built from one ordered pass over both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import Ordering, scan, with_chunks


def nearest_asof(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    ordinal: str,
    value_cols: Sequence[str],
    *,
    width: int,
    tolerance: float | None = None,
    drop_unmatched: bool = False,
    max_rows: int | None = 1_000_000,
    prefix: str = "r_",
) -> DataFrame:
    """Attach the right row closest in ``ts`` to each left row of the same key.

    Equal distances take the earlier right row; tolerance is inclusive; of
    several right rows at one instant the last is used looking back and the
    first looking ahead.  Both sides are unioned and scanned once, so nothing
    is paired that does not match.
    """
    payload = [c for c in value_cols if c not in (ts, ordinal)]
    hit = F.struct(F.col(ts).alias("t"), F.col(ordinal).alias("o"), *payload)
    lcols = list(left.columns)
    l = left.withColumn("_row", F.struct(*lcols)).select(
        *keys, F.col(ts), F.col(ordinal).cast("long").alias("_ord"), F.lit(1).alias("_side"), "_row"
    )
    # One right row per instant, placed ahead of left rows of that instant.
    r = right.groupBy(*keys, ts).agg(
        F.max_by(hit, F.col(ordinal)).alias("_latest"), F.min_by(hit, F.col(ordinal)).alias("_first")
    ).select(
        *keys, ts, F.lit(-1).cast("long").alias("_ord"), F.lit(0).alias("_side"), "_latest", "_first"
    )
    both = with_chunks(
        l.unionByName(r, allowMissingColumns=True), keys, ts, "_ord", width, max_rows
    )
    seq = Ordering(tuple(keys), (ts, "_ord"))
    found = scan(
        both, seq, last={"_back": F.col("_latest")}, upcoming={"_fwd": F.col("_first")}
    ).filter("_side = 1")
    here = F.col(ts)
    back, fwd = here - F.col("_back.t"), F.col("_fwd.t") - here
    pick = F.when(F.col("_back").isNull(), F.col("_fwd")).when(
        F.col("_fwd").isNull() | (back <= fwd), F.col("_back")
    ).otherwise(F.col("_fwd"))
    out = found.withColumn("_m", pick).withColumn("_d", F.abs(F.col("_m.t") - here))
    if tolerance is not None:
        out = out.withColumn("_m", F.when(F.col("_d") <= F.lit(tolerance), F.col("_m")))
    if drop_unmatched:
        out = out.filter(F.col("_m").isNotNull())
    return out.select(
        *[F.col(f"_row.{c}").alias(c) for c in lcols],
        F.col("_m.t").alias(f"{prefix}{ts}"),
        F.col("_m.o").alias(f"{prefix}{ordinal}"),
        *[F.col(f"_m.{c}").alias(f"{prefix}{c}") for c in payload],
        F.when(F.col("_m").isNotNull(), F.col("_d")).alias("delta"),
    )
