"""Ordered computation inside a key without putting the whole key into one task.

A session may hold a third of all rows, so ``Window.partitionBy(session)`` over
samples is not an option.  Every sample carries ``_chunk``: an order-preserving
piece of its session's time line with a bounded number of rows.  Row-level
windows run per (session, chunk); what has to cross a chunk border travels as
one summary row per chunk.  Summaries are the only thing ordered per session.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "_chunk"
# Above this many chunk lengths in one time bucket, split by instant and ordinal.
DENSE_FACTOR = 64


@dataclass(frozen=True)
class Ordering:
    """Keys, a strict total order inside a key, and the chunk column."""

    keys: tuple[str, ...]
    order: tuple[str, ...]
    chunk: str = CHUNK

    @property
    def group(self) -> list[str]:
        return [*self.keys, self.chunk]

    @property
    def local(self):
        return Window.partitionBy(*self.group).orderBy(*self.order)

    @property
    def outer(self):
        return Window.partitionBy(*self.keys).orderBy(self.chunk)

    @property
    def position(self) -> Column:
        return F.struct(*self.order)


def with_chunks(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    ordinal: str,
    width: int,
    max_rows: int | None = 1_000_000,
) -> DataFrame:
    """Add ``_chunk``, monotone in (``ts``, ``ordinal``) inside each key.

    Time buckets of ``width`` are the normal chunk.  Buckets above ``max_rows``
    are split: evenly in time up to ``DENSE_FACTOR * max_rows`` rows, by instant
    and ordinal block beyond, so even one instant holding most rows is spread.
    The list of such buckets has at most ``rows / max_rows`` entries, which is
    the bound that makes broadcasting it safe.
    """
    bucket = F.floor(F.col(ts) / F.lit(width))
    zero = F.lit(0).cast("long")
    if max_rows is None:
        return df.withColumn(CHUNK, F.struct(bucket.alias("b"), zero.alias("s"), zero.alias("o")))
    hot = (
        df.groupBy(*keys, bucket.alias("_b"))
        .agg(F.count("*").alias("_n"))
        .filter(F.col("_n") > max_rows)
    )
    parts = F.ceil(F.col("_n") * 4 / F.lit(max_rows))
    inside = F.col(ts) - F.col("_b") * F.lit(width)
    dense = F.col("_n") > DENSE_FACTOR * max_rows
    sub = F.when(dense, inside).otherwise(F.floor(inside * parts / F.lit(width)))
    block = F.when(dense, F.floor(F.col(ordinal) / F.lit(max_rows)))
    return (
        df.withColumn("_b", bucket)
        .join(F.broadcast(hot), [*keys, "_b"], "left")
        .withColumn(
            CHUNK,
            F.struct(
                F.col("_b").alias("b"),
                F.coalesce(sub.cast("long"), zero).alias("s"),
                F.coalesce(block.cast("long"), zero).alias("o"),
            ),
        )
        .drop("_b", "_n")
    )


def scan(
    df: DataFrame,
    seq: Ordering,
    *,
    prev: Mapping[str, Sequence[str]] | None = None,
    nxt: Mapping[str, Sequence[str]] | None = None,
    sums: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    upcoming: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One ordered pass over every key, split by chunk.

    prev / nxt   struct of the listed columns of the neighbouring row
    sums         running sum including the current row
    last         latest non-null value at or before the row
    upcoming     first non-null value after the row
    totals       sum over the whole key
    """
    prev, nxt, sums = prev or {}, nxt or {}, sums or {}
    last, upcoming, totals = last or {}, upcoming or {}, totals or {}
    pos = seq.position
    aggs, carried = [], []
    outer = seq.outer
    behind = outer.rowsBetween(Window.unboundedPreceding, -1)
    # What follows is looked up in the opposite order: a frame to the end reads all later rows anew for each row.
    ahead = Window.partitionBy(*seq.keys).orderBy(F.col(seq.chunk).desc()).rowsBetween(Window.unboundedPreceding, -1)
    for name, cols in prev.items():
        aggs.append(F.max_by(F.struct(*cols), pos).alias(f"_t_{name}"))
        carried.append(F.lag(f"_t_{name}").over(outer).alias(f"_c_{name}"))
    for name, cols in nxt.items():
        aggs.append(F.min_by(F.struct(*cols), pos).alias(f"_t_{name}"))
        carried.append(F.lead(f"_t_{name}").over(outer).alias(f"_c_{name}"))
    for name, expr in sums.items():
        aggs.append(F.sum(expr).alias(f"_t_{name}"))
        carried.append(F.sum(f"_t_{name}").over(behind).alias(f"_c_{name}"))
    for name, expr in last.items():
        aggs.append(F.max_by(expr, F.when(expr.isNotNull(), pos)).alias(f"_t_{name}"))
        carried.append(F.last(f"_t_{name}", ignorenulls=True).over(behind).alias(f"_c_{name}"))
    for name, expr in upcoming.items():
        aggs.append(F.min_by(expr, F.when(expr.isNotNull(), pos)).alias(f"_t_{name}"))
        carried.append(F.last(f"_t_{name}", ignorenulls=True).over(ahead).alias(f"_c_{name}"))
    for name, expr in totals.items():
        aggs.append(F.sum(expr).alias(f"_t_{name}"))
        carried.append(F.sum(f"_t_{name}").over(Window.partitionBy(*seq.keys)).alias(f"_c_{name}"))

    carry = df.groupBy(*seq.group).agg(*aggs).select(*seq.group, *carried)
    # Left: rows whose key is NULL belong to no sequence; each of their chunks stands alone, none is lost.
    joined = df.join(carry, seq.group, "left")

    w = seq.local
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if upcoming:
        # By place, so that rows of equal position keep their order.
        joined = joined.withColumn("_place", F.row_number().over(w))
    after = Window.partitionBy(*seq.group).orderBy(F.col("_place").desc()).rowsBetween(Window.unboundedPreceding, -1)
    out = list(df.columns)
    cols = [F.col(c) for c in out]
    for name, names in prev.items():
        cols.append(F.coalesce(F.lag(F.struct(*names)).over(w), F.col(f"_c_{name}")).alias(name))
    for name, names in nxt.items():
        cols.append(F.coalesce(F.lead(F.struct(*names)).over(w), F.col(f"_c_{name}")).alias(name))
    for name, expr in sums.items():
        base = F.coalesce(F.col(f"_c_{name}"), F.lit(0))
        cols.append((base + F.coalesce(F.sum(expr).over(upto), F.lit(0))).alias(name))
    for name, expr in last.items():
        local = F.last(expr, ignorenulls=True).over(upto)
        cols.append(F.coalesce(local, F.col(f"_c_{name}")).alias(name))
    for name, expr in upcoming.items():
        local = F.last(expr, ignorenulls=True).over(after)
        cols.append(F.coalesce(local, F.col(f"_c_{name}")).alias(name))
    for name in totals:
        cols.append(F.col(f"_c_{name}").alias(name))
    return joined.select(*cols)


def row_numbers(df: DataFrame, seq: Ordering, name: str = "rn", total: str | None = None) -> DataFrame:
    """Zero-based row position inside the key (and the key's row count)."""
    one = F.lit(1).cast("long")
    out = scan(df, seq, sums={name: one}, totals={total: one} if total else None)
    return out.withColumn(name, F.col(name) - 1)
