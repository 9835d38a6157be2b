"""Exact order statistics and rank measures that never gather a group in one task.

Rows are first reduced to distinct (key, value) counts.  Values are then cut
into order-preserving buckets, so ranks inside a key come from the same chunked
scan that orders time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attach import attach
from .order import CHUNK, Ordering, scan

# asinh compresses any magnitude, keeps order, and at this resolution one bucket
# spans about 1/4096 of the value: at most ~3e5 buckets exist per key.
_UNIT = 1e6
_RESOLUTION = 4096


def value_bucket(value: Column) -> Column:
    return F.floor(F.asinh(value.cast("double") * _UNIT) * _RESOLUTION)


def ranked(
    df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column]
) -> DataFrame:
    """One row per (key, value): each sum, its running total and its key total.

    For ``sums={"n": ...}`` the output has ``n``, ``n_cum`` and ``n_all``.
    """
    held = list(keys) or ["_one"]
    src = df if keys else df.withColumn("_one", F.lit(1))
    counts = src.filter(F.col(value).isNotNull()).groupBy(*held, value).agg(
        *[F.sum(e).alias(n) for n, e in sums.items()]
    )
    counts = counts.withColumn(CHUNK, value_bucket(F.col(value)))
    out = scan(
        counts,
        Ordering(tuple(held), (value,)),
        sums={f"{n}_cum": F.col(n) for n in sums},
        totals={f"{n}_all": F.col(n) for n in sums},
    ).drop(CHUNK)
    return out if keys else out.drop("_one")


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, qs: Mapping[str, float], weight: str | None = None
) -> DataFrame:
    """Exact linearly interpolated quantiles per key: ``{output: q}``.

    ``weight`` names a column of whole repeat counts.
    """
    rows = ranked(df, keys, value, {"_n": (F.col(weight) if weight else F.lit(1)).cast("long")})
    lo_rank, hi_rank = F.col("_n_cum") - F.col("_n"), F.col("_n_cum")
    aggs = []
    for name, q in qs.items():
        at = (F.col("_n_all") - 1) * F.lit(float(q))
        for tag, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            covers = (lo_rank <= rank) & (rank < hi_rank)
            aggs.append(F.max(F.when(covers, F.col(value).cast("double"))).alias(f"_{name}_{tag}"))
        aggs.append(F.max(at - F.floor(at)).alias(f"_{name}_f"))
    grouped = rows.groupBy(*keys).agg(*aggs)
    return grouped.select(
        *keys,
        *[
            (
                F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_f")
            ).alias(n)
            for n in qs
        ],
    )


def mad(df: DataFrame, keys: Sequence[str], value: str, name: str = "mad") -> DataFrame:
    """Median absolute deviation and the median it refers to."""
    # Both medians work on distinct values with their counts; rows are read once.
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_w"))
    med = quantiles(counts, keys, value, {"median": 0.5}, "_w")
    # Without keys the median is a single row.
    both = attach(counts, med, list(keys), spread=value) if keys else counts.crossJoin(F.broadcast(med))
    dev = both.withColumn("_dev", F.abs(F.col(value) - F.col("median")))
    out = quantiles(dev, keys, "_dev", {name: 0.5}, "_w")
    return out.join(med, list(keys)) if keys else out.crossJoin(F.broadcast(med))


def auc(df: DataFrame, keys: Sequence[str], score: str, label: str, name: str = "auc") -> DataFrame:
    """Exact area under the ROC curve per key; NULL with a single class."""
    pos = (F.col(label) == 1).cast("long")
    rows = ranked(df, keys, score, {"_p": pos, "_n": 1 - pos})
    below = F.col("_n_cum") - F.col("_n")
    won = F.sum(F.col("_p") * (below + F.col("_n") / 2.0))
    pairs = F.max(F.col("_p_all").cast("double") * F.col("_n_all"))
    return rows.groupBy(*keys).agg(F.when(pairs > 0, won / pairs).alias(name))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """(key, value, mean 1-based rank of the value's ties)."""
    rows = ranked(df, keys, value, {"_n": F.lit(1).cast("long")})
    mean = F.col("_n_cum") - (F.col("_n") - 1) / 2.0
    return rows.select(*keys, value, mean.alias(name), F.col("_n").alias(f"{name}_ties"))
