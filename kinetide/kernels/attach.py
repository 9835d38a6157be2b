"""Joining one row per key onto many rows per key without a hot key in one task, and leaving out rows without a key before they travel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16
#: Words of 64 bits in which keys are marked: 67 million bits, sent to all tasks.
MARK_WORDS = 1 << 20


def attach(
    df: DataFrame, dim: DataFrame, keys: Sequence[str], how: str = "inner", *, spread: str = "_ord", salts: int = SALTS
) -> DataFrame:
    """Join ``dim`` (unique on ``keys``) with each key of ``df`` cut into ``salts`` parts.

    The small side is repeated per part; a runtime broadcast stays possible
    because adaptive execution measures it first.  A NULL key is a key like any other.
    """
    by = F.col(spread) if spread in df.columns else F.hash(*df.columns)
    wide = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    wide = wide.withColumnsRenamed({k: f"_dim_{k}" for k in [*keys, "_salt"]})
    same = F.col("_salt") == F.col("_dim__salt")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_dim_{k}"))
    joined = df.withColumn("_salt", F.pmod(F.hash(by), F.lit(salts))).join(wide, same, how)
    rest = [c for c in df.columns if c not in keys]
    return joined.select(*keys, *rest, *[c for c in dim.columns if c not in keys])


def with_marks(rows: DataFrame, keys: DataFrame, name: str, words: int = MARK_WORDS, how: str = "left") -> DataFrame:
    """``rows`` with a column that is true where ``keys`` has the row's key (all its columns, without nulls), and for few others (see ``marked``)."""
    hashed = f"xxhash64({', '.join(keys.columns)})"
    word, bit = f"pmod({hashed}, {words}L)", f"cast(pmod(shiftrightunsigned({hashed}, 40), 64) as int)"
    bits = keys.dropna().groupBy(F.expr(word).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, {bit})")).alias("_bits"))
    found = rows.withColumn("_word", F.expr(word)).join(F.broadcast(bits), "_word", how)
    return found.select(*rows.columns, F.expr(f"coalesce(shiftrightunsigned(_bits, {bit}) & 1L = 1L, false)").alias(name))


def marked(rows: DataFrame, keys: DataFrame, words: int = MARK_WORDS) -> DataFrame:
    """The rows of ``rows`` with a key in ``keys`` (all its columns, without nulls), and few others: those whose hash has a bit that one in ``keys`` has.

    The bits stand in at most ``words`` rows of 64, whatever the number of keys, so they are sent to all tasks
    and rows that take no part needn't travel.
    """
    return with_marks(rows, keys, "_marked", words, "inner").where("_marked").drop("_marked")


def having(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of ``rows`` with a key in ``keys`` (distinct), of which only the ``marked`` ones travel.

    An inner join, since a semi-join would be taken before the marks, with all rows.
    """
    return marked(rows, keys).join(keys, keys.columns).select(*rows.columns)
