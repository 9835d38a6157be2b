"""The session index: one row per recording."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..kernels import Ordering
from ..kernels.order import CHUNK, row_numbers


def upsert(index: DataFrame, updates: DataFrame) -> DataFrame:
    """Overwrite non-NULL update columns, keep the rest, add unknown sessions."""
    changed = [c for c in updates.columns if c != "session_id"]
    up = updates.select("session_id", *[F.col(c).alias(f"_u_{c}") for c in changed])
    joined = index.join(up, "session_id", "full_outer")
    return joined.select(
        *[
            F.coalesce(F.col(f"_u_{c}"), F.col(c)).alias(c) if c in changed else F.col(c)
            for c in index.columns
        ]
    )


def delete(index: DataFrame, removed: DataFrame) -> DataFrame:
    return index.join(removed.select("session_id"), "session_id", "left_anti")


def flag(index: DataFrame, flags: DataFrame) -> DataFrame:
    """flags(session_id, note): mark by hand, which forces the verdict to skip."""
    f = flags.select("session_id", F.trim(F.coalesce("note", F.lit(""))).alias("_note"))
    hit = F.col("_note").isNotNull()
    return index.join(f, "session_id", "left").select(
        *[
            {
                "flagged": F.when(hit, F.lit("yes")).otherwise(F.col("flagged")),
                "flag_note": F.when(hit, F.col("_note")).otherwise(F.col("flag_note")),
                "verdict": F.when(hit, F.lit("skip")).otherwise(F.col("verdict")),
            }.get(c, F.col(c)).alias(c)
            for c in index.columns
        ]
    )


def mark_test(index: DataFrame, tests: DataFrame) -> DataFrame:
    """Turn sessions into test runs: mode, description prefix, no subject index."""
    t = tests.select("session_id", F.lit(True).alias("_t"))
    hit = F.col("_t").isNotNull()
    text = F.trim(F.coalesce("description", F.lit("")))
    named = F.when(F.upper(text).startswith("[TEST]"), F.col("description")).otherwise(
        F.rtrim(F.concat(F.lit("[TEST] "), text))
    )
    return index.join(t, "session_id", "left").select(
        *[
            {
                "study_mode": F.when(hit, F.lit("test")).otherwise(F.col("study_mode")),
                "subject_index": F.when(~hit, F.col("subject_index")),
                "description": F.when(hit, named).otherwise(F.col("description")),
            }.get(c, F.col(c)).alias(c)
            for c in index.columns
        ]
    )


def next_session_id(*id_tables: DataFrame) -> DataFrame:
    """One row: S plus the highest number used anywhere plus one, three digits or more."""
    ids = reduce(DataFrame.unionByName, [t.select("session_id") for t in id_tables])
    num = F.expr("try_cast(regexp_extract(session_id, '^S([0-9]+)$', 1) as bigint)")
    n = F.coalesce(F.max(num), F.lit(0)) + 1
    text = n.cast("string")
    return ids.agg(
        F.concat(F.lit("S"), F.lpad(text, F.greatest(F.lit(3), F.length(text)), F.lit("0"))).alias("next_id")
    )


def subject_index(index: DataFrame) -> DataFrame:
    """1-based order in which persons first appear among study sessions."""
    first = (
        index.filter("lower(trim(study_mode)) = 'study' and trim(cast(person_id as string)) <> ''")
        .groupBy("person_id").agg(F.min("_ord").alias("first_ord"))
    )
    first = first.withColumn("_one", F.lit(1)).withColumn(CHUNK, F.shiftright("first_ord", 16))
    out = row_numbers(first, Ordering(("_one",), ("first_ord",)), "subject_index").drop("_one", CHUNK)
    return out.withColumn("subject_index", (F.col("subject_index") + 1).cast("int"))


def search(
    index: DataFrame, *, text: str = "", verdict: str | None = None, min_five: bool = False,
    order_by: str = "start_ms", descending: bool = True,
) -> DataFrame:
    """Session list: text, verdict and length filters; NULLs sort last in both directions."""
    out = index
    if text:
        hay = F.lower(F.concat_ws(" ", "session_id", "person_id", "description"))
        out = out.filter(hay.contains(text.lower()))
    if verdict:
        out = out.filter(F.col("verdict") == verdict)
    if min_five:
        out = out.filter(F.col("duration_seconds") >= 300)
    key = F.col(order_by)
    return out.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last())
