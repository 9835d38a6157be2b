"""Small column expressions shared by the scans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_double(c: str) -> Column:
    """Blank or malformed text becomes NULL."""
    return F.expr(f"try_cast(nullif(trim(cast({c} as string)), '') as double)")


def lenient_long(c: str) -> Column:
    """Integers written as floats are accepted; the fraction is cut."""
    return F.expr(f"try_cast(try_cast(nullif(trim(cast({c} as string)), '') as double) as bigint)")


def local_ms(*millis: str, iso: str = "local_ts") -> Column:
    """First parseable millisecond column, else the ISO text."""
    parsed = F.expr(f"unix_millis(try_to_timestamp({iso}))")
    return F.coalesce(*[lenient_long(c) for c in millis], parsed)


def safe_id(c: Column, fallback: str = "unsessioned") -> Column:
    """Letters, digits and ``-_.`` stay, anything else turns into ``_``; at most 80 characters."""
    kept = F.substring(F.regexp_replace(F.trim(c), r"[^\p{L}\p{N}\-_.]", "_"), 1, 80)
    return F.coalesce(F.when(F.length(kept) > 0, kept), F.lit(fallback))


def sorted_codes(c: Column) -> Column:
    """Aggregate: distinct codes joined by ``;`` in alphabetical order."""
    return F.array_join(F.array_sort(F.collect_set(c)), ";")
