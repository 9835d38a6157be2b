"""Row-count windows whose length differs per key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Frames in units of the window length; the slack separates "n rows" from "n + 1 rows".
_SLACK = 1e-9
TRAILING = (1 - _SLACK, 0.0)
CENTRED = (0.5 + _SLACK, 0.5 - _SLACK)
_BLOCK_LENGTHS = 64


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    rn: str,
    size: str,
    exprs: Mapping[str, str],
    frame: tuple[float, float],
) -> DataFrame:
    """Aggregates over the ``size`` rows around each row, by row number ``rn``.

    Spark frames are literals, so the order column is the row number divided by
    the key's window length and the frame is a literal range of that.  Each key
    is cut into blocks of 64 window lengths; only the rows within one length of
    a border are copied to the neighbouring block.
    """
    block = f"floor({rn} / ({_BLOCK_LENGTHS} * {size}))"
    reach = f"array_distinct(transform(array(-1, 0, 1), i -> floor(greatest({rn} + i * {size}, 0) / ({_BLOCK_LENGTHS} * {size}))))"
    before, after = frame
    follow = f"{after!r}D following" if after else "current row"
    part = ", ".join([*keys, "_blk"])
    over = f"over (partition by {part} order by _z range between {before!r}D preceding and {follow})"
    return (
        df.selectExpr("*", f"{block} as _own", f"explode({reach}) as _blk")
        .selectExpr("*", f"({rn} - _blk * {_BLOCK_LENGTHS} * {size}) / cast({size} as double) as _z")
        .selectExpr("*", *[f"{e} {over} as {n}" for n, e in exprs.items()])
        .filter(F.col("_own") == F.col("_blk"))
        .drop("_own", "_blk", "_z")
    )
