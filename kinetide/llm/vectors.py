"""Vector columns that both searches read: cleaning and packing into bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor with a null or non-finite component."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine, F.lit(False))


def of_common_width(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Rows whose vectors have the most frequent length (the smaller of equally frequent ones), and that length.

    Products between vectors of different lengths are undefined, so others take no part.
    """
    widths = df.groupBy(F.size(vector).alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    width = widths[0]["width"] if widths else 0
    return df.where(F.size(vector) == width), width


def stacked(column, width: int, kind: str = "<f8") -> np.ndarray:  # noqa: ANN001
    """A matrix from a pandas or list column of byte strings."""
    return np.frombuffer(b"".join(column), dtype=kind).reshape(-1, width)
