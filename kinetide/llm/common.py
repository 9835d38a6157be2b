"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetide.session import discard, fresh_path, shared_dir, staged

__all__ = ["discard", "fresh_path", "held", "keyed_crc", "pieces", "shared_dir", "staged", "table", "texts"]


_held: dict[Hashable, Any] = {}


def held(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a worker keeps between tasks: one tokenizer or model at a time, as workers serve all stages of a job."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns an operator reads, null text as empty; extra columns of any name are left behind."""
    return docs.select(*columns, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so that working memory stays small."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def keyed_crc(column: str) -> Column:
    """crc32 of an id written as decimal text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
