"""Bounded and continuous runs of streaming plans with durable state and sinks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table_stream(spark: SparkSession, path: str, schema=None, files_per_batch: int = 100) -> DataFrame:
    """A Parquet table as an unbounded source.

    The file source takes a folder or a pattern; a pattern that matches only
    ``path`` serves tables stored as one file and tables stored as a folder.
    """
    schema = schema or spark.read.parquet(path).schema
    path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def replay(df: DataFrame, name: str, key: str, batches: int = 4, rows_per_batch: int = 1_000_000) -> DataFrame:
    """A finite table as a stream of several micro-batches in the order of ``key``.

    The table is written to range-partitioned files, at least ``batches`` of them and none much over
    ``rows_per_batch`` rows, whose modification times follow the key; the file source takes one at a time.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, f"{name}-replay")
    files = max(batches, -(-df.count() // rows_per_batch))
    df.repartitionByRange(files, key).sortWithinPartitions(key).write.parquet(path)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((str(f.getPath()) for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")))
    for i, part in enumerate(parts):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(part), 1_000_000_000_000 + 1000 * i, -1)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def with_end(df: DataFrame, ts: str, after_ms: int, **values: object) -> DataFrame:
    """``df`` and one last row, ``after_ms`` behind the newest one, with ``values`` and else NULL.

    On a stream that goes on, later rows of any key move the watermark; a finite table needs such a row for the
    windows and timers that are still open.  Its key should be none of the table's.
    """
    end = df.agg((F.max(ts) + F.expr(f"{after_ms}")).cast(df.schema[ts].dataType).alias(ts))
    return df.unionByName(end.select(ts, *[F.lit(v).alias(k) for k, v in values.items()]), allowMissingColumns=True)


def split_late(stream: DataFrame, name: str, ts: str, lateness_ms: int) -> tuple[str, str]:
    """Route each micro-batch's rows by the mark that the batches before it have set: (on-time folder, late folder).

    The mark is the newest ``ts`` of earlier batches less ``lateness_ms``.  Rows at or behind it would be dropped by
    any plan with that watermark, so they go to a folder of their own, for ``merge_late``.  Marks are stored beside
    the rows, one per batch, so a batch that is repeated after a failure is split as before.
    """
    spark = stream.sparkSession
    root, state = fresh_path(spark, name), fresh_path(spark, f"{name}-state")

    def mark(batch_id: int) -> int | None:
        if batch_id == 0:
            return None
        return spark.read.parquet(f"{root}/marks/_batch={batch_id - 1}").first()["mark"]

    def write(batch: DataFrame, batch_id: int) -> None:
        old = mark(batch_id)
        batch = batch.persist()
        newest = batch.agg(F.max(ts)).first()[0]
        late = F.lit(False) if old is None else F.col(ts) <= old
        late = F.coalesce(late, F.lit(False))
        batch.filter(~late).write.mode("overwrite").parquet(f"{root}/on-time/_batch={batch_id}")
        batch.filter(late).write.mode("overwrite").parquet(f"{root}/late/_batch={batch_id}")
        marks = [m for m in (old, None if newest is None else newest - lateness_ms) if m is not None]
        spark.createDataFrame([(max(marks, default=None),)], "mark long").coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/_batch={batch_id}")
        batch.unpersist()

    _finish(stream.writeStream.foreachBatch(write).option("checkpointLocation", state))
    return f"{root}/on-time", f"{root}/late"


def merge_late(spark: SparkSession, table: str, late: DataFrame, batch: str, keys: list[str], ts: str) -> DataFrame:
    """Add the rows of ``late`` that the table under ``table`` doesn't have yet, as its part ``_batch=batch``.

    Only the part of the table in the late rows' span of time is read.  The part is replaced as a whole and never
    compared with itself, so merging the same batch again changes nothing.
    """
    span = late.agg(F.min(ts).alias("low"), F.max(ts).alias("high")).first()
    whole = spark.read.option("basePath", table).parquet(f"{table}/_batch=*")
    if span["low"] is not None:
        near = whole.filter((F.col("_batch").cast("string") != batch) & F.col(ts).between(span["low"], span["high"])).select(*keys)
        same = None
        for k in keys:
            one = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
            same = one if same is None else same & one
        new = late.dropDuplicates(keys).alias("l").join(near.alias("r"), same, "left_anti")
        new.select(*[c for c in whole.columns if c != "_batch"]).write.mode("overwrite").parquet(f"{table}/_batch={batch}")
    return spark.read.option("basePath", table).parquet(f"{table}/_batch=*")


def folder_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The parts of a sink's folder, in the order of their batches, as a stream."""
    schema = spark.read.option("basePath", path).parquet(f"{path}/_batch=*").drop("_batch").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}/_batch=*")


def files_of_part(spark: SparkSession, path: str) -> int:
    """The files of the largest part of a sink's folder, so that a stream over it takes about a part at a time."""
    files = spark.read.option("basePath", path).parquet(f"{path}/_batch=*").inputFiles()
    return max(Counter(f.rsplit("/", 1)[0] for f in files).values(), default=1)


def _finish(writer) -> None:  # noqa: ANN001
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def drain(
    stream: DataFrame, name: str, *, mode: str = "append", transform: Callable[[DataFrame], DataFrame] | None = None,
    paths: tuple[str, str] | None = None,
) -> DataFrame:
    """Process everything available and return the sink's table.

    ``paths`` names the sink and the checkpoint, so that a later call goes on where this one ended.

    Each micro-batch overwrites its own folder, so a batch repeated after a
    failure replaces itself.  ``_batch`` tells update results apart.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    out, state = paths or (fresh_path(spark, name), fresh_path(spark, f"{name}-state"))

    def write(batch: DataFrame, batch_id: int) -> None:
        if transform:
            # A transform may read its batch several times: the stateful steps before it run once, ahead of it.
            batch = batch.persist(StorageLevel.DISK_ONLY)
            batch.count()
        result = transform(batch) if transform else batch
        result.write.mode("overwrite").parquet(f"{out}/_batch={batch_id}")
        if transform:
            batch.unpersist()

    query = (
        stream.writeStream.outputMode(mode).option("checkpointLocation", state)
        .foreachBatch(write).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.option("basePath", out).parquet(f"{out}/_batch=*")


def latest(sink: DataFrame, keys: list[str]) -> DataFrame:
    """Last version of each key of an update-mode sink."""
    cols = [c for c in sink.columns if c not in (*keys, "_batch")]
    return sink.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_batch").alias("_r")).select(
        *keys, *[F.col(f"_r.{c}").alias(c) for c in cols]
    )
