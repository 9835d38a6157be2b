"""Session settings and the shared folder used for staged tables and stream state."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}
_made: dict[str, list[str]] = {}
_tables: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
#: Shuffle files go when a query ends, not when the driver happens to collect the frames that made them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every plan relies on; safe to call repeatedly."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    context = spark.sparkContext
    if context.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        # One machine: as many partitions as threads.  A cluster keeps its own setting.
        spark.conf.set("spark.sql.shuffle.partitions", str(context.defaultParallelism))
    return spark


def local_session(cores: str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A small local session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("kinetide")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for k, v in extra.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: the cluster's ``spark.checkpoint.dir``.

    Without one, executors of a cluster would each write to their own disk, so that is an error; only a
    session on one machine falls back to a temporary folder, which goes when the process ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="kinetide-")
        atexit.register(shutil.rmtree, _fallback[app], ignore_errors=True)
    return _fallback[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete the tables and stream folders that this application made; how many there were.

    For the end of a run, once its results are written: a frame that still reads a staged table fails after it.
    """
    paths = _made.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        _delete(spark, path)
    return len(paths)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``staged`` returned, once everything that reads them is written."""
    for table in tables:
        path = _tables.pop(table, None)
        if path is not None:
            _made[table.sparkSession.sparkContext.applicationId].remove(path)
            _delete(table.sparkSession, path)


@contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Queries in it leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage reliably: the copy survives the loss of any executor, keeps
    column pruning and filter pushdown, and is computed exactly once.  What was shuffled for it is deleted.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with _tidy(spark):
        writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _tables[table] = path
    return table
