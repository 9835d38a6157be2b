"""Reading raw session streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import lenient_double, lenient_long, local_ms
from ..schema import ACC, GRAVITY, GYRO, STROKE_DOTS


def discover_sessions(
    spark: SparkSession, pen_glob: str, watch_glob: str, watch_suffix: str = ""
) -> DataFrame:
    """Sessions that have a pen and a watch file, by name.  Only the listing is read."""
    tail = f"_watch_{watch_suffix}" if watch_suffix else "_watch"

    def names(glob: str, pattern: str, out: str) -> DataFrame:
        files = spark.read.format("binaryFile").load(glob).select("path")
        return (
            files.select(F.regexp_extract("path", pattern, 1).alias("session_id"), "path")
            .filter("session_id <> ''")
            .groupBy("session_id").agg(F.min("path").alias(out))
        )

    pens = names(pen_glob, r"(S\d+)_pen\.csv", "pen_path")
    watches = names(watch_glob, rf"(S\d+){tail}\.csv", "watch_path")
    return pens.join(watches, "session_id")


def newest_session(pairs: DataFrame) -> DataFrame:
    """The default pair: the highest session id."""
    return pairs.orderBy(F.desc("session_id")).limit(1)


def read_stream_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A raw stream as text columns of the declared layout, with its file and the arrival ordinal ``_ord``.

    Coercion comes after.  ``_ord`` follows the order of lines inside a file: pieces of a large file are read
    by several tasks, so the piece's offset goes before the place in the task.  Ordinals of different files
    don't compare; a session's stream is one file.
    """
    text = StructType()
    for f in schema:
        text = text.add(f.name, "string")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    piece = F.shiftleft(F.floor(F.col("_metadata.file_block_start") / 65536), 33)
    return spark.read.schema(text).option("header", True).csv(path).select(
        "*", F.col("_metadata.file_path").alias("_file"), (piece + place).alias("_ord")
    )


def coerce_watch(raw: DataFrame) -> DataFrame:
    """Lenient parse of motion samples with magnitudes and presence flags."""
    axes = [c for c in (*ACC, *GYRO, *GRAVITY) if c in raw.columns]
    missing = [c for c in (*ACC, *GYRO, *GRAVITY) if c not in raw.columns]
    server = "server_received_ms" if "server_received_ms" in raw.columns else "null"
    parsed = raw.select(
        "session_id", "_ord",
        lenient_long("ts").alias("ts"),
        local_ms("local_ts_ms", server).alias("local_ts"),
        lenient_long("sequence").alias("sequence"),
        *[lenient_double(c).alias(c) for c in axes],
        *[F.lit(None).cast("double").alias(c) for c in missing],
        lenient_long(server).isNotNull().alias("has_server_ms"),
    )
    norm = lambda a, b, c: f"sqrt({a}*{a} + {b}*{b} + {c}*{c})"
    return parsed.selectExpr(
        "*", f"{norm(*ACC)} as acc_mag", f"{norm(*GYRO)} as gyro_mag", f"{norm(*GRAVITY)} as grav_mag",
    ).selectExpr(
        "*", "coalesce(gyro_mag, 0.0D) + 0.35D * coalesce(acc_mag, 0.0D) as motion_mag",
        "acc_mag is not null as has_accel", "gyro_mag is not null as has_gyro",
        "grav_mag is not null as has_gravity",
    )


def coerce_pen(raw: DataFrame) -> DataFrame:
    """Lenient parse of pen dots; local time falls back to the ISO text."""
    return raw.select(
        "session_id", "_ord",
        lenient_long("timestamp").alias("ts"),
        local_ms("local_ts_ms").alias("local_ts"),
        F.coalesce("dot_type", F.lit("")).alias("dot_type"),
        lenient_double("x").alias("x"), lenient_double("y").alias("y"),
        lenient_long("pressure").alias("pressure"),
        lenient_long("local_ts_ms").isNotNull().alias("has_local_ts_ms"),
    )


def stream_summary(stream: DataFrame, server_ms: str = "server_received_ms") -> DataFrame:
    """Rows, rows with server time and its range, per session."""
    t = lenient_long(server_ms)
    return stream.groupBy("session_id").agg(
        F.count("*").alias("row_count"), F.count(t).alias("server_time_rows"),
        F.min(t).alias("server_start_ms"), F.max(t).alias("server_end_ms"),
    )


def row_counts(stream: DataFrame, name: str = "rows") -> DataFrame:
    return stream.groupBy("session_id").agg(F.count("*").alias(name))


def last_rows(stream: DataFrame, cols: list[str]) -> DataFrame:
    """Newest row per session; combines map-side, no sort of the stream."""
    last = F.max_by(F.struct(*cols), F.struct("ts", "_ord")).alias("_r")
    return stream.groupBy("session_id").agg(last).select(
        "session_id", *[F.col(f"_r.{c}").alias(c) for c in cols]
    )


def recent_dots(pen: DataFrame, n: int = 2500) -> DataFrame:
    """The last ``n`` valid dots per session by arrival.

    Two ranking steps: each (session, ordinal block) keeps its own last ``n``
    first, so no task ranks more than the survivors of one session.
    """
    valid = pen.filter(
        F.expr("x is not null and y is not null and x <> -1 and y <> -1")
        & F.col("dot_type").isin(*STROKE_DOTS)
    )
    block = F.pmod(F.col("_ord"), F.lit(64))
    part = Window.partitionBy("session_id", "_block").orderBy(F.desc("_ord"))
    whole = Window.partitionBy("session_id").orderBy(F.desc("_ord"))
    return (
        valid.withColumn("_block", block)
        .withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= n)
        .withColumn("_r", F.row_number().over(whole)).filter(F.col("_r") <= n)
        .drop("_block", "_r")
    )
