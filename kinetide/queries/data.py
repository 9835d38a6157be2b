"""The given tables in the roles of sensor tables, on both sides.

Each Spark frame here has a SQL twin of the same name and columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import Ordering, with_chunks
from ..session import configure

DAY = 86_400_000
HOUR = 3_600_000
WIDTH = 10 * DAY
SEQ = Ordering(("session_id",), ("ts", "_ord"))


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf}/{name}.parquet")


def millis(c: str) -> Column:
    """Epoch milliseconds of a stored timestamp, with or without zone."""
    return F.unix_millis(F.col(c).cast("timestamp"))


def rnd(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero folds -0.0 into 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """events as IMU samples: session = user, person = user mod 20."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(
        F.col("user_id").alias("session_id"),
        (F.col("user_id") % 20).alias("person_id"),
        F.col("event_id").alias("_ord"),
        millis("ts").alias("ts"),
        "event_type",
        F.col("value").alias("v"),
        k.alias("k"),
        F.when(F.col("event_type").isin("click", "purchase"), 1).otherwise(0).alias("label"),
        F.least(F.col("value") / 200.0, F.lit(1.0)).alias("p"),
    )


SAMPLES = """
samples AS (
  SELECT user_id AS session_id, user_id % 20 AS person_id, event_id AS _ord, epoch_us(ts) // 1000 AS ts,
         event_type, value AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CASE WHEN event_type IN ('click','purchase') THEN 1 ELSE 0 END AS label,
         least(value / 200.0, 1.0) AS p
  FROM events)"""


def chunked(df: DataFrame) -> DataFrame:
    return with_chunks(df, ["session_id"], "ts", "_ord", WIDTH)


def ordered_samples(spark: SparkSession, sf: str) -> DataFrame:
    return chunked(samples(spark, sf))


def watch(spark: SparkSession, sf: str) -> DataFrame:
    """Six-axis samples with arrival time and batch sequence."""
    s = samples(spark, sf)
    v, k = F.col("v"), F.col("k")
    return s.select(
        "session_id", "person_id", "_ord", "ts",
        (F.col("ts") + (k * 20).cast("long")).alias("local_ts"),
        k.cast("long").alias("sequence"),
        (v / 10).alias("ax"), (k / 10).alias("ay"), ((v - k) / 20).alias("az"),
        F.sqrt(v).alias("rx"), (k * k / 1000).alias("ry"), ((v * k) / 1000).alias("rz"),
        (v / 100).alias("gx"), (k / 100 - 0.5).alias("gy"), F.lit(1.0).alias("gz"),
        "label", "p", "event_type",
    )


WATCH = SAMPLES + """, watch AS (
  SELECT session_id, person_id, _ord, ts, ts + CAST(k * 20 AS BIGINT) AS local_ts,
         CAST(k AS BIGINT) AS sequence,
         v / 10 AS ax, k / 10 AS ay, (v - k) / 20 AS az,
         sqrt(v) AS rx, k * k / 1000 AS ry, (v * k) / 1000 AS rz,
         v / 100 AS gx, k / 100 - 0.5 AS gy, 1.0::DOUBLE AS gz, label, p, event_type
  FROM samples)"""


def pen(spark: SparkSession, sf: str) -> DataFrame:
    """events as pen dots; a third of the positions carry the -1 marker."""
    s = samples(spark, sf)
    kind = (
        F.when(F.col("event_type") == "signup", "PEN_DOWN")
        .when(F.col("event_type").isin("click", "view"), "PEN_MOVE")
        .when(F.col("event_type") == "error", "PEN_UP")
        .otherwise("PEN_HOVER")
    )
    gone = F.col("k") % 3 == 0
    return s.select(
        "session_id", "person_id", "_ord", "ts",
        (F.col("ts") + (F.col("k") * 20).cast("long")).alias("local_ts"),
        kind.alias("dot_type"),
        F.when(gone, -1.0).otherwise(F.col("v")).alias("x"),
        F.when(gone, -1.0).otherwise(F.col("k")).alias("y"),
    )


PEN = SAMPLES + """, pen AS (
  SELECT session_id, person_id, _ord, ts, ts + CAST(k * 20 AS BIGINT) AS local_ts,
         CASE WHEN event_type = 'signup' THEN 'PEN_DOWN' WHEN event_type IN ('click','view') THEN 'PEN_MOVE'
              WHEN event_type = 'error' THEN 'PEN_UP' ELSE 'PEN_HOVER' END AS dot_type,
         CASE WHEN k % 3 = 0 THEN -1.0 ELSE v END::DOUBLE AS x,
         CASE WHEN k % 3 = 0 THEN -1.0 ELSE k END::DOUBLE AS y
  FROM samples)"""


def markers(spark: SparkSession, sf: str) -> DataFrame:
    """signup = task_start, error = task_end; index k mod 10, writing when k is even."""
    s = samples(spark, sf).filter(F.col("event_type").isin("signup", "error", "view"))
    kind = (
        F.when(F.col("event_type") == "signup", "task_start")
        .when(F.col("event_type") == "error", "task_end")
        .otherwise("pause")
    )
    k = F.col("k").cast("long")
    return s.select(
        "session_id", "person_id", "_ord", F.col("ts").alias("timestamp_ms"), kind.alias("event"),
        (k % 10).alias("task_index"), F.concat(F.lit("T"), (k % 4).cast("string")).alias("task_id"),
        F.when(k % 2 == 0, "writing").otherwise("idle").alias("task_category"),
    )


MARKERS = SAMPLES + """, markers AS (
  SELECT session_id, person_id, _ord, ts AS timestamp_ms,
         CASE event_type WHEN 'signup' THEN 'task_start' WHEN 'error' THEN 'task_end' ELSE 'pause' END AS event,
         CAST(k AS BIGINT) % 10 AS task_index, 'T' || CAST(CAST(k AS BIGINT) % 4 AS VARCHAR) AS task_id,
         CASE WHEN CAST(k AS BIGINT) % 2 = 0 THEN 'writing' ELSE 'idle' END AS task_category
  FROM samples WHERE event_type IN ('signup','error','view'))"""


def oof(spark: SparkSession, sf: str) -> DataFrame:
    """Out-of-fold predictions: raw probability p, calibrated probability from k."""
    s = samples(spark, sf)
    return s.select(
        "session_id", "person_id", "_ord", F.col("ts").alias("t_center_ms"), "ts", "label",
        F.col("p").alias("proba_raw"), ((F.col("k") + 50.0 * F.col("label")) / 150.0).alias("proba_cal"),
    )


OOF = SAMPLES + """, oof AS (
  SELECT session_id, person_id, _ord, ts AS t_center_ms, ts, label, p AS proba_raw,
         (k + 50.0 * label) / 150.0 AS proba_cal
  FROM samples)"""


def oof_tasks(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions with the task read off the sample itself."""
    return oof(spark, sf).join(
        samples(spark, sf).select(
            "_ord", F.col("event_type").alias("task_id"),
            F.when(F.col("event_type").isin("click", "purchase"), "writing").otherwise("idle").alias("task_category"),
        ), "_ord",
    )


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """64-value vectors as signal windows."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("x"), "label"
    )
