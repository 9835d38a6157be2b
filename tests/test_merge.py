"""The merge of raw streams."""

from pyspark.sql import functions as F

from kinetide.plans.merge import merge_sessions
from kinetide.schema import GRAVITY, IMU


def test_streams_are_read_once(spark):
    """Every row of both streams goes through one pass of its parse, whatever reads the parsed stream later."""
    parsed = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def parse(x):
        parsed.add(1)
        return None if x is None else float(x)

    w = spark.createDataFrame([("A", i, str(i * 20)) for i in range(200)], "session_id string, _ord long, ts string")
    w = w.select("session_id", "_ord", parse("ts").cast("long").alias("ts"), F.col("ts").cast("long").alias("local_ts"), *[F.sin(F.col("_ord") * (i + 1)).alias(c) for i, c in enumerate(IMU)], *[F.lit(None).cast("double").alias(c) for c in GRAVITY])
    p = spark.createDataFrame([("A", i, ("PEN_DOWN", "PEN_MOVE", "PEN_UP")[i % 3], str(500 + i * 40)) for i in range(30)], "session_id string, _ord long, dot_type string, t string")
    p = p.select("session_id", "_ord", "dot_type", F.lit(1.0).alias("x"), F.lit(1.0).alias("y"), F.col("t").cast("long").alias("ts"), parse("t").cast("long").alias("local_ts"))
    out = merge_sessions(w, p, width=1000)
    assert out.count() == 200 and {r.ts for r in out.collect()} == {i * 20 for i in range(200)}
    assert parsed.value <= 2 * 230  # in the row and in the filter of rows without a time
