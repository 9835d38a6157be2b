"""Study protocols, counterbalancing and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PROTOCOL = (
    "id string, name string, pre_task_seconds int, randomize boolean, interleave string, duration_jitter_pct double, "
    "tasks array<struct<id: string, label: string, category: string, duration_seconds: int, instances: int>>"
)


def read_protocols(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROTOCOL).option("multiLine", True).json(path)


def valid_protocols(protocols: DataFrame) -> DataFrame:
    """Protocols with tasks, unique task ids, known categories, positive durations and 1 to 20 instances."""
    ok = (
        "size(tasks) > 0 and size(array_distinct(transform(tasks, t -> t.id))) = size(tasks) and forall(tasks, t -> "
        "t.category in ('writing', 'idle') and t.duration_seconds > 0 and coalesce(t.instances, 1) between 1 and 20)"
    )
    return protocols.filter(ok)


def protocol_tasks(protocols: DataFrame) -> DataFrame:
    return valid_protocols(protocols).selectExpr("id as protocol_id", "posexplode(tasks) as (pos, t)").selectExpr(
        "protocol_id", "pos", "t.id as task_id", "t.category as category", "t.duration_seconds as duration_seconds",
        "coalesce(t.instances, 1) as instances",
    )


def _starter(i: str) -> str:
    """Williams starter row 0, n-1, 1, n-2, ..."""
    return f"if({i} % 2 = 0, {i} div 2, n - 1 - {i} div 2)"


def counterbalance(sizes: DataFrame) -> DataFrame:
    """Balanced Latin square rows for each ``n``: n rows, or 2n (with reversals) when n is odd."""
    rows = sizes.filter("n >= 1").selectExpr("*", "if(n = 1 or n % 2 = 0, n, 2 * n) as n_rows").selectExpr(
        "*", "explode(sequence(0, n_rows - 1)) as row"
    ).selectExpr("*", "explode(sequence(0, n - 1)) as position")
    at = "if(row < n, position, n - 1 - position)"
    return rows.selectExpr("*", f"{at} as _i").selectExpr("*", f"({_starter('_i')} + row % n) % n as item").drop("_i")


def expand_instances(tasks: DataFrame) -> DataFrame:
    """One row per task instance with its position inside the category, in protocol order."""
    rows = tasks.selectExpr("*", "explode(sequence(1, instances)) as instance")
    w = Window.partitionBy("protocol_id", "category").orderBy("pos", "instance")  # one protocol's task list
    return rows.withColumn("item", F.row_number().over(w) - 1)


def schedule(tasks: DataFrame, subjects: DataFrame, *, mode: str = "latin_square", seed: int = 42) -> DataFrame:
    """Ordered slots per protocol and subject (``subject_index`` from 1).

    Writing and idle lists are permuted by the subject's square row (or by hash
    for other modes), then alternate; the longer list's rest goes to the end.
    """
    items = expand_instances(tasks)
    sizes = items.groupBy("protocol_id", "category").agg(F.count("*").cast("int").alias("n"))
    who = subjects.select("subject_index").distinct()
    # Subjects times task lists: a design table, independent of recorded rows.
    grid = sizes.crossJoin(who)
    if mode == "latin_square":
        grid = grid.selectExpr("*", "cast((subject_index - 1) % if(n = 1 or n % 2 = 0, n, 2 * n) as int) as row").selectExpr(
            "*", "explode(sequence(0, n - 1)) as position"
        ).selectExpr("*", "if(row < n, position, n - 1 - position) as _i").selectExpr("*", f"cast(({_starter('_i')} + row % n) % n as int) as item")
        placed = grid.join(items, ["protocol_id", "category", "item"])
    else:
        w = Window.partitionBy("protocol_id", "category", "subject_index").orderBy(
            F.xxhash64("protocol_id", "subject_index", "item", F.lit(seed)), "item"
        )
        placed = grid.join(items, ["protocol_id", "category"]).withColumn("position", F.row_number().over(w) - 1)
    other = sizes.selectExpr("protocol_id", "if(category = 'writing', 'idle', 'writing') as category", "n as _other")
    slot = "if(position < _m, 2 * position + if(category = 'idle', 1, 0), 2 * _m + (position - _m)) + 1"
    return placed.join(other, ["protocol_id", "category"], "left").selectExpr(
        "*", "least(n, coalesce(_other, 0)) as _m"
    ).selectExpr("protocol_id", "subject_index", f"cast({slot} as int) as task_index", "task_id", "category", "instance", "duration_seconds")
