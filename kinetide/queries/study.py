"""Study design tables and set operations."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.align import top_per_key
from ..plans import study as sd
from ..session import fresh_path
from .data import SAMPLES, samples, table
from .registry import query


def protocol_json(spark, sf):
    """One protocol per brand and block of 500 parts, with its parts as tasks, written as JSON files."""
    path = fresh_path(spark, "protocols")
    p = table(spark, sf, "part").selectExpr(
        "concat(p_brand, '-', cast(p_partkey div 500 as string)) as id", "struct(p_partkey as o, concat('p', cast(if(p_size = 50, 0, p_partkey) as string)) as id, p_name as label, "
        "if(p_size % 3 = 0, 'idle', 'writing') as category, p_size as duration_seconds, cast(p_partkey % 3 + 1 as int) as instances) as t",
    )
    tasks = p.groupBy("id").agg(F.array_sort(F.collect_list("t")).alias("tasks"))
    tasks.selectExpr(
        "id", "id as name", "3 as pre_task_seconds", "transform(tasks, t -> struct(t.id, t.label, t.category, t.duration_seconds, t.instances)) as tasks"
    ).write.json(path)
    return spark.read.schema(sd.PROTOCOL).json(path)


PT = """pt0 AS (SELECT *, p_brand || '-' || (p_partkey // 500) AS protocol_id FROM part), pt AS (SELECT protocol_id, p_partkey, 'p' || CASE WHEN p_size = 50 THEN 0 ELSE p_partkey END AS task_id, CASE WHEN p_size % 3 = 0 THEN 'idle' ELSE 'writing' END AS category, p_size AS duration_seconds, p_partkey % 3 + 1 AS instances,
  row_number() OVER (PARTITION BY protocol_id ORDER BY p_partkey) - 1 AS pos FROM pt0), bad AS (SELECT protocol_id FROM pt GROUP BY 1 HAVING count(DISTINCT task_id) < count(*) OR min(duration_seconds) <= 0), ok AS (SELECT * FROM pt WHERE protocol_id NOT IN (SELECT protocol_id FROM bad))"""


@query("j1_protocol_scan", "WITH " + PT + " SELECT protocol_id, task_id, category, CAST(duration_seconds AS INT) AS duration_seconds, CAST(instances AS INT) AS instances FROM ok")
def _(spark, sf):
    return sd.protocol_tasks(protocol_json(spark, sf)).drop("pos")


@query("j2_counterbalance", """WITH s AS (SELECT DISTINCT CAST(p_size AS INT) AS n FROM part), r AS (SELECT n, CAST(unnest(range(CASE WHEN n = 1 OR n % 2 = 0 THEN n ELSE 2 * n END)) AS INT) AS row FROM s), p AS (
  SELECT n, row, CAST(unnest(range(n)) AS INT) AS position FROM r), i AS (SELECT *, CASE WHEN row < n THEN position ELSE n - 1 - position END AS i FROM p)
  SELECT n, row, position, CAST((CASE WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - i // 2 END + row % n) % n AS INT) AS item FROM i""")
def _(spark, sf):
    sizes = table(spark, sf, "part").select(F.col("p_size").alias("n")).distinct()
    return sd.counterbalance(sizes).selectExpr("cast(n as int) as n", "cast(row as int) as row", "cast(position as int) as position", "cast(item as int) as item")


@query("j3_schedule", "WITH " + PT + """, x AS (SELECT protocol_id, category, task_id, pos, unnest(range(1, CAST(instances AS INT) + 1)) AS inst FROM ok), it AS (SELECT *, row_number() OVER (PARTITION BY protocol_id, category ORDER BY pos, inst) - 1 AS item, count(*) OVER (PARTITION BY protocol_id, category) AS n FROM x), sz AS (
  SELECT DISTINCT protocol_id, category, n FROM it), mm AS (SELECT protocol_id, CASE WHEN count(*) = 2 THEN min(n) ELSE 0 END AS m FROM sz GROUP BY 1), g AS (SELECT sz.*, s.subj, (s.subj - 1) % CASE WHEN n = 1 OR n % 2 = 0 THEN n ELSE 2 * n END AS row, unnest(range(n)) AS position FROM sz CROSS JOIN (SELECT n_nationkey + 1 AS subj FROM nation) s), h AS (
  SELECT *, CASE WHEN row < n THEN position ELSE n - 1 - position END AS i FROM g), v AS (SELECT *, (CASE WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - i // 2 END + row % n) % n AS item FROM h)
  SELECT v.protocol_id, v.subj AS subject_index, CAST(CASE WHEN position < m THEN 2 * position + CASE WHEN v.category = 'idle' THEN 1 ELSE 0 END ELSE 2 * m + position - m END + 1 AS INT) AS task_index, it.task_id, v.category
  FROM v JOIN it ON it.protocol_id = v.protocol_id AND it.category = v.category AND it.item = v.item JOIN mm ON mm.protocol_id = v.protocol_id""")
def _(spark, sf):
    subjects = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("subject_index"))
    s = sd.schedule(sd.protocol_tasks(protocol_json(spark, sf)), subjects)
    return s.select("protocol_id", "subject_index", "task_index", "task_id", "category")


# ── L: sort, top-k, set operations ──────────────────────────────────────────


@query("l1_stable_order", "WITH" + SAMPLES + " SELECT session_id, _ord, row_number() OVER (PARTITION BY session_id ORDER BY ts // 86400000, _ord) - 1 AS rn FROM samples")
def _(spark, sf):
    from ..kernels import Ordering, with_chunks
    from ..kernels.order import row_numbers

    # Whole days tie; arrival decides.
    s = samples(spark, sf).withColumn("ts", F.expr("ts div 86400000"))
    c = with_chunks(s, ["session_id"], "ts", "_ord", 10)
    return row_numbers(c, Ordering(("session_id",), ("ts", "_ord"))).select("session_id", "_ord", "rn")


@query("l2_top_k", "WITH" + SAMPLES + " SELECT session_id, _ord, v FROM samples QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY v DESC, _ord) <= 5")
def _(spark, sf):
    return top_per_key(samples(spark, sf), ["session_id"], [F.desc("v"), F.asc("_ord")], 5, F.pmod("_ord", F.lit(16))).select("session_id", "_ord", "v")


@query("l3_union_missing_columns", "WITH" + SAMPLES + " SELECT event_type, count(*) AS n, count(CASE WHEN event_type <> 'view' THEN k END) AS with_k FROM samples GROUP BY 1")
def _(spark, sf):
    s = samples(spark, sf)
    parts = [s.filter("event_type <> 'view'").select("event_type", "v", "k"), s.filter("event_type = 'view'").select("event_type", "v")]
    u = reduce(lambda a, b: DataFrame.unionByName(a, b, allowMissingColumns=True), parts)
    return u.groupBy("event_type").agg(F.count("*").alias("n"), F.count("k").alias("with_k"))


@query("l4_common_folds", "SELECT o_custkey AS held_out FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def _(spark, sf):
    o = table(spark, sf, "orders")
    pick = lambda st: o.filter(F.col("o_orderstatus") == st).select(F.col("o_custkey").alias("held_out"))
    return pick("F").intersect(pick("O"))


@query("l5_difference", "SELECT c_custkey AS held_out FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(done, "c_custkey", "left_anti").withColumnRenamed("c_custkey", "held_out")


@query("l6_first_seen", "WITH" + SAMPLES + " SELECT person_id, min(_ord) AS first_ord FROM samples GROUP BY 1 ORDER BY 2")
def _(spark, sf):
    return samples(spark, sf).groupBy("person_id").agg(F.min("_ord").alias("first_ord")).orderBy("first_ord")
