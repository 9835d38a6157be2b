"""Tool calls of conversations: linked with their results, ordered, validated and written as canonical JSON.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

KEY = ["conv_id", "call_id"]


def _ids(df: DataFrame) -> DataFrame:
    """Ids as text; a null id is the empty id."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in KEY})


def json_type(value: Column) -> Column:
    """The JSON schema type of a variant."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "BIGINT", "integer").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
    )


def validated(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, call_id, valid): 'valid', 'malformed', 'unknown tool' or 'invalid'.

    ``schemas`` has (name, param, type, required).  Arguments are valid if they are a JSON object, every
    member is a parameter of the tool and of its type (an integer is a number), and no required one lacks.
    """
    known = schemas.select("name", "param", F.col("type").alias("_type"), F.col("required").cast("boolean").alias("_required")).dropDuplicates(["name", "param"])
    tools = known.groupBy("name").agg(F.sum(F.col("_required").cast("int")).alias("_needed"))
    parsed = calls.select(*KEY, "name", F.try_parse_json("arguments").alias("args"))
    is_object = F.coalesce(F.schema_of_variant("args").startswith("OBJECT"), F.lit(False))
    members = parsed.where(is_object).lateralJoin(calls.sparkSession.tvf.variant_explode(F.col("args").outer()).select(F.col("key").alias("param"), F.col("value").alias("_value")))
    fits = (F.col("_type") == json_type(F.col("_value"))) | ((F.col("_type") == "number") & (json_type(F.col("_value")) == "integer"))
    judged = members.select(*KEY, "name", "param", "_value").join(known, ["name", "param"], "left").groupBy(*KEY).agg(
        F.sum((~F.coalesce(fits, F.lit(False))).cast("int")).alias("_bad"), F.sum(F.coalesce(F.col("_required") & fits, F.lit(False)).cast("int")).alias("_met"))
    out = parsed.select(*KEY, "name", is_object.alias("_object")).join(tools, "name", "left").join(judged, KEY, "left")
    ok = (F.coalesce("_bad", F.lit(0)) == 0) & (F.coalesce("_met", F.lit(0)) == F.col("_needed"))
    return out.select(*KEY, F.when(~F.col("_object"), "malformed").when(F.col("_needed").isNull(), "unknown tool").when(ok, "valid").otherwise("invalid").alias("valid"))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): the longest chain of calls that a call waits for; null in or behind a cycle.

    ``after`` names the calls that must come first; names of no call are ignored.  Each round drops the
    edges to calls that wait for nothing more and writes what is left, so it runs as many rounds as the
    longest chain has calls, over ever fewer rows, and keys are single calls however long a conversation is.
    A call without any such edge isn't in the result.
    """
    edges = calls.select(*KEY, F.explode("after").alias("needs")).where(F.col("needs").isNotNull()).distinct()
    known = calls.select("conv_id", F.col("call_id").alias("needs"))
    waiting = staged(edges.join(known, ["conv_id", "needs"], "left_semi"), "call-edges")
    rounds, left = [waiting], waiting.count()
    while left:
        blocked = waiting.select("conv_id", F.col("call_id").alias("needs")).distinct()
        after = staged(waiting.join(blocked, ["conv_id", "needs"], "left_semi"), "call-edges")
        now = after.count()
        if now == left:
            break
        waiting, left = after, now
        rounds.append(waiting)
    blocked_in = [r.select(*KEY, F.lit(i).alias("_round")).distinct() for i, r in enumerate(rounds)]
    union = blocked_in[0]
    for b in blocked_in[1:]:
        union = union.unionByName(b)
    cycle = len(rounds) - 1 if left else -1
    most = F.max("_round")
    return union.groupBy(*KEY).agg(F.when(most != cycle, most + 1).cast("long").alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per result without a call, with its canonical JSON.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), after (array of call ids).
    ``results``: conv_id, call_id, content.  ``schemas``: name, param, type, required.
    Columns: conv_id, call_id, turn, level, status ('answered', 'unanswered' or 'orphan'), valid, json.

    (level, turn, call_id) is a topological order of a conversation's calls; level is null for calls in or
    behind a cycle and for orphans.  Repeated calls or results of one id count once: the least by all
    columns.  Null ids are the empty id, other nulls leave their member out of the JSON.  Canonical JSON
    has sorted members, no blanks, and arguments as parsed; arguments that are no JSON stand as text.
    All joins are on (conv_id, call_id), so a conversation of any length is spread by its calls.
    """
    calls = _ids(calls).groupBy(*KEY).agg(F.min(F.struct(
        F.col("turn").cast("long").alias("turn"), F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments"),
        F.array_sort(F.coalesce(F.col("after").cast("array<string>"), F.array().cast("array<string>"))).alias("after"))).alias("c")).select(*KEY, "c.*")
    calls = staged(calls, "calls")
    answers = _ids(results).groupBy(*KEY).agg(F.min(F.col("content").cast("string")).alias("content"), F.lit(True).alias("_answer"))
    placed = calls.join(validated(calls, schemas), KEY, "left").join(levels(calls).withColumn("_waits", F.lit(True)), KEY, "left").drop("after")
    placed = placed.withColumn("level", F.when(F.col("_waits").isNull(), F.lit(0).cast("long")).otherwise(F.col("level"))).withColumn("_call", F.lit(True))
    both = placed.join(answers, KEY, "full")
    status = F.when(F.col("_call").isNull(), "orphan").when(F.col("_answer").isNull(), "unanswered").otherwise("answered")
    args = F.coalesce(F.try_parse_json("arguments"), F.try_parse_json(F.to_json(F.struct(F.col("arguments").alias("text")))))
    out = both.withColumn("status", status)
    members = F.struct(
        F.when(F.col("arguments").isNotNull(), args).alias("arguments"), F.col("call_id").alias("call_id"), F.col("conv_id").alias("conversation"), "level", "name",
        F.col("content").alias("result"), "status", "turn", "valid")
    return out.select(*KEY, "turn", "level", "status", "valid", F.to_json(members).alias("json"))


#: Parameters of the tools that the registered query derives calls for.
SCHEMAS = [
    ("lookup", "key", "string", True), ("lookup", "exact", "boolean", False),
    ("search", "query", "string", True), ("search", "limit", "integer", True),
    ("translate", "text", "string", True), ("translate", "weight", "number", False),
]


def derived(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results as a conversation table implies them.

    An assistant turn is a call whose tool and arguments follow from its text and length: some lengths give
    a wrong type, a missing or unknown member or broken JSON.  It may wait for the assistant turn before or
    after it.  A user turn answers the call of the turn before.
    """
    n, text = F.length("text"), F.coalesce(F.col("text"), F.lit(""))
    quoted = F.regexp_replace(F.to_json(F.struct(text.alias("t"))), r"^\{\"t\":|\}$", "")
    name_of = lambda shift: F.concat(F.lit("c"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("."), (F.col("turn") + shift).cast("string"))
    name = F.element_at(F.array(*[F.lit(x) for x in ("lookup", "search", "translate", "draw")]), (n % 4 + 1).cast("int"))
    limit = F.when(n % 10 == 3, F.concat(F.lit('"'), n.cast("string"), F.lit('"'))).otherwise(n.cast("string"))
    body = (
        F.when(n % 4 == 0, F.concat(F.lit('{ "key": '), quoted, F.lit(', "exact": '), F.when(n % 8 == 0, "true").otherwise("false"), F.lit(" }")))
        .when(n % 4 == 1, F.concat(F.lit('{"query": '), quoted, F.when(n % 7 == 2, F.lit("")).otherwise(F.concat(F.lit(', "limit": '), limit)), F.lit("}")))
        .when(n % 4 == 2, F.concat(F.lit('{"weight":'), n.cast("string"), F.lit(', "text":'), quoted, F.when(n % 5 == 1, F.lit(', "to": null')).otherwise(F.lit("")), F.lit("}")))
        .otherwise(F.concat(F.lit('{"shape": '), quoted, F.lit("}")))
    )
    broken = F.when(n % 11 == 5, F.concat(F.lit("{"), body)).otherwise(body)
    after = F.filter(F.array(F.when(n % 3 == 0, name_of(-2)), F.when(n % 17 == 0, name_of(2))), lambda x: x.isNotNull())
    calls = turns.where(F.col("role") == "assistant").select("conv_id", name_of(0).alias("call_id"), "turn", name.alias("name"), broken.alias("arguments"), after.alias("after"))
    results = turns.where(F.col("role") == "user").select("conv_id", name_of(-1).alias("call_id"), F.col("text").alias("content"))
    return calls, results


SQL = """
WITH RECURSIVE t AS (SELECT coalesce(conv_id::VARCHAR, '') AS conv_id, turn, role, text, length(text) AS n, to_json(coalesce(text, ''))::VARCHAR AS q FROM conversations),
schemas(name, needed) AS (VALUES ('lookup', 1), ('search', 2), ('translate', 1)),
raw AS (
  SELECT conv_id, 'c' || conv_id || '.' || turn AS call_id, turn,
    CASE n % 4 WHEN 0 THEN 'lookup' WHEN 1 THEN 'search' WHEN 2 THEN 'translate' WHEN 3 THEN 'draw' END AS name,
    CASE n % 4
      WHEN 0 THEN '{"exact":' || CASE WHEN n % 8 = 0 THEN 'true' ELSE 'false' END || ',"key":' || q || '}'
      WHEN 1 THEN '{' || CASE WHEN n % 7 = 2 THEN '' ELSE '"limit":' || CASE WHEN n % 10 = 3 THEN '"' || n || '"' ELSE n::VARCHAR END || ',' END || '"query":' || q || '}'
      WHEN 2 THEN '{"text":' || q || CASE WHEN n % 5 = 1 THEN ',"to":null' ELSE '' END || ',"weight":' || n || '}'
      ELSE '{"shape":' || q || '}' END AS canonical,
    CASE n % 4
      WHEN 0 THEN '{ "key": ' || q || ', "exact": ' || CASE WHEN n % 8 = 0 THEN 'true' ELSE 'false' END || ' }'
      WHEN 1 THEN '{"query": ' || q || CASE WHEN n % 7 = 2 THEN '' ELSE ', "limit": ' || CASE WHEN n % 10 = 3 THEN '"' || n || '"' ELSE n::VARCHAR END END || '}'
      WHEN 2 THEN '{"weight":' || n || ', "text":' || q || CASE WHEN n % 5 = 1 THEN ', "to": null' ELSE '' END || '}'
      ELSE '{"shape": ' || q || '}' END AS body,
    CASE WHEN n % 11 = 5 THEN 'malformed' WHEN n % 4 = 3 THEN 'unknown tool'
         WHEN n % 4 = 1 AND (n % 7 = 2 OR n % 10 = 3) OR n % 4 = 2 AND n % 5 = 1 THEN 'invalid' ELSE 'valid' END AS valid,
    n
  FROM t WHERE role = 'assistant'
),
calls AS (SELECT conv_id, call_id, min({'turn': turn, 'name': name, 'arguments': CASE WHEN n % 11 = 5 THEN '{' ELSE '' END || body, 'canonical': canonical, 'valid': valid, 'n': n}) AS c FROM raw GROUP BY ALL),
edges AS (
  SELECT e.* FROM (
    SELECT conv_id, call_id, 'c' || conv_id || '.' || (c.turn - 2) AS needs FROM calls WHERE c.n % 3 = 0
    UNION SELECT conv_id, call_id, 'c' || conv_id || '.' || (c.turn + 2) FROM calls WHERE c.n % 17 = 0
  ) e JOIN calls k ON k.conv_id = e.conv_id AND k.call_id = e.needs
),
walk AS (
  SELECT conv_id, call_id, call_id AS at, 0 AS depth FROM calls
  UNION SELECT w.conv_id, w.call_id, e.needs, w.depth + 1 FROM walk w JOIN edges e ON e.conv_id = w.conv_id AND e.call_id = w.at WHERE w.depth < 40
),
depth AS (SELECT conv_id, call_id, CASE WHEN max(depth) < 40 THEN max(depth) END AS level FROM walk GROUP BY ALL),
answers AS (SELECT conv_id, 'c' || conv_id || '.' || (turn - 1) AS call_id, min(text) AS content, true AS answered FROM t WHERE role = 'user' GROUP BY ALL),
linked AS (
  SELECT coalesce(c.conv_id, a.conv_id) AS conv_id, coalesce(c.call_id, a.call_id) AS call_id, c.c AS c, c.call_id IS NOT NULL AS is_call, d.level AS level, a.content AS content,
    CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN a.answered IS NULL THEN 'unanswered' ELSE 'answered' END AS status
  FROM calls c LEFT JOIN depth d USING (conv_id, call_id) FULL JOIN answers a ON a.conv_id = c.conv_id AND a.call_id = c.call_id
)
SELECT conv_id, call_id, c.turn AS turn, level::BIGINT AS level, status, c.valid AS valid,
  '{' || CASE WHEN is_call AND c.valid = 'malformed' THEN '"arguments":{"text":' || to_json(c.arguments)::VARCHAR || '},' WHEN is_call THEN '"arguments":' || c.canonical || ',' ELSE '' END
  || '"call_id":' || to_json(call_id)::VARCHAR || ',"conversation":' || to_json(conv_id)::VARCHAR
  || CASE WHEN level IS NULL THEN '' ELSE ',"level":' || level END || CASE WHEN c.name IS NULL THEN '' ELSE ',"name":"' || c.name || '"' END
  || CASE WHEN content IS NULL THEN '' ELSE ',"result":' || to_json(content)::VARCHAR END || ',"status":"' || status || '"'
  || CASE WHEN c.turn IS NULL THEN '' ELSE ',"turn":' || c.turn END || CASE WHEN c.valid IS NULL THEN '' ELSE ',"valid":"' || c.valid || '"' END || '}' AS json
FROM linked
"""
