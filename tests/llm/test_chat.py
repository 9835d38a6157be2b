"""Tool calls: links, order, validation, canonical JSON."""

import json

from kinetide.llm import chat

CALLS = "conv_id long, call_id string, turn long, name string, arguments string, after array<string>, status int"
RESULTS = "conv_id long, call_id string, content string"
SCHEMAS = "name string, param string, type string, required boolean"


def linked(spark, calls, results):
    schemas = spark.createDataFrame([*chat.SCHEMAS, ("search", "limit", "integer", True)], SCHEMAS)
    df = chat.link(spark.createDataFrame([(*c, 1) for c in calls], CALLS), spark.createDataFrame(results, RESULTS), schemas)
    rows = df.collect()
    out = {(r.conv_id, r.call_id): r for r in rows}
    assert len(out) == len(rows)
    return out


def test_links_levels_and_validation(spark):
    ok = '{"limit": 2, "query": "a\\u00e9\\n\\"q\\""}'
    calls = [
        (1, "a", 1, "search", ok, None), (1, "b", 2, "search", '{"query":"x"}', ["a", "gone", None]), (1, "c", 3, "lookup", '{"key": 3}', ["b", "a"]),
        (1, "d", 4, "draw", "{}", ["e"]), (1, "e", 5, "lookup", "{oops", ["f"]), (1, "f", 6, "lookup", '{"key":"k","more":1}', ["e"]),
        (1, "g", 7, "lookup", "[1]", ["g"]), (1, "h", 8, "translate", '{"text":"t","weight":1.5}', []), (1, "i", 9, "translate", '{"weight":1,"text":"t"}', ["d"]),
        (2, "a", 1, "search", None, ["c"]), (None, None, None, None, None, None), (1, "a", 1, "search", ok, None), (3, "n", 1, "search", '{"query":"x","limit":null}', None),
    ]
    results = [(1, "a", "one"), (1, "a", "two"), (1, "zz", "lost"), (2, "b", None), (None, None, "nobody's")]
    got = linked(spark, calls, results)
    level = {k[1]: r.level for k, r in got.items() if k[0] == "1"}
    assert level == {"a": 0, "b": 1, "c": 2, "d": None, "e": None, "f": None, "g": None, "h": 0, "i": None, "zz": None}
    valid = {k[1]: r.valid for k, r in got.items() if k[0] == "1"}
    assert valid == {"a": "valid", "b": "invalid", "c": "invalid", "d": "unknown tool", "e": "malformed", "f": "invalid", "g": "malformed", "h": "valid", "i": "valid", "zz": None}
    assert got["3", "n"].valid == "invalid" and got["2", "a"].valid == "malformed" and got["2", "a"].level == 0
    status = {k: r.status for k, r in got.items()}
    assert status["1", "a"] == "answered" and status["1", "b"] == "unanswered" and status["1", "zz"] == status["2", "b"] == "orphan" and status["", ""] == "answered"
    assert got["1", "a"].json == '{"arguments":{"limit":2,"query":"aé\\n\\"q\\""},"call_id":"a","conversation":"1","level":0,"name":"search","result":"one","status":"answered","turn":1,"valid":"valid"}'
    for r in got.values():
        keys = list(json.loads(r.json))
        assert keys == sorted(keys)
    assert json.loads(got["1", "e"].json)["arguments"] == {"text": "{oops"}


def test_long_chain_and_empty(spark):
    calls = [(1, f"k{i}", i, "draw", "{}", [f"k{i - 1}"]) for i in range(12)]
    got = linked(spark, calls, [])
    assert [got["1", f"k{i}"].level for i in range(12)] == list(range(12))
    assert linked(spark, [], []) == {}


def test_derived_calls_of_odd_turns(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", None), (1, 1, "user", None), (None, 2, "assistant", "x"), (1, None, "assistant", "x"), (1, 0, "assistant", None), (1, 5, None, "x")], "conv_id long, turn long, role string, text string")
    calls, results = chat.derived(turns)
    assert chat.link(calls, results, spark.createDataFrame(chat.SCHEMAS, SCHEMAS)).count() >= 2
