"""The registry and a few registered queries end to end."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["a9_index_upsert", "b3_replay_dedup", "b17_subject_index", "c1_nearest_asof", "d7_gap_regions", "e10_focus_stretches", "f3_spectral", "g17_rotating_roles", "i4_live_gaps", "j2_counterbalance"]


def test_registry_is_consistent():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 200
    assert all(name == name.lower() for name in q)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["session_id", "date", "weekday", "writing_seconds", "is_today", "max_seconds"]
    assert df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    want = sorted(map(repr, [tuple(sorted(zip(cols, r))) for r in rel.fetchall()]))
    df = entry.queries()[name](spark, SF)
    got = sorted(map(repr, [tuple(sorted(zip(df.columns, r))) for r in df.collect()]))
    assert got == want
