"""Registered queries against SQL or brute force over a whole small table."""

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from kinetide.llm import queries
from kinetide.llm.common import keyed_crc

SF = "/root/testdata/sf0.001"

TABLES = "documents embeddings labels conversations".split()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(queries.SQL[name])
    cols = [d[0] for d in rel.description]
    want = sorted(map(repr, [tuple(sorted(zip(cols, r, strict=True))) for r in rel.fetchall()]))
    df = queries.QUERIES[name](spark, SF)
    assert sorted(map(repr, [tuple(sorted(zip(df.columns, r, strict=True))) for r in df.collect()])) == want and want


def test_one_query_per_operator():
    assert [sum(n.startswith(f"op{i}_") for n in queries.QUERIES) for i in range(1, 14)] == [1] * 13


def test_neighbours_recall(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    ids, m = np.array(t["vec_id"]), np.array([np.array(v, dtype=float) for v in t["embedding"]])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = {}
    for i in np.nonzero(ids % 50 == 0)[0]:
        s = m @ m[i]
        s[i] = -2
        near[int(ids[i])] = set(ids[np.argsort(-s, kind="stable")[:5]].tolist())
    got = queries.QUERIES["op3_multi_index"](spark, SF).collect()
    assert len(got) == 5 * len(near)
    assert sum(r.vec_id in near[r.query_id] for r in got) >= 0.9 * len(got)


def test_held_out_toxicity(spark):
    docs = queries.QUERIES["op6_toxicity"](spark, SF.replace("sf0.001", "sf0.1")).join(spark.read.parquet(SF.replace("sf0.001", "sf0.1") + "/labels.parquet"), "doc_id").where(keyed_crc("doc_id") % 3 == 1).toPandas()
    assert docs["held_out"].all()
    toxic = docs["toxic"] == 1
    assert docs["predicted"][toxic].mean() > 0.9 and docs["predicted"][~toxic].mean() < 0.02


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns, name
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        counts.append(docs.count())
    assert counts[1] > 0.7 * counts[0] and counts[2] <= counts[1] and counts[3] == counts[2] and counts[4] < counts[3]
    assert p.run(spark, SF).count() == counts[5]
