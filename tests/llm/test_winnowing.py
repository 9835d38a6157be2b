"""Fingerprints against a direct definition of winnowing, and the order of documents against sorted lists."""

import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetide.llm import queries, winnowing
from kinetide.llm.winnowing import K, WINDOW, gram_hashes, likeness, matches, packed, winnow

SCHEMA = "doc_id long, text string"


def by_definition(text, k, window):
    """Least hash of each window, rightmost of equal ones, from the runs' hashes one by one."""
    if not text:
        return [], []
    points = [ord(c) for c in text]
    k = min(k, len(points))
    one = {tuple(points[i : i + k]): int(gram_hashes(np.array(points[i : i + k]), k)[0]) for i in range(len(points) - k + 1)}
    hashes = [one[tuple(points[i : i + k])] for i in range(len(points) - k + 1)]
    window, kept = min(window, len(hashes)), []
    for i in range(len(hashes) - window + 1):
        least = min(hashes[i : i + window])
        at = max(j for j in range(i, i + window) if hashes[j] == least)
        if at not in kept:
            kept.append(at)
    return [hashes[i] for i in kept], kept


@pytest.mark.parametrize(("k", "window"), [(1, 1), (3, 4), (5, 7), (16, 32), (13, 9)])
def test_winnowing_is_the_definition(words, k, window):
    texts = ["", "a", "ab" * 40, "a" * 200, "é日𝔘" * 30, " ".join(words(60, 3)), "x" * (k + window - 1), " ".join(words(20, 4))[: k + 1]]
    for text in texts:
        got = winnow(text, k, window)
        assert (got[0].tolist(), got[1].tolist()) == by_definition(text, k, window)
        assert all(b - a <= window for a, b in zip(got[1].tolist(), got[1].tolist()[1:], strict=False))
        raw = np.frombuffer(packed(got), np.dtype([("hash", "<u8"), ("gap", "u1")]))
        assert raw["hash"].tolist() == got[0].tolist() and np.cumsum(raw["gap"].astype(int)).tolist() == got[1].tolist()


def test_shared_passages_are_found(words):
    r = random.Random(3)
    for i in range(60):
        passage = " ".join(words(30, i))[: K + WINDOW - 1]
        a, b = (" ".join(words(r.randint(0, 80), 100 * i + j)) for j in range(2))
        left, right = winnow(a + passage + "."), winnow(b + passage + "!")
        assert any(q - p == len(b) - len(a) and len(a) <= p < len(a) + len(passage) for p, q in matches(left, right))


def expected(rows):
    """{row: (edited, near_edited, near_next)} from a sorted list."""
    key = lambda d: (d is not None, d or 0)
    least = {}
    for doc, text in rows:
        least[doc] = min(least.get(doc, text or ""), text or "", key=lambda t: t.encode())
    order = sorted(least, key=key)
    out = []
    for doc, text in rows:
        text, nxt = text or "", least[order[order.index(doc) - 1]]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + nxt[:cut]
        own = winnow(text)[0]
        out.append((doc, len(text), edited, likeness(own, winnow(edited)[0]), likeness(own, winnow(nxt)[0])))
    return sorted(map(repr, out))


def test_next_document(spark, words):
    r = random.Random(5)
    rows = [(r.randint(-50, 10**12), " ".join(words(r.randint(0, 60), i))) for i in range(400)]
    rows += [(7, f"hot {i % 9} " + " ".join(words(9, i % 5))) for i in range(300)]  # one id with a third of all rows
    rows += [(None, f"no id {i % 4}") for i in range(200)] + [(3, None), (4, ""), (5, "x" * 30_000), ((1 << 63) - 1, "the last é𝔘"), (-(1 << 63), "the first")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = winnowing.with_next(df)
    assert sorted(repr((x.doc_id, x.n_chars, x.edited, x.near_edited, x.near_next)) for x in got.collect()) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, "alone in the table")], [(None, "no id")], [(1, None), (1, None)], [(2, "abc def ghi"), (1, "xyz")]])
def test_small_tables(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("range", F.lit(1)).withColumn("own", F.lit(0)).withColumn("lead", F.lit("x"))
    got = winnowing.with_next(df).collect()
    assert sorted(repr((x.doc_id, x.n_chars, x.edited, x.near_edited, x.near_next)) for x in got) == expected(rows)
    assert sorted(x.n_chars for x in winnowing.fingerprints(df).collect()) == sorted(len(t or "") for _, t in rows)


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op11_winnowing"](spark, sf).collect()
    want = {}
    order = sorted(rows)
    for (doc, text), (_, nxt) in zip(order, [order[-1], *order], strict=False):
        cut = len(text) // 3
        want[doc] = (len(text), hashlib.sha256((text[: len(text) - cut] + nxt[:cut]).encode()).hexdigest(), base64.b64encode(packed(winnow(text))).decode())
    assert {r.doc_id: (r.n_chars, r.edited_sha256, "".join(r.fingerprint.split())) for r in got} == want
    assert np.mean([r.near_edited for r in got]) > 0.35 and np.mean([r.near_next for r in got]) < 0.1
