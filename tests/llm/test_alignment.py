"""Alignment against both libraries and overlaps computed token by token."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from kinetide.llm import alignment, queries
from kinetide.llm.alignment import common_ends, raw_tokens

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  a   b \n c  ", "x", "a <s> b ▁▁ d", "a <s> </s> <unk> <0x41> d <|endoftext|>", "it's  \t x　y \x1cz é ok ", " \n\n a", "日本 語  テ ℌℌ", "aaaaaaaaaaaaaaaaaaaa bbbbb the thethethe         x", "same", "same", "a\n b\t c\r\n  d", "q" * 300, "nul\x00 byte 𝔘 🙂🙂", "ﬁ Ⅻ ½"]


@pytest.mark.parametrize("seed", range(60))
def test_cuts_are_all_common_ends(seed):
    """Several texts end to end; the last end of each is common."""
    r, a, b, starts, stops, at = random.Random(seed), [], [], [], [], 0
    for _ in range(r.randint(1, 6)):
        n = r.randint(1, 200)
        starts.append(len(a))
        for side in (a, b):
            side += sorted({at + n, *(at + x for x in r.sample(range(1, n + 1), r.randint(0, n // r.choice([1, 1, 10]))))})
        stops.append(len(a))
        at += n
    got = common_ends(*map(np.array, (a, b, starts, stops)))
    assert got.tolist() == [i for i, x in enumerate(a) if x in set(b)]


def libraries():
    t, sp, raw = Tokenizer.from_file(BPE), SentencePieceProcessor(model_file=MODEL), raw_tokens(BPE)
    t.encode_special_tokens = True

    def of(text):
        """(ids, byte ranges) of both sides, None where there are no tokens."""
        if not text:
            return None
        a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        whole = (" " + text).encode()
        parts = [raw[i] for i in a], [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if any(b"".join(p) != whole for p in parts):
            return None
        out = []
        for ids, p in zip((a, b), parts, strict=True):
            at, spans = 0, []
            for x in p:
                spans.append((at, at + len(x)))
                at += len(x)
            out.append((ids, spans))
        return out

    return of


def by_brute_force(texts):
    of = libraries()
    rows, holds = [], Counter()
    for text in texts:
        got = of(text)
        if got is None:
            rows.append(None)
            continue
        (a, sa), (b, sb) = got
        owner = [[i for i, (s, e) in enumerate(spans) for _ in range(s, e)] for spans in (sa, sb)]  # of each byte
        links = [(a[i], b[j]) for i, j in set(zip(*owner, strict=True))]
        cuts = sorted({e for _, e in sa} & {e for _, e in sb})
        of_cut = [defaultdict(list), defaultdict(list)]
        for side, ids, spans in zip(of_cut, (a, b), (sa, sb), strict=True):
            for x, (_, e) in zip(ids, spans, strict=True):
                side[bisect_left(cuts, e)].append(str(x))
        groups = [",".join(of_cut[0][i]) + "|" + ",".join(of_cut[1][i]) for i in range(len(cuts))]
        rows.append((len(a), len(b), groups, links))
        holds.update(set(links))
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if r is None else (r[0], r[1], len(r[2]), len(r[3]), sum(holds[x] == most[x[0]] for x in r[3]), sum(holds[x] for x in r[3]), hashlib.sha256(";".join(r[2]).encode()).hexdigest())
        for r in rows]


def found(df):
    return {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in df.collect()}


@pytest.mark.parametrize("common", [0, 40, 1 << 17])
def test_against_both_libraries(spark, make, words, common):
    texts = ODD + [" ".join(words(n, n)) for n in (1, 30, 31, 32, 150)] + [" ".join(words(30, 30)).replace(" ", "  ")]
    df = make(list(enumerate(texts))).withColumn("row", F.lit("mine")).withColumn("code", F.lit(1)).withColumn("best", F.lit(None))
    assert found(alignment.align(df, BPE, MODEL, common)) == dict(enumerate(by_brute_force(texts)))


def test_empty_table_and_repeated_ids(spark, make):
    assert alignment.align(make([]), BPE, MODEL).count() == 0
    rows = alignment.align(make([(None, "one two"), (None, "one two"), (5, None)]), BPE, MODEL).collect()
    assert sorted((r.doc_id is None, r.n_a, r.count_sum) for r in rows) == [(False, 0, 0), (True, 2, 4), (True, 2, 4)]


def test_query_on_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = found(queries.QUERIES["op13_alignment"](spark, sf))
    assert got == dict(zip([i for i, _ in rows], by_brute_force([t for _, t in rows]), strict=True))
