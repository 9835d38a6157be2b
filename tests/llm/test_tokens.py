"""Encoding and packing against the public libraries."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from kinetide.llm import packing, sentencepiece
from kinetide.llm.byte_bpe import ByteBpe

MODEL, BPE = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  a   b \n c  ", "x", "a <s> b▁c ▁▁ d <|endoftext|>", "it's  \t x　y \x1cz é ok ", " \n\n a", "日本 語  テ ℌℌ", "aaaaaaaaaaaaaaaaaaaa bbbbb the thethethe         x", None, "same", "same"]


def test_pieces_are_the_librarys(spark, make, words):
    texts = ODD + [" ".join(words(120, i)) for i in range(40)] + ["".join(words(4000, 5))]
    got = sentencepiece.decode(sentencepiece.encode(make(list(enumerate(texts))), MODEL), MODEL).collect()
    sp = SentencePieceProcessor(model_file=MODEL)
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        ids = sp.encode(text)
        assert r.ids == ids and r.decoded == sp.decode(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<i4").tobytes())


def unigram_model(path, words, byte_fallback):
    """A model file written by hand: parts of words with made-up log-probabilities; nothing is trained."""

    def number(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    def field(n, value):
        return number(n << 3 | 2) + number(len(value)) + value if isinstance(value, bytes) else number(n << 3) + number(value)

    def piece(text, score, kind=1):
        return field(1, field(1, text.encode()) + number(2 << 3 | 5) + struct.pack("<f", score) + field(3, kind))

    r = random.Random(1)
    parts = sorted({w[i : i + r.randint(1, 5)] for w in words for i in range(len(w))} | {"▁" + w[: r.randint(0, 3)] for w in words} | set("abenrt.é") | {"▁"})
    made = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3)
    if byte_fallback:
        made += b"".join(piece(f"<0x{i:02X}>", 0, 6) for i in range(256))
    made += b"".join(piece(p, -r.choice([1.5, 2.0, 3.0, 4.5]) * len(p) ** 0.7 - r.random()) for p in parts)
    trainer = field(3, 1) + (field(35, 1) if byte_fallback else b"")
    normalizer = field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1)
    path.write_bytes(made + field(2, trainer) + field(3, normalizer))
    return str(path)


@pytest.mark.parametrize("byte_fallback", [True, False])
def test_unigram_pieces_are_the_librarys(spark, make, words, tmp_path, byte_fallback):
    path = unigram_model(tmp_path / "unigram.model", words(300, 8), byte_fallback)
    texts = ODD + [" ".join(words(60, i)) for i in range(40)] + ["".join(words(300, 5)), "zq zzz qzq 日本語"]
    got = sentencepiece.decode(sentencepiece.encode(make(list(enumerate(texts))), path), path).collect()
    sp = SentencePieceProcessor(model_file=path)
    assert len(got) == len(texts) and sum(len(r.ids) for r in got) > 5000
    for r in got:
        text = texts[r.doc_id] or ""
        assert r.ids == sp.encode(text), text
        if byte_fallback:
            assert r.decoded == sp.decode(r.ids)


def test_decoding_any_ids(spark):
    sp = SentencePieceProcessor(model_file=MODEL)
    r = random.Random(2)
    lists = [[], [1, 2], [29871], [29871, 29871]] + [[r.randint(3, sp.get_piece_size() - 1) for _ in range(20)] for _ in range(60)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate([*lists, None])], "doc_id long, ids array<int>")
    raw = sentencepiece.raw_pieces(sp)
    for row in sentencepiece.decode(df, MODEL).collect():
        want = None if row.ids is None else b"".join(raw[i] for i in row.ids).decode("utf-8", "replace")
        assert row.decoded == (want[1:] if want and want[0] == " " else want)


def test_extra_columns_and_empty_table(spark, make):
    docs = make(["one two"]).withColumn("ids", F.lit("mine")).withColumn("part", F.lit(1))
    assert sentencepiece.encode(docs, MODEL).count() == 1
    assert packing.pack(docs, BPE).first().doc_tokens == 3
    empty = make([])
    assert sentencepiece.decode(sentencepiece.encode(empty, MODEL), MODEL).count() == 0
    assert packing.pack(empty, BPE).count() == 0


def reference(text):
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    return t.encode(text, add_special_tokens=False).ids


def test_byte_bpe_is_the_tokenizers(words):
    enc = ByteBpe(BPE, cache=50)
    for text in [t or "" for t in ODD] + [" ".join(words(300, i)) for i in range(5)]:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == reference(text)


def test_strings_of_added_tokens_are_the_tokenizers(spark, make, words, tmp_path):
    from kinetide.llm import queries

    t, end = Tokenizer.from_file(BPE), "<|endoftext|>"
    texts = [x or "" for x in ODD] + [end, end * 2, f"a {end} b", f" {end}  b", f"a\n\n{end}\n c", f"<|endoftext|{end}>", f"{' '.join(words(50, 1))}{end}{' '.join(words(50, 2))} "]
    assert t.encode(f"a {end} b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    enc = ByteBpe(BPE, cache=50, special=True)
    for text in texts:
        assert np.frombuffer(enc.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, text
    make(list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_packing(spark, str(tmp_path)).select("doc_id", "doc_tokens").distinct().collect()
    assert {r.doc_id: r.doc_tokens for r in got} == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in enumerate(texts)}


@pytest.mark.parametrize("length", [8, 2048])
def test_pieces_tile_documents_and_sequences(spark, make, words, length):
    texts = ODD + [" ".join(words(n, n)) for n in (1, 7, 8, 9, 900, 5000)]
    rows = packing.pack(make(list(enumerate(texts))), BPE, length).collect()
    ids = {i: reference(t or "") + [1] for i, t in enumerate(texts)}
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids == part and r.ids_crc32 == zlib.crc32(part)
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc.keys() == ids.keys()
    for doc, parts in by_doc.items():
        at = 0
        for start, n in sorted(parts):
            assert start == at
            at += n
        assert at == len(ids[doc])
    sizes = []
    for s in sorted(by_sequence):
        at = 0
        for offset, n in sorted(by_sequence[s]):
            assert offset == at
            at += n
        sizes.append(at)
    assert sorted(by_sequence) == list(range(len(sizes))) and all(n == length for n in sizes[:-1]) and sizes[-1] <= length
