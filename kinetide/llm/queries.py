"""Registered queries of this subpackage: each operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat, impact, jaccard, licenses, lines, multi_index, packing, quality, sentencepiece, toxicity, whitening, winnowing
from .common import keyed_crc, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str = "") -> Callable:
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


@query()
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text decoded from them, as digests."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    out = sentencepiece.decode(sentencepiece.encode(table(spark, sf_dir, "documents"), model), model)
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_ids"), "ids_crc32", F.crc32(F.col("decoded").cast("binary")).alias("text_crc32"),
        (F.col("decoded") == F.col("text")).alias("round_trip"))


@query()
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False, special=True).drop("ids")


@query()
def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return multi_index.search(vectors, vectors.where("vec_id % 50 = 0"))


@query()
def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(licenses.scan(table(spark, sf_dir, "documents")))


@query()
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(keyed_crc("doc_id") % 3 == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_hits", "n_quoted")


@query()
def op7_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return impact.search(vectors, vectors.where("vec_id % 20 = 0"))


@query()
def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


@query(lines.SQL)
def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.without_boilerplate(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(chat.SQL)
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.derived(table(spark, sf_dir, "conversations"))
    schemas = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(p).alias("param"), F.lit(t).alias("type"), F.lit(r).alias("required")) for n, p, t, r in chat.SCHEMAS])
    return chat.link(calls, results, spark.range(1).select(F.inline(schemas)))


@query()
def op11_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.with_next(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), F.base64("fingerprint").alias("fingerprint"),
        F.base64("edited_fingerprint").alias("edited_fingerprint"), "near_edited", "near_next")


@query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


@query()
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
