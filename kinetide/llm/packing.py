"""Packing of documents into token sequences of one length: concatenate and cut."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe
from .common import pieces, staged, texts

_TOKENS = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("doc_id", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
_PIECES = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])
_TOKENS_SQL = "part int, before long, doc_id long, doc_tokens long, ids binary"
_PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def token_table(docs: DataFrame, tokenizer: str, end_id: int, special: bool = False) -> DataFrame:
    """First pass: a staged table of every document's ids, with the tokens before it in its partition."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = ByteBpe.load(tokenizer, special).encode, TaskContext.get().partitionId(), 0
        for batch in pieces(batches):
            ids = [encode(t) + end for t in batch.column("text").to_pylist()]
            counts = [len(x) // 4 for x in ids]
            starts = []
            for n in counts:
                starts.append(before)
                before += n
            columns = [pa.array([part] * len(ids), pa.int32()), pa.array(starts, pa.int64()), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=_TOKENS)

    return staged(texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, _TOKENS_SQL), "tokens")


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, with_ids: bool = True, special: bool = False) -> DataFrame:
    """One row per piece of a document in a sequence of ``length`` tokens.

    Documents (doc_id, text) are taken as one stream in the order of their partitions.  The first pass
    tokenises and keeps each partition's running count; the prefix sums of the partitions' totals then
    give every document its place in the stream, and the stream is cut at the multiples of ``length``.
    A document over a cut has a piece on either side, so only the last sequence is short.  The token
    table is written once; a lost executor re-reads it, and both passes see one order.

    The table of partition offsets has one row per task of the first pass, which bounds its broadcast.
    Null texts are empty and still have the end token; a null doc_id stays null; repeated rows are packed
    as often as they come; an empty table gives no rows.  ``special``: see ``ByteBpe``.
    """
    tokens = token_table(docs, tokenizer, end_id, special)
    totals = tokens.groupBy("part").agg(F.max(F.col("before") + F.col("doc_tokens")).alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    placed = tokens.join(F.broadcast(offsets), "part").select(
        (F.col("base") + F.col("before")).alias("at"), "doc_id", "doc_tokens", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: list[tuple] = []
            for at, doc, n, ids in zip(*(batch.column(c).to_pylist() for c in ("at", "doc_id", "doc_tokens", "ids")), strict=True):
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(length - offset, n - start)
                    part = ids[4 * start : 4 * (start + size)]
                    out.append((doc, start, size, zlib.crc32(part), n, sequence, offset, part if with_ids else None))
                    start += size
            columns = zip(*out, strict=True) if out else [()] * len(_PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)

    return placed.mapInArrow(cut, _PIECES_SQL)
