"""Alignment of two tokenizers' tokens of the same bytes, and how common each linked pair of ids is."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import ByteBpe, _byte_letters
from .common import fresh_path, held, pieces, staged, texts
from .sentencepiece import raw_pieces

#: Pairs in the broadcast table of the commonest ones; the others are joined.
COMMON = 1 << 17


def common_ends(a: np.ndarray, b: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Places in ``a`` whose end is one of ``b`` too; both hold rising byte ends.

    ``starts`` and ``stops`` give the intervals to cut, as ranges of ``a`` whose last end is common: whole texts at
    first.  In each, a common end near the middle is sought by bisection: from the middle outwards the ends of
    ``a`` are looked up in ``b``.  Both halves are cut again; an interval in which none is found is a leaf.  All
    intervals of a level take each step together, so a batch of texts needs a few steps per level of halving.
    """
    found = [stops - 1]
    low, high = starts, stops - 1  # candidates are the ends before the last one
    while len(low):
        middle = (low + high) // 2
        cut = np.full(len(low), -1)
        open_, step = np.flatnonzero(high > low), 0
        while len(open_):
            for at in (middle[open_] + step, middle[open_] - step) if step else (middle[open_],):
                inside = (at >= low[open_]) & (at < high[open_])
                ends = a[at[inside]]
                same = np.zeros(len(open_), bool)
                same[inside] = b[np.minimum(np.searchsorted(b, ends), len(b) - 1)] == ends
                cut[open_[same]] = at[same]
            step += 1
            open_ = open_[(cut[open_] < 0) & ((middle[open_] + step < high[open_]) | (middle[open_] - step >= low[open_]))]
        split = np.flatnonzero(cut >= 0)
        found.append(cut[split])
        low, high = np.concatenate([low[split], cut[split] + 1]), np.concatenate([cut[split], high[split]])
        some = high > low
        low, high = low[some], high[some]
    return np.sort(np.concatenate(found))


class Tokens:
    """Ids, byte ranges and spellings of one side for a batch of texts, end to end."""

    def __init__(self, ids: list[list[int] | np.ndarray], raw: np.ndarray, size: np.ndarray):
        self.counts = np.array([len(x) for x in ids], np.int64)
        self.ids = np.concatenate([np.asarray(x, np.int64) for x in ids]) if len(ids) else np.empty(0, np.int64)
        self.raw, self.size = raw, size

    def spelled(self) -> list[bytes]:
        """The joined bytes of each text's tokens."""
        parts, at, out = self.raw[self.ids].tolist(), 0, []
        for n in self.counts.tolist():
            out.append(b"".join(parts[at : at + n]))
            at += n
        return out


def _written(ids: range, end: str) -> np.ndarray:
    return np.array([f"{i}{end}".encode() for i in ids], dtype=object)


class Pair:
    """Both tokenizers with the bytes and decimal forms of their ids."""

    def __init__(self, byte_bpe: str, model: str):
        from sentencepiece import SentencePieceProcessor

        self.bpe, self.model = ByteBpe(byte_bpe, cache=0), SentencePieceProcessor(model_file=model)
        tokens = raw_tokens(byte_bpe)
        of = [[tokens.get(i, b"") for i in range(max(tokens) + 1)], raw_pieces(self.model)]
        self.n_b = len(of[1])
        self.raw = [np.array(x, dtype=object) for x in of]
        self.size = [np.array([len(t) for t in x], np.int64) for x in of]
        self.inner = [_written(range(len(x)), ",") for x in of]
        self.last = [_written(range(len(of[0])), "|"), _written(range(len(of[1])), ";")]

    @classmethod
    def load(cls, byte_bpe: str, model: str) -> Pair:
        return held(("pair", byte_bpe, model), lambda: cls(byte_bpe, model))

    def encoded(self, batch: list[str]) -> tuple[list[int], list[np.ndarray], list[list[int]]]:
        """(places of the texts with tokens, their ids on both sides)."""
        some = [i for i, t in enumerate(batch) if t]
        a = [np.frombuffer(self.bpe.encode(" " + batch[i]), "<u4") for i in some]
        b = self.model.encode([batch[i] for i in some], num_threads=1) if some else []
        whole = [(" " + batch[i]).encode() for i in some]
        spelled = [Tokens(ids, raw, size).spelled() for ids, raw, size in zip((a, b), self.raw, self.size, strict=True)]
        fine = [k for k in range(len(some)) if spelled[0][k] == whole[k] == spelled[1][k]]
        return [some[k] for k in fine], [a[k] for k in fine], [b[k] for k in fine]

    def align(self, batch: list[str]) -> list[tuple[int, int, int, bytes, np.ndarray] | None]:
        """(n_a, n_b, n_groups, groups, codes) of each text, None without tokens.

        ``codes`` has a * n_b + b of each link: between neighbouring ends of either side lies one piece of one
        token of each, so links are the distinct ends.
        """
        out: list[tuple[int, int, int, bytes, np.ndarray] | None] = [None] * len(batch)
        places, *ids = self.encoded(batch)
        if not places:
            return out
        a, b = (Tokens(x, raw, size) for x, raw, size in zip(ids, self.raw, self.size, strict=True))
        ends = [np.cumsum(t.size[t.ids]) for t in (a, b)]
        last = [np.cumsum(t.counts) for t in (a, b)]
        cuts_a = common_ends(ends[0], ends[1], last[0] - a.counts, last[0])
        cuts_b = np.searchsorted(ends[1], ends[0][cuts_a])
        # Decimal forms in the order of groups, A before B.
        group = [np.repeat(np.arange(len(c)), np.diff(c, prepend=-1)) for c in (cuts_a, cuts_b)]
        done_a, done_b = np.concatenate([[0], cuts_a + 1]), np.concatenate([[0], cuts_b + 1])
        written = np.empty(len(a.ids) + len(b.ids), dtype=object)
        for t, g, c, own, other, inner, final in ((a, group[0], cuts_a, done_a, done_b[:-1], self.inner[0], self.last[0]), (b, group[1], cuts_b, done_b, done_a[1:], self.inner[1], self.last[1])):
            words = inner[t.ids]
            words[c] = final[t.ids[c]]
            written[np.arange(len(t.ids)) + other[g]] = words
        written = written.tolist()
        # Links of the whole batch, then of each text.
        is_end = np.zeros((2, int(ends[0][-1]) + 1), bool)
        is_end[0, ends[0]] = is_end[1, ends[1]] = True
        all_ends = np.flatnonzero(is_end[0] | is_end[1])
        token = [np.cumsum(x, dtype=np.int64)[all_ends] - x[all_ends] for x in is_end]
        codes = (a.ids[token[0]] * self.n_b + b.ids[token[1]]).astype(np.uint64)
        text_ends = ends[0][last[0] - 1]
        links = np.searchsorted(all_ends, text_ends, side="right")
        groups = np.searchsorted(ends[0][cuts_a], text_ends, side="right")
        w = l = g = 0
        for k, place in enumerate(places):
            n_a, n_b = int(a.counts[k]), int(b.counts[k])
            out[place] = (n_a, n_b, int(groups[k]) - g, b"".join(written[w : w + n_a + n_b])[:-1], codes[l : links[k]])
            w, l, g = w + n_a + n_b, int(links[k]), int(groups[k])
        return out


def raw_tokens(byte_bpe: str) -> dict[int, bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    letters = _byte_letters()
    with open(byte_bpe, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    return {i: bytes(letters[c] for c in token) for token, i in vocab.items() if all(c in letters for c in token)}


_ALIGNED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
    ("codes", pa.binary()), ("times", pa.binary())])


def shuffled_bytes(x: np.ndarray) -> bytes:
    """All lowest bytes first, then all second ones and so on: the high bytes of small numbers compress to nothing."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def restored(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def distinct_codes(codes: bytes, times: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(restored(codes, np.uint64), dtype=np.uint64), restored(times, np.uint32)


def aligned(docs: DataFrame, byte_bpe: str, model: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, codes, times) of every whole text.

    A is the byte-level BPE of a blank and the text, B the pieces of the text (the model adds that blank); strings
    of special tokens are ordinary text.  ``codes`` are the distinct linked pairs as rising differences, ``times``
    how often the text has each.  ``row`` tells rows apart whatever their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, row = Pair.load(byte_bpe, model), TaskContext.get().partitionId() << 36
        for batch in pieces(batches, 256):
            out = []
            for doc, got in zip(batch.column("doc_id").to_pylist(), pair.align(batch.column("text").to_pylist()), strict=True):
                if got is None:
                    out.append((row, doc, 0, 0, 0, 0, "", b"", b""))
                else:
                    n_a, n_b, n_groups, groups, links = got
                    codes, times = np.unique(links, return_counts=True)
                    out.append((row, doc, n_a, n_b, n_groups, len(links), hashlib.sha256(groups).hexdigest(), shuffled_bytes(np.diff(codes, prepend=np.uint64(0))), shuffled_bytes(times.astype(np.uint32))))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _ALIGNED, strict=True)], schema=_ALIGNED)

    kinds = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"
    return texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, kinds)


def pair_counts(found: DataFrame) -> DataFrame:
    """(code, n): how many rows of ``aligned`` hold each pair; partitions add up their rows first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        total = (np.empty(0, np.uint64), np.empty(0, np.int64))

        def added() -> tuple[np.ndarray, np.ndarray]:
            codes, n = np.unique(np.concatenate(waiting) if waiting else np.empty(0, np.uint64), return_counts=True)
            both, place = np.unique(np.concatenate([total[0], codes]), return_inverse=True)
            return both, np.bincount(place, np.concatenate([total[1], n]), len(both)).astype(np.int64)

        for batch in pieces(batches):
            for codes, times in zip(batch.column("codes").to_pylist(), batch.column("times").to_pylist(), strict=True):
                if codes:
                    waiting.append(distinct_codes(codes, times)[0])
                    size += len(waiting[-1])
            if size > 1 << 21:
                total, waiting, size = added(), [], 0
            if len(total[0]) > 1 << 21:
                yield pa.RecordBatch.from_pydict({"code": pa.array(total[0].view(np.int64)), "n": pa.array(total[1])})
                total = (total[0][:0], total[1][:0])
        codes, n = added()
        for i in range(0, len(codes), 1 << 16):
            yield pa.RecordBatch.from_pydict({"code": pa.array(codes[i : i + (1 << 16)].view(np.int64)), "n": pa.array(n[i : i + (1 << 16)])})

    return found.select("codes", "times").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, byte_bpe: str, model: str, common: int = COMMON) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    Links are all overlapping token occurrences of both sides; the count of an id pair is the number of rows
    that hold it linked.  ``n_best`` counts the links whose pair no other pair of the A id beats; ``count_sum`` adds
    the counts over all links.

    At most ``common`` pairs, the commonest, are broadcast and looked up; the links of the others are joined with
    their counts.  So what is joined has no pair that many rows hold, and nothing is left out.

    Null and empty texts, and those that either side doesn't spell byte by byte, have zeros and the empty string.
    Repeated rows each count; null ids stay.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    path = fresh_path(spark, "aligned")
    aligned(docs, byte_bpe, model).write.option("compression", "zstd").parquet(path)
    found = spark.read.parquet(path)
    counts = staged(pair_counts(found), "pair-counts")
    n_b = Pair.load(byte_bpe, model).n_b
    code_a = F.expr(f"code div {n_b}")
    best = counts.groupBy(code_a.alias("a")).agg(F.max("n").alias("most"))
    facts = counts.withColumn("a", code_a).join(best, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))
    facts = staged(facts, "pair-facts")
    # Sizes by eighths of a power of two, at most some 500 rows: the least count that at most ``common`` pairs reach.
    level = F.floor(F.log2("n") * 8).cast("int")
    least, so_far = 0.0, 0
    for r in facts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs"), F.min("n").alias("low")).orderBy(F.desc("level")).collect():
        so_far += r.pairs
        if so_far > common:
            break
        least = r.low
    top = facts.where(F.col("n") >= least).toPandas().sort_values("code") if least else facts.limit(0).toPandas()
    table = spark.sparkContext.broadcast((top["code"].to_numpy(np.uint64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)))

    def known(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table, whether it is there)."""
        place = np.searchsorted(table.value[0], codes)
        place[place == len(table.value[0])] = 0
        return place, (table.value[0][place] == codes if len(table.value[0]) else np.zeros(len(codes), bool))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for codes, times in zip(batch.column("codes").to_pylist(), batch.column("times").to_pylist(), strict=True):
                codes, times = distinct_codes(codes, times)
                place, there = known(codes)
                place, times = place[there], times[there].astype(np.int64)
                sums.append((int(times[table.value[2][place]].sum()), int((times * table.value[1][place]).sum()), int((~there).sum())))
            best, total, open_ = zip(*sums, strict=True) if sums else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(best, pa.int64()), pa.array(total, pa.int64()), pa.array(open_, pa.int64())], names=[*batch.schema.names[:-2], "best", "total", "open"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, code, many = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
            for row, codes, times in zip(*[batch.column(c).to_pylist() for c in ("row", "codes", "times")], strict=True):
                codes, times = distinct_codes(codes, times)
                rest = ~known(codes)[1]
                rows.append(np.full(int(rest.sum()), row))
                code.append(codes[rest])
                many.append(times[rest].astype(np.int64))
            yield pa.RecordBatch.from_pydict({"row": pa.array(np.concatenate(rows)), "code": pa.array(np.concatenate(code).view(np.int64)), "times": pa.array(np.concatenate(many))})

    plain = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, best long, total long, open long"
    done = found.mapInArrow(lambda batches: looked_up(pieces(batches)), plain)
    rest = found.select("row", "codes", "times").mapInArrow(lambda batches: others(pieces(batches)), "row long, code long, times long")
    rest = rest.join(facts.where(F.col("n") < least) if least else facts, "code")
    rest = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times"))).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    out = done.join(rest, "row", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("total") + F.coalesce("more", zero)).alias("count_sum"), "groups_sha256")
