"""Document fingerprints by winnowing, and their likeness to an edited text and to the next document."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts

#: Any passage of K + WINDOW - 1 code points that two texts share gives them a common entry.
K, WINDOW = 16, 32
#: Buckets of ids for each task of the shuffle.
BUCKETS = 8
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(points: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of all runs of ``k`` code points: polynomials modulo 2^64, each bit spread.

    Runs of k are joined from runs of powers of two, so a text costs log2(k) passes; a text shorter than
    ``k`` is one run.
    """
    x = points.astype(np.uint64) + np.uint64(1)
    k = min(k, len(x))
    n = len(x) - k + 1 if k else 0
    out, done, runs, width = np.zeros(n, np.uint64), 0, x, 1
    while done < k:
        shift = np.uint64(pow(_BASE, width, 1 << 64))
        if k & width:
            out = out * shift + runs[done : done + n]
            done += width
        if done < k:
            runs = runs[:-width] * shift + runs[width:]
            width *= 2
    out = out + np.uint64(k)
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def winnow(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions): the least hash of each window of consecutive runs, the rightmost of equal ones.

    Neighbouring windows mostly choose the same run, which is kept once.  Positions rise, the first is below
    ``window`` and no gap exceeds it.  A text of fewer runs than a window has one; an empty text has nothing.
    """
    hashes = gram_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), k)
    window = min(window, len(hashes))
    best, width = np.arange(len(hashes)), 1
    while width < window:
        step = min(width, window - width)
        left, right = best[:-step], best[step:]
        best = np.where(hashes[right] <= hashes[left], right, left)
        width += step
    # The choice never moves back from one window to the next, so equal ones stand together.
    kept = best[np.concatenate([[True], best[1:] != best[:-1]])] if len(best) else best
    return hashes[kept], kept


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of the hashes of two fingerprints; two empty ones are equal."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def matches(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """(position in a, position in b) of every common entry; whoever needs the passage extends it from there."""
    order = np.argsort(b[0], kind="stable")
    low, high = (np.searchsorted(b[0][order], a[0], side=side) for side in ("left", "right"))
    return [(int(p), int(q)) for p, i, j in zip(a[1], low, high, strict=True) for q in b[1][order[i:j]]]


def packed(found: tuple[np.ndarray, np.ndarray]) -> bytes:
    """Entries of a hash (8 bytes, little-endian) and the distance from the entry before (one byte, as windows are below 256)."""
    out = np.empty(len(found[0]), np.dtype([("hash", "<u8"), ("gap", "u1")]))
    out["hash"], out["gap"] = found[0], np.diff(found[1], prepend=0)
    return out.tobytes()


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_chars, hashes array<long>, positions array<int>) of every whole text, without a shuffle.

    A null text is empty and has no entries; repeated rows and null ids stay as they are.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("hashes", pa.list_(pa.int64())), ("positions", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            whole = batch.column("text").to_pylist()
            found = [winnow(t, k, window) for t in whole]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(map(len, whole), pa.int64()), pa.array([h.view(np.int64) for h, _ in found], schema.field(2).type),
                pa.array([p.astype(np.int32) for _, p in found], schema.field(3).type)], schema=schema)

    return texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, n_chars long, hashes array<long>, positions array<int>")


def _place(column: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most the column's value: a search in two steps of about the root of them."""
    if not bounds:
        return F.lit(0)
    step = math.isqrt(len(bounds)) + 1
    values = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    at_most = lambda array: F.size(F.filter(array, lambda x: x <= column))
    coarse = at_most(values(bounds[::step]))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + at_most(F.slice(values(bounds), F.greatest((coarse - 1) * step, F.lit(0)) + 1, step)))


def in_order(docs: DataFrame) -> DataFrame:
    """(range, salt, own, doc_id, text) in buckets of rising doc_id, each led by the document that precedes it.

    Buckets lie between quantiles of the ids, several for each task, so texts are shuffled once and nobody
    sorts the whole table.  An id that holds several quantiles has its rows dealt over as many buckets, by
    the part of the input they come from.  Null is below all ids.  The leading row (own = 0) of a bucket is
    the greatest smaller id of all, with the least of its texts; before the first bucket stands the greatest
    id.  What reaches the driver is one id per bucket.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, min(BUCKETS * parts, 1 << 16, docs.count() // 64))
    quantiles = F.percentile_approx("doc_id", [i / n for i in range(n + 1)], max(10_000, 10 * n))
    facts = docs.agg(quantiles.alias("q"), F.count("*").alias("rows"), F.count("doc_id").alias("known")).first()
    repeats: dict[int, int] = {}
    for x in facts.q or []:
        repeats[x] = repeats.get(x, 0) + 1
    bounds = sorted({b for x, r in repeats.items() for b in ((x, x + 1) if r > 1 and x < (1 << 63) - 1 else (x,))})
    most = {x: r for x, r in repeats.items() if r > 1}
    nulls = math.ceil(n * (facts.rows - facts.known) / max(1, facts.rows))
    salts = spark.createDataFrame([(None, max(1, nulls)), *most.items()], "lead long, salts int")  # an id in it holds at least one n-th of all rows
    dealt = docs.join(F.broadcast(salts), F.col("doc_id").eqNullSafe(F.col("lead")), "left")
    place = F.when(F.col("doc_id").isNull(), 0).otherwise(_place(F.col("doc_id"), bounds) + 1)
    salt = F.pmod(F.spark_partition_id(), F.coalesce("salts", F.lit(1)))
    rows = dealt.select(place.alias("range"), salt.alias("salt"), F.lit(1).alias("own"), "doc_id", "text")
    tops = rows.groupBy("range").agg(F.max("doc_id").alias("top")).collect()
    tops = {r["range"]: r["top"] for r in tops}
    ordered = sorted(tops)
    salts_of = {r: max(1, nulls) if r == 0 else most.get(tops[r], 1) for r in ordered}
    leads = spark.createDataFrame(
        [(r, tops[ordered[i - 1]], s) for i, r in enumerate(ordered) for s in range(salts_of[r])], "range int, lead long, salt int")  # the first is led by the last
    is_lead = F.col("doc_id").eqNullSafe(F.col("lead"))
    least = docs.join(F.broadcast(leads.select("lead").distinct()), is_lead).groupBy("doc_id").agg(F.min("text").alias("text"))
    guests = least.join(F.broadcast(leads), is_lead).select("range", "salt", F.lit(0).alias("own"), "doc_id", "text")
    return rows.unionByName(guests).repartition(parts, "range", "salt").sortWithinPartitions("range", "salt", "own", F.col("doc_id").asc_nulls_first(), "text")


def with_next(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text, of its edited text, and the likeness to it and to the next document.

    (doc_id, n_chars, edited, fingerprint, edited_fingerprint binary, near_edited, near_next).  The next document
    is the one of the next smaller doc_id; after the smallest comes the greatest.  In the edited text the last
    floor(n_chars / 3) code points are replaced by the first as many of the next document, or all it has.

    Null and empty texts are empty and have empty fingerprints.  A null id comes after all others; rows of one
    id are one document with one successor, and each keeps its row; of several texts the least is the one that
    others are followed by.  A single document follows itself.  An empty table gives no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.string()), ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = last = None  # (doc_id, text, fingerprint) of the id before and of the current one
        for batch in pieces(batches):
            out = []
            for own, doc, text in zip(*[batch.column(c).to_pylist() for c in ("own", "doc_id", "text")], strict=True):
                found = winnow(text, k, window)
                if not own:
                    before, last = None, (doc, text, found)
                    continue
                if last[0] != doc or before is None:
                    before, last = last, (doc, text, found)
                cut = len(text) // 3
                edited = text[: len(text) - cut] + before[1][:cut]
                again = winnow(edited, k, window)
                out.append((doc, len(text), edited, packed(found), packed(again), likeness(found[0], again[0]), likeness(found[0], before[2][0])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    kinds = "doc_id long, n_chars long, edited string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
    return in_order(texts(docs, F.col("doc_id").cast("long").alias("doc_id"))).mapInArrow(run, kinds)
