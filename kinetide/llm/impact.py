"""Exact top-k by integer inner product with an impact-ordered, score-at-a-time index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .vectors import of_common_width, usable

SHARD, QUERIES = 8192, 1024
#: The share of each posting list's entries that stand below a segment's lower edge.
SEGMENTS = (0.5, 0.1, 0.0)


class Impacts:
    """Posting lists of a shard, cut into segments of falling impact.

    Component d of the rows has two lists: v - min for queries with a positive weight there, max - v for
    those with a negative one.  Both are non-negative, so a row's score only grows while segments are
    processed.  A segment holds the entries of a list between two edges; all lists give their top segment
    first.
    """

    def __init__(self, values: np.ndarray, kind: type):
        self.low, self.high = values.min(axis=0), values.max(axis=0)
        self.lists = np.concatenate([values - self.low, self.high - values], axis=1)
        edges = [np.ceil(np.quantile(self.lists, s, axis=0)).astype(np.int64) if s else np.zeros(self.lists.shape[1], np.int64) for s in SEGMENTS]
        self.kind, self.edges = kind, [np.maximum(e, 0) for e in edges]

    def segments(self):  # noqa: ANN201
        """For each step: the entries of its segment, and the most that each open entry can still add."""
        above = np.full(self.lists.shape[1], np.iinfo(np.int64).max)
        for edge in self.edges:
            now = (self.lists >= edge) & (self.lists < above)
            rest = np.where(self.lists < edge, np.maximum(edge - 1, 0), 0)
            yield np.where(now, self.lists, 0).astype(self.kind), rest.astype(self.kind)
            above = edge


def top(ids: np.ndarray, values: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, id, score) of each query's ``k`` best rows, ties to the smaller id, its own id left out.

    After each segment a row's score lies between what it has gathered and that plus what its open
    entries can add.  A query stops once the rows whose upper bound reaches the k-th best lower bound are
    few; they are a proven superset of its best rows, and are scored exactly.
    """
    most = int(np.abs(values).max(initial=0)) * int(np.abs(queries).sum(axis=1).max(initial=0)) * 2
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    index = Impacts(values, kind)
    weights = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], axis=1).astype(kind)
    gathered = np.zeros((len(queries), len(values)), dtype=kind)
    own = np.full(len(queries), -1)
    at = {int(v): i for i, v in enumerate(ids)} if len(set(ids.tolist())) == len(ids) else None
    if at is not None:
        own = np.array([at.get(int(q), -1) for q in query_ids])
    left, out = np.arange(len(queries)), []
    few, steps = max(4 * k, len(values) // 16), len(SEGMENTS)
    for step, (segment, rest) in enumerate(index.segments()):
        gathered[left] += weights[left] @ segment.T
        lower = gathered[left].copy()
        if at is not None:
            mine = own[left] >= 0
            lower[np.nonzero(mine)[0], own[left][mine]] = -1
        else:
            lower[query_ids[left][:, None] == ids[None, :]] = -1
        open_ = np.ones(len(left), dtype=bool)
        kth = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] > k else np.full(len(left), -1, dtype=kind)
        upper = lower + weights[left] @ rest.T if step < steps - 1 else lower
        for i, q in enumerate(left):
            members = np.nonzero((upper[i] >= kth[i]) & (ids != query_ids[q]))[0]
            if step < steps - 1 and len(members) > few:
                continue
            exact = values[members] @ queries[q]
            best = np.lexsort((ids[members], -exact))[:k]
            out += [(int(query_ids[q]), int(ids[members[j]]), int(exact[j])) for j in best]
            open_[i] = False
        left = left[open_]
        if not len(left):
            break
    return out


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the exact ``k`` largest inner products of floor(scale * x) components.

    Rows are dealt by a hash of their id into shards of about SHARD rows, queries into blocks of about
    QUERIES; each shard's index answers each block, and the best of the shards are ranked per query.  Both
    sizes are fixed, so a group holds the same number of rows at any table size, and equal vectors, however
    many, are dealt like others.  The queries against all rows are the stated task, so rows travel once per
    block of queries.

    A row is no candidate for the query of its own id; rows with one id are candidates of their own.
    Vectors that are null, of another length than most, or with null or non-finite components take no part;
    nor do null ids.  Ties go to the smaller id.  With fewer than ``k`` candidates all are returned.
    """
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))

    def clean(df: DataFrame) -> DataFrame:
        return df.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), whole.alias("v"))

    rows, width = of_common_width(clean(vectors), "v")
    rows = staged(rows, "impact-rows")
    asked = staged(clean(queries).where(F.size("v") == width), "impact-queries")
    shards, blocks = max(1, -(-rows.count() // SHARD)), max(1, -(-asked.count() // QUERIES))
    entries = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), "id", "v")
    sent = asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).alias("block"), "id", "v")

    def answer(entry: pd.DataFrame, query: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(entry) and len(query):
            values, asked = (np.stack(x["v"].to_numpy()).astype(np.int64) for x in (entry, query))
            out = top(entry["id"].to_numpy(), values, query["id"].to_numpy(), asked, k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    best = entries.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInPandas(answer, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
