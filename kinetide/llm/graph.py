"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """Every node's larger (or else smaller) neighbours, tied to the least of its neighbourhood.

    The least is an aggregate joined back by the node, not a window, so that a node with very many
    neighbours combines before the shuffle and its join can be split.
    """
    if large:
        around = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the links (u, v): the least node reachable.

    Each round is written to the shared folder; the rounds grow with the logarithm of the longest path.
    Nodes without links aren't in the result; null ends are left out; no links give no rows.
    """
    links = staged(pairs.select("u", "v").where(F.col("u") != F.col("v")).distinct(), "links")
    mark = None
    while True:
        before, links = links, staged(_stars(_stars(links, True), False), "links")
        discard(before)
        now = links.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if now == mark or not now[0]:
            break
        mark = now
    return links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
