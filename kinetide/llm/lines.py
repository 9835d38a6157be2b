"""Removal of boilerplate lines by the number of distinct sites that carry them; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

MIN_SITES, LG_K = 10, 12


def line_key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def line_keys(text: Column) -> Column:
    """The distinct keys of a text's lines that aren't blank."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), line_key))


def site_lines(docs: DataFrame, site: str = "source") -> DataFrame:
    """(line, site, n): on how many distinct whole texts of each site a line stands.

    Copies of a whole text are one text, on the least of their sites: a page that is copied to ten sites doesn't make
    its lines boilerplate.  A text travels as its lines' keys, under two 64-bit digests, and copies combine
    before the shuffle.  A null site is one site.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"), F.coalesce(F.col(site).cast("string"), F.lit("")).alias("site"), line_keys(text).alias("lines"))
    once = rows.where(F.size("lines") > 0).groupBy("a", "b").agg(F.min("site").alias("site"), F.any_value("lines").alias("lines"))
    return once.select(F.explode("lines").alias("line"), "site").groupBy("line", "site").agg(F.count("*").alias("n"))


def sketches_of(spread: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(line, sketch) from (line, site, n): a HyperLogLog sketch of the sites of each line that stands often enough.

    A line on s sites stands on at least s texts, so a plain count first drops the many rare lines.  All
    aggregates combine before their shuffle, and lines are joined as one row per site, so a line of a third
    of all rows is a row per task or site.
    """
    often = spread.groupBy("line").agg(F.sum("n").alias("n"), F.min("site").alias("a"), F.max("site").alias("z"))
    often = often.where((F.col("n") >= min_sites) & ((F.col("a") < F.col("z")) | F.lit(min_sites <= 1))).select("line")
    return spread.join(often, "line", "left_semi").groupBy("line").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))


def sketches(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(line, sketch) of a corpus, or of a part of it that ``merged`` joins with others."""
    return sketches_of(site_lines(docs, site), min_sites, lg_k)


def merged(*tables: DataFrame) -> DataFrame:
    """Sketches of several parts of a corpus as one table; parts should be sketched with ``min_sites`` 1."""
    union = tables[0]
    for t in tables[1:]:
        union = union.unionByName(t)
    return union.groupBy("line").agg(F.hll_union_agg("sketch").alias("sketch"))


def boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """(line): hashes of the lines on at least ``min_sites`` sites.

    Estimates further than four standard errors (and one site) from the threshold decide by themselves;
    the lines between get an exact distinct count.
    """
    spread = staged(site_lines(docs, site), "site-lines")
    estimated = staged(sketches_of(spread, min_sites, lg_k).select("line", F.hll_sketch_estimate("sketch").alias("sites")), "line-sites")
    band = max(1.0, 4 * 1.04 / 2 ** (lg_k / 2) * min_sites)
    near = estimated.where(F.abs(F.col("sites") - min_sites) <= band).select("line")
    exact = spread.join(near, "line", "left_semi").groupBy("line").agg(F.count("*").alias("sites"))
    return estimated.where(F.col("sites") > min_sites + band).select("line").unionByName(exact.where(F.col("sites") >= min_sites).select("line"))


def without_boilerplate(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``docs`` with the boilerplate lines cut from ``text``, and n_lines and n_removed of each document.

    Boilerplate are lines that distinct whole texts have on at least ``min_sites`` sites.  Only a document of which
    nothing but blanks would be left stays whole, as a page of its own.
    Lines compare without blanks around them; blank lines are never boilerplate.  A null text stays null
    with no lines.  Rows with equal doc_id, null included, are each cut by their own lines.  An empty
    table gives an empty table.  Columns named n_lines and n_removed are replaced, all others stay.

    Only hashes of boilerplate lines are gathered per document, at most as many as it has lines.
    """
    found = staged(boilerplate(docs, site, min_sites, lg_k), "boilerplate")
    lines = docs.select(F.col("doc_id").alias("doc"), F.explode(F.split("text", "\n")).alias("line")).select("doc", line_key(F.col("line")).alias("line"))
    cut = lines.join(found, "line", "left_semi").groupBy("doc").agg(F.collect_set("line").alias("cut"))
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # A row travels as one struct, so that no column of it can clash with those of this plan.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    split = rows.join(cut, F.col("row.doc_id").eqNullSafe(F.col("doc")), "left").select("row", "cut", F.split("row.text", "\n").alias("lines"))
    kept = F.when(F.col("cut").isNotNull(), F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("cut"), line_key(x)))).otherwise(F.col("lines"))
    split = split.select("row", "lines", kept.alias("kept"))
    chosen = F.when(F.trim(F.array_join("kept", "")) == "", F.col("lines")).otherwise(F.col("kept"))
    split = split.select("row", "lines", chosen.alias("kept"))
    n = lambda column: F.coalesce(F.when(F.col(column).isNotNull(), F.size(column)), F.lit(0))
    return split.select(
        *[F.array_join("kept", "\n").alias("text") if c == "text" else F.col(f"row.`{c}`") for c in names],
        n("lines").cast("long").alias("n_lines"), (n("lines") - n("kept")).cast("long").alias("n_removed"))


#: The rows of the registered query: exact distinct counts.
SQL = f"""
WITH texts AS (
  SELECT coalesce(text, '') AS text, min(coalesce(source, '')) AS site FROM documents GROUP BY 1
), lines AS (
  SELECT site, trim(unnest(string_split(text, chr(10)))) AS line FROM texts
), spread AS (
  SELECT list(line) AS found FROM (SELECT line FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {MIN_SITES})
), cut AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines,
         [x FOR x IN string_split(text, chr(10)) IF NOT coalesce(list_contains(found, trim(x)), false)] AS kept
  FROM documents CROSS JOIN spread
), chosen AS (
  SELECT doc_id, lines, CASE WHEN trim(coalesce(array_to_string(kept, ''), '')) = '' THEN lines ELSE kept END AS kept FROM cut
)
SELECT doc_id, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_removed, md5(array_to_string(kept, chr(10))) AS text_md5
FROM chosen
"""
