"""Exact Jaccard join of n-gram sets: size-banded tiles, hashed bitmaps, sorted-array intersection."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinetide.kernels.attach import having, marked, with_marks

from .common import discard, pieces, staged, texts
from .graph import components

WORDS, NUMERATOR, DENOMINATOR = 4, 85, 100
BITS, TILE, HUB = 1024, 2048, 128
#: Rows of tiles that are tested together, members up to which a tile's pairs are listed, and marks of a matrix for larger ones.
TOGETHER, LISTED, MARKS = 250_000, 256, 64_000_000
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words; a shorter text is one run.

    A-Z are lowered and words end at blanks, tabs and line ends; bytes.split() knows exactly these.
    """
    found = text.encode("utf-8", "replace").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh3_64_intdigest
    each = np.fromiter(map(digest, found), dtype=np.uint64, count=len(found))
    n = min(words, len(each))
    total = each[: len(each) - n + 1].copy()
    for i in range(1, n):
        total = total * _MULTIPLY + each[i : len(each) - n + 1 + i]
    return np.unique(mix(total + np.uint64(n)))


@cache
def bands(num: int = NUMERATOR, den: int = DENOMINATOR) -> list[int]:
    """The least size of each band; sets that can link lie in one band or in neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(out[-1] * den // num + 1)
    return out


@cache
def ranges(band: int, num: int, den: int) -> tuple[int, np.ndarray]:
    """(d, borders): the most elements in which a linked pair of the band can differ, and hash ranges.

    Each differing element spoils one range at most, so of k ranges at least k - d hold the same elements
    in both sets.  k leaves room for ranges that happen to be empty.
    """
    top, low = bands(num, den)[band + 1] - 1, bands(num, den)[band] * num / den
    most = (den - num) * 2 * top // (den + num)
    empty = (most + 1) * math.exp(-low / (most + 1))
    k = most + 1 + (max(1, math.ceil(empty + 3 * math.sqrt(empty))) if most else 0)
    return most, np.array([(i << 64) // k for i in range(1, k)], dtype=np.uint64)


def signatures(elements: np.ndarray, num: int = NUMERATOR, den: int = DENOMINATOR) -> np.ndarray:
    """Hashes of (band, range, elements in the range), for the set's own band and as guest of the next.

    Two linked sets have one in common: at least k - d ranges agree.  A set with fewer empty ranges than
    that leaves them out, since one that agrees isn't empty; any other set gives them as well.
    """
    out = []
    own = int(np.searchsorted(bands(num, den), len(elements), side="right")) - 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(elements * _MULTIPLY + np.uint64(1)), dtype=np.uint64)])
    for band in (own, own + 1):
        most, borders = ranges(band, num, den)
        ends = np.concatenate([np.zeros(1, np.int64), np.searchsorted(elements, borders), np.array([len(elements)])])
        size = np.diff(ends)
        inside = sums[ends[1:]] - sums[ends[:-1]]
        place = np.arange(len(size), dtype=np.uint64) + np.uint64((band + 1) << 42)
        found = mix(mix(inside + size.astype(np.uint64)) ^ mix(place))
        out.append(found[size > 0] if (size == 0).sum() < len(size) - most else found)
    return np.concatenate(out).view(np.int64)


def bitmap(elements: np.ndarray) -> np.ndarray:
    """BITS bits; each element sets one, so sets differ in at least as many elements as their bitmaps in bits."""
    bits = np.zeros(BITS, np.uint8)
    bits[(elements & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, num: int = NUMERATOR, den: int = DENOMINATOR) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and den * common >= num * (len(a) + len(b) - common)


_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("first", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("bits", pa.list_(pa.int64()))])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _firsts(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[list[tuple]]:
    """(doc_id, elements, first, key, stands) of each row; ``first`` is the first id in the partition with the same set."""
    seen: dict[tuple[int, int], int] = {}
    for batch in pieces(batches):
        out = []
        stands = batch.column("stands").to_pylist() if "stands" in batch.schema.names else [True] * batch.num_rows
        for doc, text, may in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), stands, strict=True):
            found = shingles(text, words)
            raw = found.tobytes()
            key = (_signed(xxhash.xxh3_64_intdigest(raw)), _signed(xxhash.xxh3_64_intdigest(raw, 1)))
            out.append((doc, found, (seen.setdefault(key, doc) if len(found) and doc is not None else doc), key, may))
        yield out


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _firsts(batches, words):
            made = [(doc, len(found), first, *key, bitmap(found).tolist() if doc == first else None) for doc, found, first, key, _ in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), _SETS, strict=True)], schema=_SETS)

    return docs.mapInArrow(run, "doc_id long, n_shingles long, first long, h1 long, h2 long, bits array<long>")


def signed(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """(sig, doc) of the first copies of each partition, once for each of a document's sets; of those that ``stands`` names, if there is such a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _firsts(batches, words):
            own, emitted = [], set()
            for doc, found, first, key, may in rows:
                if may and len(found) and doc == first and (doc, key) not in emitted:
                    emitted.add((doc, key))
                    own.append((doc, signatures(found, num, den)))
            sigs = np.concatenate([s for _, s in own]) if own else np.empty(0, np.int64)
            ids = np.repeat(np.array([d for d, _ in own], np.int64), [len(s) for _, s in own]) if own else sigs
            yield pa.RecordBatch.from_pydict({"sig": pa.array(sigs, pa.int64()), "doc": pa.array(ids, pa.int64())})

    return docs.mapInArrow(run, "sig long, doc long")


def may_link(a: str, b: str, num: int, den: int) -> Column:
    """The bound from both bitmaps: a pair that links differs in at most (den - num) / (den + num) of its elements."""
    bits = F.aggregate(F.zip_with(f"{a}.bits", f"{b}.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    sizes = F.col(f"{a}.n") + F.col(f"{b}.n")
    small, large = F.least(f"{a}.n", f"{b}.n"), F.greatest(f"{a}.n", f"{b}.n")
    return (small * den >= large * num) & (bits * (den + num) <= sizes * (den - num))


def meeting(tiles: list[np.ndarray], component: np.ndarray, listed: int = LISTED, marks: int = MARKS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs (i < j) of different components that meet in any of the tiles (sorted arrays of numbers).

    The pairs of tiles of up to ``listed`` members are listed, all tiles of one size at a time; those of larger
    ones are marked in a matrix, of as many rows at a time as ``marks`` allows.
    """
    n = len(component)
    codes, waiting, size = np.empty(0, np.int64), [], 0
    seen = np.zeros(n * n if n * n <= marks else 0, bool)

    def take(i: np.ndarray, j: np.ndarray) -> None:
        """Note pairs: as marks where all pairs have one, else as sorted numbers."""
        nonlocal codes, waiting, size
        if len(seen):
            seen[(i * n + j).ravel()] = True
            return
        apart = component[i] != component[j]
        waiting.append((i[apart] * n + j[apart]).ravel())
        size += len(waiting[-1])
        if size > max(4_000_000, len(codes)):
            codes, waiting, size = np.unique(np.concatenate([codes, *waiting])), [], 0

    by_size: dict[int, list[np.ndarray]] = {}
    for x in tiles:
        if 1 < len(x) <= listed:
            by_size.setdefault(len(x), []).append(x)
    for m, some in by_size.items():
        a, b = np.triu_indices(m, 1)
        step = max(1, 2_000_000 // len(a))
        for at in range(0, len(some), step):
            x = np.stack(some[at : at + step])
            take(x[:, a], x[:, b])
    large = [x for x in tiles if len(x) > max(1, listed)]
    height = max(1, marks // max(1, n))
    for start in range(0, n if large else 0, height):
        met = np.zeros((min(height, n - start), n), bool)
        for x in large:
            low, high = np.searchsorted(x, (start, start + height))
            met[np.ix_(x[low:high] - start, x[low:])] = True
        i, j = np.nonzero(met)
        later = i + start < j
        take(i[later] + start, j[later])
    i, j = np.divmod(np.flatnonzero(seen) if len(seen) else np.unique(np.concatenate([codes, *waiting])), max(1, n))
    apart = component[i] != component[j]
    return i[apart], j[apart]


def open_pairs(tiles: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v) of different components that share a tile and pass the bounds of sizes and bitmaps.

    ``tiles`` has (sig, u, doc, component, n): the members of tiles with several components, each with the least and the number
    of its tile's members.  Near copies share hundreds of tiles, most of them with the same least member, so tiles
    are dealt by that: a pair is met, tested and reported once for all of them, and each bitmap travels once
    per least member instead of once per tile.  A least member with very many rows has its tiles dealt over
    several groups; a tile of more than TILE members is cut into blocks, each pair of which is a group.
    """
    load = tiles.where(F.col("n") <= TILE).groupBy("u").agg(F.ceil(F.count("*") / TOGETHER).cast("long").alias("parts"))
    small = tiles.where(F.col("n") <= TILE).join(load, "u").select(
        F.lit(0).alias("kind"), F.col("u").alias("a"), F.pmod(F.xxhash64("sig"), F.col("parts")).alias("b"), "sig", "doc", "component")
    blocks = F.ceil(F.col("n") / TILE)
    large = tiles.where(F.col("n") > TILE).withColumn("i", F.pmod(F.xxhash64("doc"), blocks)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    large = large.select(F.lit(1).alias("kind"), F.col("sig").alias("a"), (F.least("i", "j") * blocks + F.greatest("i", "j")).alias("b"), "sig", "doc", "component")
    rows = small.unionByName(large)
    key = ["kind", "a", "b"]
    facts = rows.select(*key, "doc").distinct().join(nodes.select(F.col("doc_id").alias("doc"), "n", "bits"), "doc").select(*key, "doc", "n", "bits")

    def test(group: pd.DataFrame) -> pd.DataFrame:
        known = group[group["bits"].notna()].drop_duplicates("doc").sort_values("doc")
        member = group[group["bits"].isna()].sort_values("sig", kind="stable")
        docs, size = known["doc"].to_numpy(np.int64), known["n"].to_numpy(np.int64)
        out = pd.DataFrame({"u": [], "v": []}, dtype="int64")
        if len(docs) < 2:
            return out
        bits = np.stack(known["bits"].to_list()).astype(np.int64).view(np.uint64)
        component, place = np.zeros(len(docs), np.int64), np.searchsorted(docs, member["doc"].to_numpy(np.int64))
        component[place] = member["component"].to_numpy(np.int64)
        sig = member["sig"].to_numpy(np.int64)
        tiles = np.split(place, np.flatnonzero(sig[1:] != sig[:-1]) + 1)
        i, j = meeting([np.unique(t) for t in tiles], component)
        near = np.minimum(size[i], size[j]) * den >= np.maximum(size[i], size[j]) * num
        i, j = i[near], j[near]
        kept = []
        for at in range(0, len(i), 100_000):
            p, q = i[at : at + 100_000], j[at : at + 100_000]
            apart = np.bitwise_count(bits[p] ^ bits[q]).sum(axis=1, dtype=np.int64)
            kept.append(at + np.flatnonzero(apart * (den + num) <= (size[p] + size[q]) * (den - num)))
        kept = np.concatenate(kept) if kept else np.empty(0, np.int64)
        return pd.DataFrame({"u": docs[i[kept]], "v": docs[j[kept]]})

    empty = lambda df, kinds: df.select(*key, *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in kinds.items()])
    kinds = {"sig": "long", "doc": "long", "component": "long", "n": "long", "bits": "array<long>"}
    return empty(rows, kinds).unionByName(empty(facts, kinds)).groupBy(*key).applyInPandas(test, "u long, v long").distinct()


def open_tiles(shared: DataFrame, met: DataFrame, found: DataFrame) -> DataFrame:
    """(sig, doc, u, component, n): the members of the tiles in ``shared`` that hold several of the components ``found``.

    Such a tile has a member in another component than its least one.  That is told from ``met``, the distinct
    (u, doc) of all tiles, of which near copies share hundreds; only rows of open tiles travel.
    """
    of = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"{name}_in"))
    apart = met.join(of("u"), "u", "left").join(of("doc"), "doc", "left").where(F.coalesce("u_in", "u") != F.coalesce("doc_in", "doc")).select("u", "doc")
    apart = staged(apart, "jaccard-apart")
    sigs = staged(having(shared, apart).select("sig").distinct(), "jaccard-sigs")
    rows = staged(having(shared.select("sig", "doc", "u"), sigs), "jaccard-rows")
    sized = rows.join(rows.groupBy("sig").agg(F.count("*").alias("n")), "sig")
    out = sized.join(found.withColumnRenamed("node", "doc"), "doc", "left").select("sig", "doc", "u", F.coalesce("component", "doc").alias("component"), "n")
    out = staged(out, "jaccard-open")
    discard(apart, sigs, rows)
    return out


def verified(docs: DataFrame, pairs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (u, v) whose sets reach the threshold, from whole texts.

    Only texts of documents in pairs are gathered: ``marked`` leaves out nearly all others where they are read,
    the join by id the rest.  Pairs are grouped by u, in parts of about HUB, so a
    text with very many partners is sent to several tasks.
    """
    pairs = staged(pairs.select("u", "v"), "jaccard-pairs")
    ids = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()
    ids = staged(ids, "jaccard-ids")
    found = staged(having(docs, ids), "jaccard-texts")
    parts = pairs.groupBy("u").agg(F.ceil(F.count("*") / HUB).cast("long").alias("parts"))
    part = F.pmod(F.xxhash64("v"), F.col("parts"))
    members = pairs.join(parts, "u").select("u", "v", part.alias("part")).join(found.withColumnRenamed("doc_id", "v"), "v").select("u", "part", "v", "text")
    hubs = found.withColumnRenamed("doc_id", "u").join(parts, "u").select("u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("v"), "text")

    def check(group: pd.DataFrame) -> pd.DataFrame:
        own = [shingles(t, words) for t in group.loc[group["v"].isna(), "text"].unique()]
        rest = group[group["v"].notna()]
        hits = [(int(u), int(v)) for u, v, t in zip(rest["u"], rest["v"], rest["text"], strict=True) if any(linked(a, s, num, den) for s in [shingles(t, words)] for a in own)]
        return pd.DataFrame(hits, columns=["u", "v"]).astype("int64")

    out = staged(members.unionByName(hubs).groupBy("u", "part").applyInPandas(check, "u long, v long").distinct(), "jaccard-verified")
    discard(pairs, ids, found)
    return out


def join(docs: DataFrame, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """(doc_id, n_shingles, component_id): components of the links den * |a & b| >= num * |a | b|.

    1. Equal sets are one node: the first of a partition stands for its copies there, and the firsts of all
       partitions meet by two 64-bit digests of the whole set.  The least of them stands for all in what follows.
    2. Tiles: sets that link agree in one of k hash ranges of their size band (see ``ranges``), so every
       link lies inside a (band, range, content) tile.  A tile's members are paired with its least one;
       pairs that pass sizes and bitmaps are verified on whole texts, and give first components.
    3. In tiles that still hold several components, all pairs between components are tested by bitmaps (see
       ``open_pairs``), and survivors are verified, so no link is lost.  Pairs inside a component need no test, as
       they can't change it.

    Texts without words have no shingles and no links.  A null text is empty.  Rows of one doc_id count as
    one document with the links of all; rows with a null doc_id link with nothing and have a null
    component.  An empty table gives no rows.
    """
    docs = texts(docs, F.col("doc_id").cast("long").alias("doc_id"))
    sets = staged(sets_of(docs, words), "jaccard-sets")
    known = docs.where(F.col("doc_id").isNotNull())
    nodes = sets.where(F.col("doc_id").isNotNull() & (F.col("doc_id") == F.col("first")) & (F.col("n_shingles") > 0)).select(
        "doc_id", F.col("n_shingles").alias("n"), "h1", "h2", "bits").dropDuplicates(["doc_id", "h1", "h2"])
    nodes = staged(nodes, "jaccard-nodes")
    least = staged(nodes.groupBy("h1", "h2").agg(F.min("doc_id").alias("u")), "jaccard-least")
    equal = nodes.select("h1", "h2", F.col("doc_id").alias("v")).join(least, ["h1", "h2"]).where(F.col("u") < F.col("v")).select("u", "v")
    equal = staged(equal, "jaccard-equal")

    tile = Window.partitionBy("sig")
    # Copies would share all their tiles: only ids that stand for a set, and the few that are marked with them, are signed.
    ids = least.select(F.col("u").alias("doc_id")).distinct()
    shared = signed(with_marks(known, ids, "stands"), words, num, den).withColumn("u", F.min("doc").over(tile)).withColumn("z", F.max("doc").over(tile)).where("u < z").select("sig", "doc", "u")
    shared = staged(shared, "jaccard-tiles")
    discard(least)
    facts = lambda of: nodes.select(F.struct("n", "bits").alias(of), F.col("doc_id").alias(f"{of}_id"))
    met = staged(shared.where("doc > u").select("u", "doc").distinct(), "jaccard-met")
    stars = met.withColumnRenamed("doc", "v")
    copies = equal.select("u", F.col("v")).unionByName(equal.select(F.col("v").alias("u"), F.col("u").alias("v")))
    stars = stars.join(copies, ["u", "v"], "left_anti")

    def may(pairs: DataFrame) -> DataFrame:
        near = pairs.join(facts("a"), F.col("u") == F.col("a_id")).join(facts("b"), F.col("v") == F.col("b_id"))
        return near.where(may_link("a", "b", num, den)).select("u", "v").distinct()

    tested = staged(may(stars), "jaccard-tested")
    near = verified(known, tested, words, num, den)
    links = staged(equal.unionByName(near), "jaccard-links")
    found = staged(components(links), "jaccard-components")
    tiles = open_tiles(shared, met, found)
    discard(near, equal, shared, met, found)
    more = verified(known, open_pairs(tiles, nodes, num, den).join(tested, ["u", "v"], "left_anti"), words, num, den)
    discard(tiles, nodes, tested)
    found = components(links.unionByName(more))
    discard(links, more)

    of_node = sets.where(F.col("doc_id").isNotNull()).groupBy("first").agg(F.min("doc_id").alias("low")).join(found.withColumnRenamed("node", "first"), "first", "left")
    of_node = of_node.select("first", "low", F.coalesce("component", "first").alias("component"))
    lows = of_node.groupBy("component").agg(F.min("low").alias("component_id"))
    labels = of_node.join(lows, "component").select("first", "component_id")
    # Repeated rows of one id may stand for different sets; the id then has the least of their components.
    out = sets.select("doc_id", "n_shingles", "first").join(labels, "first", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """``docs`` with one document of each component, the one of the least id, all columns as they are.

    Of rows with one doc_id one stays; rows with a null doc_id all stay.
    """
    kept = join(docs, words, num, den).where(F.col("doc_id") == F.col("component_id"))
    kept = staged(kept.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id")).distinct(), "jaccard-kept")
    named = having(docs, kept).dropDuplicates(["doc_id"])
    return named.unionByName(docs.where(F.col("doc_id").isNull()))
