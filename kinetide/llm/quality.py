"""Quality filter: an interpolated modified Kneser-Ney model of letters (code points), thresholded per language."""

from __future__ import annotations

import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, keyed_crc, pieces, staged, texts

ORDER, LETTERS = 4, 64
#: Bytes of a code point in the code of an n-gram, n-grams of which each task keeps the probability, and letters counted together.
WIDTH, COMMON, TOGETHER = 3, 1 << 17, 2_000_000
#: Letters with which a text's score is drawn to its language's mean, so that short texts aren't judged by chance.
PRIOR = 64
QUANTILE, SLACK, LEAST_DOCS, LANGUAGES = 0.99, 0.25, 20, 1000


@cache
def alphabet() -> np.ndarray:
    """The class, under 64, of each code point of the basic plane, for the dense ``Model``; the filter takes letters as they are.

    0 line ends (and what stands before a text), 1 blanks, 2-27 a-z, 28-53 A-Z, both also with accents,
    54 digits, 55 points, 56 marks inside and around words, 57 other ASCII, 58-61 other letters, 62 marks,
    63 the rest.
    """
    out = np.full(1 << 16, 63, np.uint8)
    for i in range(1 << 16):
        c = chr(i)
        kind = unicodedata.category(c)
        base = unicodedata.normalize("NFD", c)[0] if kind[0] == "L" else c
        if c in "\n\r":
            out[i] = 0
        elif c.isspace():
            out[i] = 1
        elif "a" <= base <= "z":
            out[i] = 2 + ord(base) - 97
        elif "A" <= base <= "Z":
            out[i] = 28 + ord(base) - 65
        elif kind == "Nd":
            out[i] = 54
        elif c in ".,;:?":
            out[i] = 55
        elif c in "'\"()-’“”«»":
            out[i] = 56
        elif i < 128:
            out[i] = 57
        elif kind[0] == "L":
            out[i] = 58 + i % 4
        elif kind[0] == "M":
            out[i] = 62
    return out


def letters_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    return alphabet()[np.minimum(points, 0xFFFF)]


def grams(letters: np.ndarray) -> np.ndarray:
    """The code of each letter with the three before it; line ends stand before the first."""
    padded = np.concatenate([np.zeros(ORDER - 1, np.uint32), letters.astype(np.uint32)])
    n = len(letters)
    code = padded[:n].copy()
    for i in range(1, ORDER):
        code = code * np.uint32(LETTERS) + padded[i : n + i]
    return code


def trusted_counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(code, n): counts of all letter 4-grams of the trusted texts.

    Texts travel to the join as compressed letter classes, about a third of their size.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = [zlib.compress(letters_of(t).tobytes(), 1) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "letters": pa.array(made, pa.binary())})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(some or [np.empty(0, np.uint32)]), return_counts=True)
            some.clear()
            return pa.RecordBatch.from_pydict({"code": pa.array(codes.astype(np.int32)), "n": pa.array(n, pa.int64())})

        for batch in pieces(batches):
            some += [grams(np.frombuffer(zlib.decompress(x), np.uint8)) for x in batch.column("letters").to_pylist()]
            if sum(map(len, some)) > 4_000_000:
                yield out()
        yield out()

    joined = docs.mapInArrow(packed, "doc_id long, letters binary").join(trusted.hint("merge"), "doc_id", "left_semi")  # the same plan at every size
    return joined.select("letters").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def points_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, each after the ORDER - 1 line ends that stand before it, and the place of each text's first letter."""
    before = "\n" * (ORDER - 1)
    points = np.frombuffer("".join(before + t for t in texts).encode("utf-32-le", "replace"), dtype="<u4")
    sizes = np.array([len(t) + len(before) for t in texts], np.int64)
    return points, np.cumsum(sizes) - sizes + len(before)


def numbered(points: np.ndarray) -> np.ndarray:
    """A number for the n-gram that ends at each place from ORDER - 1 on: equal n-grams, equal numbers."""
    known = np.zeros(0x110000, np.int64)
    known[points] = 1
    ids = (np.cumsum(known) - 1)[points]
    size = int(known.sum())
    pairs = ids[:-1] * size + ids[1:]
    size *= size
    if size > 1 << 31:  # very many different letters: number the pairs that occur
        found, pairs = np.unique(pairs, return_inverse=True)
        size = len(found)
    return pairs[:-2] * size + pairs[2:]


def spelled(points: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The codes of the n-grams that end at some places: their code points, WIDTH bytes each."""
    grams = np.stack([points[ends - i] for i in range(ORDER - 1, -1, -1)], axis=1) if len(ends) else np.empty((0, ORDER), np.uint32)
    raw = np.ascontiguousarray(grams.astype(">u4").view(np.uint8).reshape(-1, ORDER, 4)[:, :, 4 - WIDTH :])
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(ORDER * WIDTH), len(grams), [None, pa.py_buffer(raw)]).cast(pa.binary())


def letter_ends(sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The places of all letters of texts with these sizes and first places."""
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def counted(texts: list[str]) -> pa.RecordBatch:
    """(code, n) of the n-grams of some texts."""
    points, first = points_of(texts)
    ends = letter_ends(np.array([len(t) for t in texts], np.int64), first)
    if not len(ends):
        return pa.RecordBatch.from_pydict({"code": pa.array([], pa.binary()), "n": pa.array([], pa.int64())})
    _, at, n = np.unique(numbered(points)[ends - (ORDER - 1)], return_index=True, return_counts=True)
    return pa.RecordBatch.from_pydict({"code": spelled(points, ends[at]), "n": pa.array(n, pa.int64())})


def counts_of(rows: DataFrame, column: str = "text") -> DataFrame:
    """(code, n): counts of all n-grams of letters, from texts or from compressed ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for batch in pieces(batches, 64):
            for t in batch.column(column).to_pylist():
                some.append(zlib.decompress(t).decode() if isinstance(t, bytes) else t)
                size += len(some[-1])
                if size > TOGETHER:
                    yield counted(some)
                    some, size = [], 0
        yield counted(some)

    return rows.select(column).mapInArrow(run, "code binary, n long").groupBy("code").agg(F.sum("n").alias("n"))


def trusted_letters(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(code, n) of the trusted texts, which travel to the join compressed."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = [zlib.compress(t.encode("utf-8", "replace"), 1) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "packed": pa.array(made, pa.binary())})

    return counts_of(docs.mapInArrow(packed, "doc_id long, packed binary").join(trusted.hint("merge"), "doc_id", "left_semi"), "packed")


def smoothed(counts: DataFrame, context: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """One order of the model from (code, n): (code, a), the discounted share of each n-gram after its
    context, and (context, rest), the share left to the next lower order.  Counts and contexts are joined
    by context, each context with its own row."""
    c = [F.sum((F.col("n") == i).cast("long")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    of = counts.agg(*c).first()
    n1, n2, n3, n4 = (x or 0 for x in of)
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    steps = [(1, n1, n2), (2, n2, n3), (3, n3, n4)]
    d = [min(k, max(0.1, k - (k + 1) * y * more / some)) if some else 0.5 * k for k, some, more in steps]
    off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    context = (F.col("code") / LETTERS).cast("int") if context is None else context
    keyed = counts.withColumn("context", context)
    contexts = keyed.groupBy("context").agg(F.sum("n").alias("total"), F.sum(off).alias("taken"))
    shares = keyed.join(contexts, "context").select("code", ((F.col("n") - off) / F.col("total")).alias("a"))
    return shares, contexts.select("context", (F.col("taken") / F.col("total")).alias("rest"))


def _last(code: str, letters: int) -> Column:
    return F.expr(f"substring({code}, {-WIDTH * letters}, {WIDTH * letters})") if letters else F.expr("X''")


class Letters:
    """The model of code points as tables, of every order: (code, a) and (context, rest).  None of them is capped or collected."""

    def __init__(self, counts: DataFrame):
        tables = [counts]
        for order in range(ORDER - 1, 0, -1):  # how many letters precede each shorter n-gram
            tables.insert(0, staged(tables[0].groupBy(_last("code", order).alias("code")).agg(F.count("*").alias("n")), "quality-counts"))
        self.known = tables[0].count()
        self.orders = [smoothed(t, F.expr(f"substring(code, 1, {WIDTH * i})")) for i, t in enumerate(tables)]

    def log_probability(self, codes: DataFrame) -> DataFrame:
        """``codes`` (distinct, with other columns as they are) and ``logp`` of the last letter of each, by joins on code and context.

        p(w | context) = a(context, w) + rest(context) * p(w | shorter context); letters the model doesn't know share one place.
        """
        p = codes.sparkSession.range(1).select(F.expr("X''").alias("shorter"), F.lit(1 / (self.known + 1)).alias("lower"))
        for order, (shares, contexts) in enumerate(self.orders, 1):
            need = codes if order == ORDER else codes.select(_last("code", order).alias("code")).distinct()
            need = need.withColumn("context", F.expr(f"substring(code, 1, {WIDTH * (order - 1)})")).withColumn("shorter", _last("code", order - 1))
            need = need.join(shares, "code", "left").join(contexts, "context", "left").join(p, "shorter")
            made = need.withColumn("p", F.coalesce("a", F.lit(0.0)) + F.coalesce("rest", F.lit(1.0)) * F.col("lower"))
            p = made.select(F.col("code").alias("shorter"), F.col("p").alias("lower"))
        return made.select(*codes.columns, F.log("p").alias("logp"))


def most_met(known: DataFrame, most: int = COMMON) -> DataFrame:
    """(code, logp) of the ``most`` rows of greatest n, of equal ones those of least code.

    How many n-grams are met how often tells the least n that is among them, so that only these rows go to the driver
    and not the first ``most`` of each task.  The distinct n of one power of two go there too: fewer than all letters / ``most``.
    """
    by_n = known.groupBy("n").agg(F.count("*").alias("codes")).withColumn("step", F.floor(F.log2("n")).cast("int"))
    taken, low = 0, None
    for r in by_n.groupBy("step").agg(F.sum("codes").alias("codes")).orderBy(F.desc("step")).collect():
        if taken + r["codes"] > most:
            for x in by_n.where(F.col("step") == r["step"]).orderBy(F.desc("n")).collect():
                low = x["n"]
                if taken + x["codes"] > most:
                    break
                taken += x["codes"]
            break
        taken += r["codes"]
    if low is None:
        return known.select("code", "logp")
    ties = known.where(F.col("n") == low).orderBy("code").limit(most - taken)
    return staged(known.where(F.col("n") > low).unionByName(ties).select("code", "logp"), "quality-common")


class Common:
    """The n-grams met most often, as sorted numbers, with their log-probabilities: what a task looks up without a join."""

    def __init__(self, codes: list[bytes], logp: list[float]):
        raw = np.frombuffer(b"".join(bytes(c) for c in codes), np.uint8).reshape(-1, ORDER, WIDTH).astype(np.int64)
        points = (raw << np.arange(8 * (WIDTH - 1), -1, -8)).sum(axis=2)
        # So that four letters fit 64 bits; n-grams with others are joined.
        self.letters = np.unique(points)[:32_767]
        self.place = np.zeros(0x110000, np.int64)
        self.place[self.letters] = np.arange(1, len(self.letters) + 1)
        kept = (self.place[points] > 0).all(axis=1) if len(points) else np.zeros(0, bool)
        number = self.numbers(points[kept].T)
        order = np.argsort(number)
        self.codes, self.logp = number[order], np.array(logp, np.float64)[kept][order]

    def numbers(self, points: np.ndarray) -> np.ndarray:
        """The number of each n-gram, from its letters, first to last; 0 stands for letters not among these."""
        out = np.zeros(len(points[0]), np.int64)
        for x in points:
            out = out * (len(self.letters) + 1) + self.place[x]
        return out

    def look_up(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-probability or 0, whether it's known) of the n-gram that ends at each place."""
        if not len(self.codes) or not len(ends):
            return np.zeros(len(ends)), np.zeros(len(ends), bool)
        ids, size = self.place[points], len(self.letters) + 1
        code = ((ids[ends - 3] * size + ids[ends - 2]) * size + ids[ends - 1]) * size + ids[ends]
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        known = (self.codes[at] == code) & (ids[ends] > 0) & (ids[ends - 1] > 0) & (ids[ends - 2] > 0) & (ids[ends - 3] > 0)
        return np.where(known, self.logp[at], 0.0), known


class Model:
    """Dense tables of orders 1 to 3 and the seen 4-grams of letter classes, from ``trusted_counts``; the filter has ``Letters``.

    There are 64 letter classes, so no table has over 64**4 entries whatever the corpus; that bounds what
    is collected and broadcast.
    """

    def __init__(self, counts: DataFrame):
        tables = [counts]
        for order in range(ORDER - 1, 0, -1):  # how many letters precede each shorter n-gram
            tables.insert(0, staged(tables[0].groupBy((F.col("code") % LETTERS**order).alias("code")).agg(F.count("*").alias("n")), "quality-counts"))
        p = np.full(1, 1 / LETTERS)
        for order, table in enumerate(tables, 1):
            shares, contexts = (x.toPandas() for x in smoothed(table))
            rest = np.ones(LETTERS ** (order - 1))
            rest[contexts["context"].to_numpy()] = contexts["rest"]
            codes, a = shares["code"].to_numpy(), shares["a"].to_numpy()
            if order == ORDER:
                self.lower, self.rest, self.codes, self.a = p.astype(np.float32), rest.astype(np.float32), codes.astype(np.uint32), a.astype(np.float32)
            else:
                # p(w | context) = a(context, w) + rest(context) * p(w | shorter context)
                p = (rest.reshape(-1, max(1, LETTERS ** (order - 2)), 1) * (p.reshape(1, -1, LETTERS) if order > 1 else p.reshape(1, 1, 1).repeat(LETTERS, 2))).ravel()
                p[codes] += a

    def log_table(self) -> np.ndarray:
        """The log-probability of the last letter of every 4-gram, seen or not."""
        p = (self.rest.reshape(LETTERS, -1, 1) * self.lower.reshape(1, -1, LETTERS)).ravel()
        p[self.codes] += self.a
        return np.log(p, out=p)


def _kept_language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit(""))


def _digest() -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))


class Filter:
    """A fitted quality filter: the model and the limits of each language, in nats per letter."""

    def __init__(self, docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, slack: float = SLACK):
        """Trusted are the labelled documents all of whose labels have quality 1.

        Four fifths of them (by a hash of the id) give the counts, over all their text; the other fifth,
        which the model hasn't seen, gives the quantile of each language.  A language with fewer than
        LEAST_DOCS of these, and any beyond the LANGUAGES most frequent, has the limit of all together.
        Without trusted documents every document is accepted.
        """
        self.read = lambda d: texts(d, F.col("doc_id").cast("long").alias("doc_id"), _kept_language(F.col("lang")).alias("lang"), _digest().alias("digest"))
        good = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q")).where("q = 1").select("doc_id")
        counts = staged(trusted_letters(texts(docs, F.col("doc_id").cast("long").alias("doc_id")), good.where(keyed_crc("doc_id") % 5 != 0)), "quality-counts")
        self.docs, self.empty = docs, counts.isEmpty()
        self.limits, self.means, self.limit, self.mean = {}, {}, float("inf"), 0.0
        if self.empty:
            self.model = None
            return
        self.model = Letters(counts)
        self.scores = staged(self.scored(docs), "quality-scores")
        checked = self.scores.join(good.where(keyed_crc("doc_id") % 5 == 0), "doc_id", "left_semi").where("n > 0")
        if checked.isEmpty():
            checked = self.scores.join(good, "doc_id", "left_semi").where("n > 0")
        checked = staged(checked, "quality-checked")
        mean = checked.agg((-F.sum("logp") / F.sum("n")).alias("mean")).first()["mean"]
        own = checked.groupBy("lang").agg((-F.sum("logp") / F.sum("n")).alias("mean"), F.count("*").alias("docs")).where(F.col("docs") >= LEAST_DOCS).orderBy(F.desc("docs"), "lang").limit(LANGUAGES)
        self.means = {r["lang"]: r["mean"] for r in own.collect()}
        self.mean = mean if mean is not None else 0.0
        quantiles = lambda: [F.percentile_approx(self.nats(), F.lit(q), F.lit(10_000)).alias(f"q{i}") for i, q in enumerate((0.5, quantile))]
        limit = lambda r: r["q1"] + slack * (r["q1"] - r["q0"]) + 0.02
        whole = checked.agg(*quantiles()).first()
        self.limit = limit(whole) if whole["q1"] is not None else float("inf")
        self.limits = {r["lang"]: limit(r) for r in checked.where(F.col("lang").isin(list(self.means))).groupBy("lang").agg(*quantiles()).collect()} if self.means else {}

    def _of_language(self, values: dict[str, float], rest: float) -> Column:
        if not values:
            return F.lit(float(rest))
        return F.coalesce(F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("lang")], F.lit(float(rest)))

    def nats(self) -> Column:
        """Nats per letter, drawn to the language's mean by PRIOR letters."""
        return (-F.col("logp") + PRIOR * self._of_language(self.means, self.mean)) / (F.col("n") + PRIOR)

    def scored(self, docs: DataFrame) -> DataFrame:
        """(doc_id, lang, digest, n, logp) of every whole text.

        The probabilities of all n-grams that occur are joined once each, by code and context.  The COMMON most
        frequent ones are looked up where the texts are; each other one is joined with its text's row.
        """
        rows = self.read(docs)
        met = staged(counts_of(rows), "quality-met")
        known = staged(self.model.log_probability(met), "quality-letters")
        top = most_met(known).toArrow()
        codes, logp = b"".join(top["code"].to_pylist()), top["logp"].to_numpy()
        common, name = docs.sparkSession.sparkContext.broadcast(([codes], logp)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = held(("quality", name), lambda: Common(*common.value))  # workers keep the table of the last filter by name
            for batch in pieces(batches, 256):
                found = batch.column("text").to_pylist()
                points, first = points_of(found)
                size = np.array([len(t) for t in found], np.int64)
                ends = letter_ends(size, first)
                logp, there = table.look_up(points, ends)
                border = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
                rare = np.concatenate([np.zeros(1, np.int64), np.cumsum(~there)])[border]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column("doc_id"), "lang": batch.column("lang"), "digest": batch.column("digest"), "n": pa.array(size),
                    "near": pa.array([float(logp[a:z].sum()) for a, z in zip(border, border[1:], strict=False)], pa.float64()),
                    "rare": pa.ListArray.from_arrays(pa.array(rare, pa.int32()), spelled(points, ends[~there]))})

        found = rows.mapInArrow(run, "doc_id long, lang string, digest binary, n long, near double, rare array<binary>")
        found = staged(found.withColumn("row", F.monotonically_increasing_id()), "quality-rows")
        rest = found.select("row", F.explode("rare").alias("code")).groupBy("row", "code").agg(F.count("*").alias("times"))
        rest = rest.join(known.select("code", "logp"), "code").groupBy("row").agg(F.sum(F.col("times") * F.col("logp")).alias("rest"))
        return found.drop("rare").join(rest, "row", "left").select("doc_id", "lang", "digest", "n", (F.col("near") + F.coalesce("rest", F.lit(0.0))).alias("logp"))

    def judged(self) -> DataFrame:
        """(doc_id, lang, n_letters, perplexity, threshold, accepted) of the documents the filter was fitted on."""
        nats, limit = self.nats(), self._of_language(self.limits, self.limit)
        return self.scores.select("doc_id", "lang", F.col("n").alias("n_letters"), F.exp(nats).alias("perplexity"), F.exp(limit).alias("threshold"), (nats <= limit).cast("int").alias("accepted"))

    def accepted(self, docs: DataFrame) -> DataFrame:
        """The documents of ``docs`` within their language's limit, all columns as they are."""
        if self.empty:
            return docs
        scores = self.scores if docs is self.docs else self.scored(docs)
        out = scores.where(self.nats() > self._of_language(self.limits, self.limit)).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("digest").alias("_digest")).distinct()
        same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (_kept_language(F.col("lang")) == F.col("_lang")) & (_digest() == F.col("_digest"))
        return docs.join(out, same, "left_anti")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: perplexity under the trusted model, its language's threshold, and the verdict.

    A null or empty text has its language's mean perplexity and is accepted; a null language is a language
    of its own.  Repeated rows each keep their row.  Without trusted documents perplexity and threshold are
    null and all are accepted; an empty table gives no rows.
    """
    fitted = Filter(docs, labels)
    if fitted.empty:
        null = F.lit(None).cast("double")
        return fitted.read(docs).select("doc_id", "lang", F.length("text").cast("long").alias("n_letters"), null.alias("perplexity"), null.alias("threshold"), F.lit(1).alias("accepted"))
    return fitted.judged()
