"""Toxicity scores: a learned lexicon, Levenshtein automata on its trie, and context windows."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_crc, pieces, staged, texts

_WORD = re.compile(r"[^\W_]+")
#: Quotation marks and words that report another's speech.
QUOTES = "\"“”„«»"
REPORTS = frozenset("said says wrote writes quoted quote called calls sagte schrieb zitierte disait écrit cité dijo escribió citó".split())
WINDOW = 80
#: Labelled documents used to fit at most; shortest and longest term; texts beyond which terms count as equally frequent.
FIT_ROWS, SHORTEST, LONGEST, MOST_RIVALS = 20_000, 3, 40, 1000
#: What a quoted hit counts where labels say nothing about quotation.
QUOTED = 0.3


def edits_of(length: int) -> int:
    return 0 if length < 5 else 1 if length < 9 else 2


class Automaton:
    """Levenshtein automata of all terms, run on their common trie and determinised as words come.

    A state is a set of (trie node, edits so far); letters that no term has share one transition.  A term
    that ends with * matches every word that begins with it, without edits.  Most words die within a few
    letters.
    """

    def __init__(self, terms: list[str], edits: dict[str, int] | None = None):
        """``edits`` may allow a term fewer edits than its length does."""
        self.next: list[dict[str, int]] = [{}]
        self.ends: dict[int, list[str]] = {}
        self.budget = [0]
        self.most = {t: 0 if t.endswith("*") else edits_of(len(t)) if edits is None else min(edits[t], edits_of(len(t))) for t in terms}
        for term in terms:
            node, most = 0, self.most[term]
            self.budget[0] = max(self.budget[0], most)
            for letter in term.rstrip("*"):
                if letter not in self.next[node]:
                    self.next[node][letter] = len(self.next)
                    self.next.append({})
                    self.budget.append(0)
                node = self.next[node][letter]
                self.budget[node] = max(self.budget[node], most)
            self.ends.setdefault(node, []).append(term)
        self.letters = {letter for edges in self.next for letter in edges}
        self.states: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple] = []
        self.early: list[tuple] = []
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, state: set) -> frozenset:
        """With the states that a left-out letter leads to."""
        todo = list(state)
        while todo:
            node, edits = todo.pop()
            for child in self.next[node].values():
                if edits < self.budget[child] and (child, edits + 1) not in state:
                    state.add((child, edits + 1))
                    todo.append((child, edits + 1))
        return frozenset(state)

    def _state(self, state: frozenset) -> int:
        if state not in self.number:
            self.number[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            best: dict[str, int] = {}
            early: dict[str, int] = {}
            for node, edits in state:
                for term in self.ends.get(node, ()):
                    if term.endswith("*"):
                        if not edits:
                            early[term] = 0
                    elif edits <= self.most[term]:
                        best[term] = min(edits, best.get(term, edits))
            self.found.append(tuple(sorted(best.items())))
            self.early.append(tuple(sorted(early.items())))
        return self.number[state]

    def _move(self, at: int, letter: str) -> int:
        """The next state, -1 if there is none."""
        out: set = set()
        for node, edits in self.states[at]:
            edges = self.next[node]
            if letter in edges:
                out.add((edges[letter], edits))
            if edits < self.budget[node]:
                out.add((node, edits + 1))
            for child in edges.values():
                if edits < self.budget[child]:
                    out.add((child, edits + 1))
        least: dict[int, int] = {}
        for node, edits in self._closed(out):
            least[node] = min(edits, least.get(node, edits))
        return self._state(frozenset(least.items())) if least else -1

    def match(self, word: str) -> list[tuple[str, int]]:
        """The (term, edits) that ``word`` may stand for."""
        at, hits, moves, letters = self.start, [], self.moves, self.letters
        for letter in word:
            if letter not in letters:
                letter = ""
            step = moves[at].get(letter)
            if step is None:
                step = moves[at][letter] = self._move(at, letter)
            if step < 0:
                return hits
            at = step
            if self.early[at]:
                hits.extend(self.early[at])
        return hits + list(self.found[at])


def nearest(found: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """Of a word's matches the closest kind: the word itself, else beginnings, else one edit, else two.

    So a beginning or an edit has only the evidence of words that are no terms themselves.
    """
    kind = lambda x: 1 + x[1] if x[1] else int(x[0].endswith("*"))
    least = min(map(kind, found), default=0)
    return [x for x in found if kind(x) == least]


class Finder:
    """Words of texts that stand for terms of a lexicon, with a bounded cache of words."""

    def __init__(self, terms: list[str], edits: dict[str, int] | None = None, cache: int = 100_000):
        self.automaton, self.known, self.cache = Automaton(terms, edits), {}, cache

    def hits(self, text: str) -> list[tuple[str, list[tuple[str, int]], bool]]:
        """(word, [(term, edits)], quoted) of each place of ``text`` whose word stands for terms."""
        low, known = text.lower(), self.known
        if len(known) > self.cache:
            known.clear()
        some = {}
        for word in set(_WORD.findall(low)):
            found = known.get(word)
            if found is None:
                found = known[word] = nearest(self.automaton.match(word))
            if found:
                some[word] = found
        if not some:
            return []
        places = re.finditer(r"(?<![^\W_])(?:" + "|".join(map(re.escape, some)) + r")(?![^\W_])", low)
        return [(m[0], some[m[0]], is_quoted(low, m.start(), m.end())) for m in places]


def is_quoted(text: str, start: int, end: int) -> bool:
    """Whether the window before and after has marks around the word, or a word of reporting before it."""
    before, after = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
    marks = sum(before.count(q) for q in QUOTES)
    return marks % 2 == 1 and any(q in after for q in QUOTES) or not REPORTS.isdisjoint(_WORD.findall(before)[-6:])


def _labelled_sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic, half): the distinct texts of at most ``rows`` labelled documents outside the held-out third.

    Documents are chosen by a hash of the id.  Copies say the same thing once; their text is toxic if one of
    them is labelled so, as with repeated labels of one document.  A hash of the text deals them into halves.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (keyed_crc("doc_id") % 3 != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    once = texts(docs, "doc_id").join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    return once.withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int"))


COUNTS = ("neg0", "pos0", "neg1", "pos1")


def _counted(sample: DataFrame, features: Any) -> DataFrame:
    """(feature, neg0, pos0, neg1, pos1): in how many other and toxic texts of each half a feature of ``features(text)`` is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = features()
        seen: list[Counter] = [Counter() for _ in COUNTS]

        def out() -> pa.RecordBatch:
            names = list(set().union(*seen))
            made = pa.RecordBatch.from_pydict({"feature": pa.array(names, pa.string())} | {c: pa.array([s[x] for x in names], pa.int64()) for c, s in zip(COUNTS, seen, strict=True)})
            for s in seen:
                s.clear()
            return made

        for batch in pieces(batches):
            for text, toxic, half in zip(*[batch.column(c).to_pylist() for c in ("text", "toxic", "half")], strict=True):
                seen[2 * half + bool(toxic)].update(of(text))
            if sum(map(len, seen)) > 300_000:
                yield out()
        yield out()

    parts = sample.select("text", "toxic", "half").mapInArrow(run, "feature string, " + ", ".join(f"{c} long" for c in COUNTS))
    return parts.groupBy("feature").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _terms() -> Any:
    def of(text: str) -> set[str]:
        words = {w for w in _WORD.findall(text.lower()) if SHORTEST <= len(w) <= LONGEST}
        return words | {w[:k] + "*" for w in words for k in range(4, 9) if len(w) > k}

    return of


def evidence(pos: float, neg: float, n_pos: float, n_neg: float) -> float:
    """Log of how many times likelier a feature is in toxic texts, from bounds one standard deviation off the counts."""
    share = (pos - math.sqrt(pos)) / max(n_pos, 1)
    return math.log(share * max(n_neg, 1) / (neg + math.sqrt(neg) + 1)) if share > 0 else 0.0


def _logistic(rows: list[tuple[float, float, int, int]]) -> list[float]:
    """(bias, weight of plain hits, weight of quoted hits) by Newton's method; the weights are drawn to 1 and QUOTED.

    ``rows`` are (plain, quoted, toxic, count).
    """
    x = np.array([[1.0, p, q] for p, q, _, _ in rows])
    y, n = (np.array([r[i] for r in rows], float) for i in (2, 3))
    prior, pull = np.array([0.0, 1.0, QUOTED]), np.diag([1e-3, 1.0, 4.0])
    b = np.array([math.log((y @ n + 0.5) / ((1 - y) @ n + 0.5)), 1.0, QUOTED])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + pull, x.T @ (n * (y - p)) - pull @ (b - prior))
        b = b + step * min(1.0, 2 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return [round(float(b[0]), 6), round(max(0.0, float(b[1])), 6), round(max(0.0, float(b[2])), 6)]


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> dict:
    """Learn terms, the evidence of each, and how hits add up, from labelled documents.

    ``rows`` bounds the labelled documents used, and so what is counted and collected; each distinct text
    counts once.  A term is a word of SHORTEST to LONGEST letters, or a beginning of words marked *.  Every term
    is kept that toxic texts have more often than chance would give any of the terms as frequent as it.

    A term with so many edits has the evidence of its own count, from cautious bounds, and has none unless toxic
    texts of both halves of the sample show it; so edits are allowed only where words that are no terms themselves
    speak for them.  A logistic function of the summed evidence, in plain and in quoted places, gives the score.
    Rows whose crc32 of the id leaves 1 modulo 3 are never used.  Without labels of both kinds the model has
    no terms and all scores are 0.
    """
    sample = staged(_labelled_sample(docs, labels, rows), "toxicity-sample")
    counted = _counted(sample, _terms)
    size = {(r.half, r.toxic): r.n for r in sample.groupBy("half", (F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    of = lambda *keys: sum(size.get(k, 0) for k in keys)
    pos, neg = of((0, 1), (1, 1)), of((0, 0), (1, 0))
    empty = {"terms": {}, "lexicon": [], "logistic": None}
    if not pos or not neg:
        return empty
    rate = pos / (pos + neg)
    both = counted.select("feature", (F.col("pos0") + F.col("pos1")).alias("pos"), (F.col("neg0") + F.col("neg1")).alias("neg"))
    df = F.col("pos") + F.col("neg")
    share = F.col("pos") / df
    surprise = df * (share * F.log(share / rate) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0))
    frequent = both.where(df >= 3)
    by_df = {r.df: r.n for r in frequent.groupBy(F.least(df, F.lit(MOST_RIVALS)).alias("df")).agg(F.count("*").alias("n")).collect()}  # at most MOST_RIVALS rows
    if not by_df:
        return empty
    as_frequent, so_far = {}, 0
    for k in sorted(by_df, reverse=True):
        so_far += by_df[k]
        as_frequent[k] = so_far
    rival = F.create_map(*[x for k, m in as_frequent.items() for x in (F.lit(k), F.log(F.lit(float(m))))])
    kept = (
        frequent.where((F.col("pos") >= 3) & (F.col("pos") * neg >= 2 * F.col("neg") * pos)).withColumn("surprise", surprise)
        .where(F.col("surprise") > rival[F.least(df, F.lit(MOST_RIVALS))] + 3).select("feature").collect()
    )
    terms = sorted(r.feature for r in kept)

    def hit_features() -> Any:
        finder = Finder(terms)
        return lambda text: {f"{term} {edits}" for _, found, _ in finder.hits(text) for term, edits in found}

    weights = {}
    for r in _counted(sample, hit_features).where("pos0 > 0 and pos1 > 0").collect():
        weight = evidence(r.pos0 + r.pos1, r.neg0 + r.neg1, pos, neg)
        if weight > math.log(2):
            weights[r.feature] = round(weight, 6)
    model = {"terms": weights, "lexicon": terms, "logistic": None}

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = finder_of(model)
        for batch in pieces(batches):
            found = [sums(finder, model, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"plain": pa.array([round(x[0], 6) for x in found], pa.float64()), "quoted": pa.array([round(x[1], 6) for x in found], pa.float64()), "toxic": batch.column("toxic").cast(pa.int64())})

    seen = sample.select("text", "toxic").mapInArrow(summed, "plain double, quoted double, toxic long")
    seen = seen.groupBy("plain", "quoted", F.least("toxic", F.lit(1)).alias("toxic")).agg(F.count("*").alias("n")).orderBy("plain", "quoted", "toxic").collect()  # at most ``rows``
    return model | {"logistic": _logistic([(r.plain, r.quoted, r.toxic, r.n) for r in seen])}


def finder_of(model: dict) -> Finder:
    """A finder of all terms, with those edits that have evidence."""
    edits = dict.fromkeys(model["lexicon"], 0)
    for name in model["terms"]:
        term, n = name.rsplit(" ", 1)
        edits[term] = max(int(n), edits[term])
    return Finder(model["lexicon"], edits)


def sums(finder: Finder, model: dict, text: str) -> tuple[float, float, int, int]:
    """(evidence in plain places, evidence in quoted places only, hits, quoted hits).

    Each distinct word of the text counts once, by its best term; neighbouring terms and their beginnings don't
    add up.
    """
    plain: dict[str, float] = {}
    quoted: dict[str, float] = {}
    n = n_quoted = 0
    for word, found, in_quotes in finder.hits(text):
        weight = max(model["terms"].get(f"{term} {edits}", 0.0) for term, edits in found)
        if weight:
            n += 1
            n_quoted += in_quotes
            (quoted if in_quotes else plain)[word] = weight
    return sum(plain.values()), sum(w for x, w in quoted.items() if x not in plain), n, n_quoted


def judged(finder: Finder, model: dict, text: str) -> tuple[float, int, int]:
    plain, quoted, n, n_quoted = sums(finder, model, text)
    if model["logistic"] is None:
        return 0.0, n, n_quoted
    bias, of_plain, of_quoted = model["logistic"]
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, bias + of_plain * plain + of_quoted * quoted)))), n, n_quoted


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score, n_hits, n_quoted) of every whole text.

    Texts without hits, null and empty ones have the rate that the model learnt for such texts; repeated rows
    each keep their row.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("n_hits", pa.int64()), ("n_quoted", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = finder_of(model)
        for batch in pieces(batches):
            values, n, quoted = zip(*[judged(finder, model, t) for t in batch.column("text").to_pylist()], strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.float64()), pa.array(n, pa.int64()), pa.array(quoted, pa.int64())], schema=schema)

    return texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, score double, n_hits long, n_quoted long")


def without_toxic(docs: DataFrame, model: dict, limit: float = 0.7) -> DataFrame:
    """The documents whose score is below ``limit``, all columns as they are; a null text is kept."""

    @F.pandas_udf("double")
    def value(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = finder_of(model)
        for text in batches:
            yield text.map(lambda x: judged(finder, model, x or "")[0])

    return docs.where(value(F.coalesce(F.col("text"), F.lit(""))) < limit)
