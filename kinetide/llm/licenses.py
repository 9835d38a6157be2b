"""License scan: exact containment join of short templates with every window of words, beside plain phrases."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Iterator
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, texts

#: Phrases whose places are counted, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: License notices in common use, and the labels that the containment join adds.
TEMPLATES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-4.0": "licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc0": "dedicated to the public domain under cc0 1 0 universal",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mpl-2.0": "subject to the terms of the mozilla public license version 2 0",
}
THRESHOLD = 0.9
#: A block inside one line is at most so many times as long as its template; over line ends, as long as it.
SPAN = 2

_WORD_BYTES = frozenset(range(0x30, 0x3A)) | frozenset(range(0x61, 0x7B)) | frozenset(range(0x80, 0x100))
_BLANKS = bytes(b if b in _WORD_BYTES else 0x0A if b == 0x0A else 0x20 for b in range(256))


def lines_of(text: str) -> bytes:
    """UTF-8 with A-Z lowered and everything that is in no word blank; line ends stay."""
    return text.encode("utf-8", "replace").lower().translate(_BLANKS)


def runs(places: list[tuple[int, bytes]], need: int, n: int, span: int) -> list[tuple[int, int, int]]:
    """(first place, last place, tokens) of windows of at most ``span`` words with ``need`` of n distinct tokens.

    ``places`` are those of a template's tokens.  A window is the shortest that ends where ``need`` is first
    reached, and what of the template follows at once; the next one begins after it.
    """
    out: list[tuple[int, int, int]] = []
    window: deque[tuple[int, bytes]] = deque()
    count: Counter[bytes] = Counter()
    until = -1  # new tokens up to here belong to the window that has ``need``
    for i, w in [*places, (1 << 62, b"")]:
        if until >= 0 and (i > until or w in count):
            out.append((window[0][0], window[-1][0], len(count)))
            window.clear()
            count.clear()
            until = -1
        window.append((i, w))
        count[w] += 1
        while window[0][0] <= i - span or count[window[0][1]] > 1:
            old = window.popleft()[1]
            count[old] -= 1
            if not count[old]:
                del count[old]
        if len(count) >= need:
            until = min(i + n - len(count), window[0][0] + span - 1)
    return out


class Templates:
    """Token sets of the templates, rarest token first, and the index of their prefixes.

    A text that holds at least ``need`` of a template's n tokens holds one of its first n - need + 1.
    """

    def __init__(self, templates: dict[str, str], threshold: float, frequency: dict[bytes, int]):
        self.index: dict[bytes, list[tuple[str, int]]] = {}
        self.tokens: dict[str, tuple[list[bytes], int, int]] = {}
        for label, text in templates.items():
            words = lines_of(text).split()
            tokens = sorted(set(words), key=lambda t: (frequency.get(t, 0), t))
            need = max(1, math.ceil(threshold * len(tokens) - 1e-9))
            self.tokens[label] = tokens, need, len(words)
            for at, token in enumerate(tokens[: len(tokens) - need + 1]):
                self.index.setdefault(token, []).append((label, at))

    def candidates(self, own: set[bytes]) -> list[str]:
        """Templates of which the words of a whole text hold the threshold's share."""
        first: dict[str, int] = {}
        for token in self.index.keys() & own:
            for label, at in self.index[token]:
                first[label] = min(at, first.get(label, at))
        found = []
        for label, at in first.items():
            tokens, need, _ = self.tokens[label]
            # Length filter: the text is long enough.  Positional filter: no token before ``at`` is there.
            if len(own) >= need and len(tokens) - at >= need and sum(t in own for t in tokens[at:]) >= need:
                found.append(label)
        return sorted(found)

    def blocks(self, words: list[bytes], ends: list[int], labels: list[str]) -> list[tuple[int, str, float]]:
        """(line, label, containment) of each block; ``ends`` are the running counts of words by line."""
        wanted = {t for label in labels for t in self.tokens[label][0]}
        places = [(i, w) for i, w in enumerate(words) if w in wanted]
        line = lambda i: bisect_right(ends, i)
        out = []
        for label in labels:
            tokens, need, length = self.tokens[label]
            mine = [x for x in places if x[1] in tokens]
            first = runs(mine, need, len(tokens), length)
            found, starts = list(first), [a for a, *_ in first]
            for _, own in groupby(mine, lambda x: line(x[0])):
                for x in runs(list(own), need, len(tokens), SPAN * length):
                    at = bisect_right(starts, x[1]) - 1
                    if at < 0 or first[at][1] < x[0]:  # else it is found over line ends
                        found.append(x)
            out += [(line(i), label, n / len(tokens)) for i, _, n in found]
        return sorted(out)


def token_frequencies(docs: DataFrame, templates: dict[str, str]) -> dict[bytes, int]:
    """In how many lines of all documents each template token stands; one row per token and task is shuffled."""
    wanted = {t for text in templates.values() for t in lines_of(text).split()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                whole = lines_of(text)
                if wanted & set(whole.split()):
                    for line in whole.split(b"\n"):
                        seen.update(wanted & set(line.split()))
        yield pa.RecordBatch.from_pydict({"token": pa.array([t.decode() for t in seen], pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = texts(docs).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {r.token.encode(): r.n for r in counted.collect()}  # at most one row per template token


_PLACES = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, blocks array<struct<line:long,label:string,containment:double>>"
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())),
    ("blocks", pa.list_(pa.struct([("line", pa.int64()), ("label", pa.string()), ("containment", pa.float64())]))),
])


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its words, the places of ``phrases`` and the blocks that match a template.

    A block is a run of consecutive words: as many as the template has over line ends, or up to SPAN times
    as many inside one line.  It matches when it holds at least ``threshold`` of a template's distinct words, and its line is that of
    its first word.  The join is exact: template words are ordered by their frequency in all lines of the
    table (counted in a pass of its own), and a text's windows are counted only for templates of which it
    holds one of the rare prefix words, after length and positional filters.  The templates are a fixed small set, so they go to every task and no
    text is shuffled.  ``phrases`` are words that stand consecutively, also over line ends; first_word and
    last_word are null without one.  Null and empty texts have no words; repeated rows and a null doc_id
    each keep their row; an empty table gives no rows.
    """
    ordered = Templates(templates, threshold, token_frequencies(docs, templates))
    names = {p.encode(): label for p, label in phrases.items()}
    places = re.compile(b"(?<= )(?:" + b"|".join(map(re.escape, sorted(names))) + b")(?= )")
    starts = {p.split(b" ")[0] for p in names}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                whole = lines_of(text)
                words = whole.split()
                own, n, first, last, labels, blocks = set(words), 0, None, None, set(), []
                if starts & own:
                    joined, at, word = b" " + b" ".join(words) + b" ", 1, 0
                    for m in places.finditer(joined):
                        word += joined.count(b" ", at, m.start())
                        at = m.start()
                        n, first, last = n + 1, word if first is None else first, word
                        labels.add(names[m[0]])
                if ordered.index.keys() & own and (near := ordered.candidates(own)):
                    ends = list(accumulate(len(line.split()) for line in whole.split(b"\n")))
                    blocks = [{"line": i, "label": label, "containment": share} for i, label, share in ordered.blocks(words, ends, near)]
                rows.append((doc, len(words), n, first, last, sorted(labels), blocks))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    return texts(docs, F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(run, _PLACES)


def labelled(scanned: DataFrame) -> DataFrame:
    """Labels as sorted comma-joined text, and a score: 1 with a phrase, else the largest containment."""
    every = F.array_sort(F.array_distinct(F.concat("base_labels", F.col("blocks.label"))))
    best = F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"), F.size("blocks").cast("long").alias("n_blocks"))
