"""License scan, quality, toxicity, line dedup and the Jaccard join against brute force."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetide import session
from kinetide.llm import graph, jaccard, licenses, lines, quality, toxicity

# ---- licenses ----

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_licenses(text):
    text = (text or "").translate(LOWER)
    words = WORD.findall(text)
    places = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    blocks = []
    for i, line in enumerate(text.split("\n")):
        have = set(WORD.findall(line))
        for label, t in licenses.TEMPLATES.items():
            want = set(WORD.findall(t))
            if len(want & have) >= licenses.THRESHOLD * len(want) - 1e-9:
                blocks.append((i, label))
    at = [i for i, _ in places]
    return len(words), len(at), at[0] if at else None, at[-1] if at else None, ",".join(sorted({x for _, x in places})), ",".join(sorted({x for _, x in places} | {x for _, x in blocks})), sorted(blocks)


def test_licenses_equal_brute_force(spark, make, words):
    rng, notes = random.Random(2), [*licenses.TEMPLATES.values(), "CC BY", "all rights\nreserved", "cc by cc-by CC_BY", "General Public License", "ccby", "é CC BYé cc by", "İ CC BY"]
    texts = [None, "", "\n", "CC BY", "CC BY"]
    for i in range(200):
        parts = words(rng.randint(0, 30), i)
        note = rng.choice(notes).split(" ")
        if rng.random() < 0.5:
            rng.shuffle(note)
        if rng.random() < 0.3:
            note = note[:-1]
        at = rng.randint(0, len(parts))
        texts.append(rng.choice([" ", "\n", ", "]).join(parts[:at]) + rng.choice(["\n", " "]) + rng.choice([" ", "-"]).join(note) + "\n" + " ".join(parts[at:]))
    scanned = licenses.scan(make(list(enumerate(texts))).withColumn("n_base", F.lit(9)))
    blocks = {r.doc_id: sorted((b.line, b.label) for b in r.blocks) for r in scanned.collect()}
    rows = licenses.labelled(scanned).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_licenses(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, blocks[r.doc_id]) == want, texts[r.doc_id]
        assert 0 <= r.score <= 1
    assert licenses.scan(make([])).count() == 0


def test_license_windows_equal_brute_force(spark, make, words):
    want = {label: t.split() for label, t in licenses.TEMPLATES.items()}
    bsd, mit, cc = want["bsd"], want["mit"], want["cc-by-sa"]
    texts = [
        " ".join(bsd[:12]) + "\n" + " ".join(bsd[12:]), "a\n" + "\n".join(mit) + "\nb", " ".join(mit) + "\n" + " ".join(mit),
        " ".join(x for w in mit for x in [w, *words(40, len(w))]),  # one line, scattered words
        " ".join([*words(3000, 5), *mit[:3], *words(3000, 6), *mit[3:], *words(3000, 7)]), " ".join([*words(3000, 5), *cc, *words(3000, 6)])]
    rng, pool = random.Random(3), sorted({w for t in want.values() for w in t})
    for i in range(300):
        own = rng.choices(pool, k=rng.randint(0, 50)) + words(rng.randint(0, 50), i)
        rng.shuffle(own)
        for _ in range(rng.randint(0, 3)):
            note, at = list(rng.choice(list(want.values()))), rng.randint(0, len(own))
            for _ in range(rng.randint(0, 3)):
                note.insert(rng.randint(0, len(note)), rng.choice(["x", "the", "under"]))
            own[at:at] = note[: rng.randint(len(note) - 1, len(note))]
        texts.append("".join(w + rng.choice([" ", " ", "\n"]) for w in own))
    rows = {r.doc_id: r for r in licenses.scan(make(list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        own, labels = text.split(), set()
        for label, t in want.items():
            parts = [(own, len(t)), *((line.split(), licenses.SPAN * len(t)) for line in text.split("\n"))]
            if any(len(set(t).intersection(x[j : j + n])) >= licenses.THRESHOLD * len(set(t)) - 1e-9 for x, n in parts for j in range(len(x))):
                labels.add(label)
        assert {b.label for b in rows[i].blocks} == labels, text
    blocks = [[(b.line, b.label, b.containment) for b in rows[i].blocks] for i in range(6)]
    assert blocks[:5] == [[(0, "bsd", 1.0)], [(1, "mit", 1.0)], [(0, "mit", 1.0), (1, "mit", 1.0)], [], []] and blocks[5] == [(0, "cc-by-sa", 1.0)]


# ---- quality ----


def test_smoothed_model_is_a_distribution_and_equals_a_direct_sum(spark, make, words):
    texts = [" ".join(words(60, i)) for i in range(6)] + ["", "É 1!"]
    docs = make(list(enumerate(texts))).select("doc_id", "text")
    counts = quality.trusted_counts(docs, docs.select("doc_id"))
    model = quality.Model(counts)
    p = np.exp(model.log_table().astype(float)).reshape(-1, 64)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    # The same model with dictionaries.
    seen = {}
    for t in texts:
        s = (0, 0, 0, *quality.letters_of(t).tolist())
        for i in range(3, len(s)):
            seen[s[i - 3 : i + 1]] = seen.get(s[i - 3 : i + 1], 0) + 1
    assert {(r.code, r.n) for r in counts.collect()} == {(((a * 64 + b) * 64 + c) * 64 + d, n) for (a, b, c, d), n in seen.items()}
    orders = [seen]
    for _ in range(3):
        lower = {}
        for g in orders[0]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        orders.insert(0, lower)

    def discounts(table):
        n = [sum(v == k for v in table.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        return [min(k, max(0.1, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 * k for k in (1, 2, 3)]

    def prob(g):
        if not g:
            return 1 / 64
        table = orders[len(g) - 1]
        d = discounts(table)
        under = {h: n for h, n in table.items() if h[:-1] == g[:-1]}
        if not under:
            return prob(g[1:])
        total, cut = sum(under.values()), lambda n: d[min(n, 3) - 1]
        return (max(under[g] - cut(under[g]), 0) / total if g in under else 0) + sum(map(cut, under.values())) / total * prob(g[1:])

    rng = random.Random(1)
    for g in rng.sample(sorted(seen), 20) + [tuple(rng.randrange(64) for _ in range(4)) for _ in range(20)]:
        code = ((g[0] * 64 + g[1]) * 64 + g[2]) * 64 + g[3]
        assert p.ravel()[code] == pytest.approx(prob(g), rel=1e-3)


def test_junk_goes_and_prose_stays(spark, make, words):
    good = [(i, " ".join(words(80, i)) + ".") for i in range(150)]
    junk = [(1000 + i, " ".join(w.upper() + "##" for w in words(80, i))) for i in range(20)]
    odd = [(2000, None), (2001, ""), (None, "the " * 3), (2003, " ".join(words(20_000, 3)))]
    docs = make(good + junk + odd + good[:1])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(1000, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.judge(docs.withColumn("logp", F.lit(1)), labels).collect()
    assert len(rows) == 150 + 20 + 4 + 1
    verdict = {}
    for r in rows:
        verdict.setdefault(r.doc_id, set()).add(r.accepted)
    assert sum(verdict[i] == {1} for i in range(150)) >= 146 and all(verdict[i] == {0} for i in range(1000, 1020))
    assert verdict[2000] == verdict[2001] == verdict[2003] == {1}
    kept = quality.Filter(docs, labels).accepted(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.accepted)
    none = labels.where("false")
    assert {r.accepted for r in quality.judge(docs, none).collect()} == {1} and quality.Filter(docs, none).accepted(docs).count() == 175
    assert quality.judge(make([]), labels).count() == 0 and quality.Filter(make([]), labels).accepted(make([])).count() == 0


def test_model_of_code_points_equals_a_direct_sum(spark, make, words):
    texts = [" ".join(words(40, i)) for i in range(4)] + ["", "É 1!", "привет, мир 😀😁", "пример 漢字漢\x00"]
    docs = make(list(enumerate(texts))).select("doc_id", "text")
    counts = quality.trusted_letters(docs, docs.select("doc_id"))
    seen = {}
    for t in texts:
        for i in range(len(t)):
            g = ("\n\n\n" + t)[i : i + 4]
            seen[g] = seen.get(g, 0) + 1
    code = lambda g: b"".join(ord(c).to_bytes(3, "big") for c in g)
    assert {(bytes(r.code), r.n) for r in counts.collect()} == {(code(g), n) for g, n in seen.items()}
    orders = [seen]
    for _ in range(3):
        lower = {}
        for g in orders[0]:
            lower[g[1:]] = lower.get(g[1:], 0) + 1
        orders.insert(0, lower)

    def prob(g):
        if not g:
            return 1 / (len(orders[0]) + 1)
        table = orders[len(g) - 1]
        n = [sum(v == k for v in table.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [min(k, max(0.1, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 * k for k in (1, 2, 3)]
        under = {h: m for h, m in table.items() if h[:-1] == g[:-1]}
        if not under:
            return prob(g[1:])
        total, cut = sum(under.values()), lambda m: d[min(m, 3) - 1]
        return (max(under[g] - cut(under[g]), 0) / total if g in under else 0) + sum(map(cut, under.values())) / total * prob(g[1:])

    rng, letters = random.Random(1), sorted(orders[0]) + ["z", "ж", "漢"]
    some = {*rng.sample(sorted(seen), 20), *("".join(rng.choices(letters, k=4)) for _ in range(20))}
    asked = spark.createDataFrame([(bytearray(code(g)), g) for g in some], "code binary, g string")
    got = {r.g: r.logp for r in quality.Letters(counts).log_probability(asked).collect()}
    assert got.keys() == some and all(np.exp(got[g]) == pytest.approx(prob(g), rel=1e-9) for g in some)


def test_letters_are_themselves_whatever_their_script(spark, make, words, monkeypatch):
    shifted = lambda text, by: "".join(chr(0x430 + (ord(c) - 97) + by) if c.isalpha() else c for c in text.lower())
    good = [(i, shifted(" ".join(words(80, i)), 0)) for i in range(150)]
    # Each letter four code points on: all other letters, or the same ones in other places.
    other = [(1000 + i, shifted(" ".join(words(80, i)), 4)) for i in range(20)]
    odd = [(2000, None), (None, good[0][1]), (None, other[0][1]), good[3], (2001, "😀" * 400), (2002, "\x00" * 400)]
    docs = make(good + other + odd)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    rows = quality.judge(docs, labels).collect()
    of = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert len(rows) == 176 and sum(of[i].accepted for i in range(150)) >= 145
    assert not any(of[i].accepted for i in (*range(1000, 1020), 2001, 2002)) and of[2000].accepted
    assert sorted(r.accepted for r in rows if r.doc_id is None) == [0, 1]
    kept = quality.Filter(docs, labels).accepted(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in rows if r.accepted)
    # What is joined scores as what is looked up.
    monkeypatch.setattr(quality, "COMMON", 5)
    again = {r.doc_id: r for r in quality.judge(docs, labels).collect() if r.doc_id is not None}
    assert all(again[i].perplexity == pytest.approx(r.perplexity, rel=1e-9) and again[i].accepted == r.accepted for i, r in of.items())


def test_numbers_of_letters_with_very_many_kinds():
    points = np.random.default_rng(1).integers(0x20000, 0x30000, 100_000).astype(np.uint32)
    points[5000:5010] = points[:10]
    number = quality.numbered(points)
    assert len(number) == len(points) - 3 and (number[5000:5007] == number[:7]).all()
    assert len(np.unique(number)) == len(np.unique(np.stack([points[i : len(points) - 3 + i] for i in range(4)], axis=1), axis=0))


def test_only_texts_in_pairs_travel(spark, make, words):
    docs = make([(i, " ".join(words(30, i))) for i in range(300)] + [(None, "no id"), (-5, "under zero"), (7, "again"), (1 << 62, "high")]).select("doc_id", "text")
    some = [*range(0, 40, 3), 7, -5, 1 << 62, 12345]
    ids = spark.createDataFrame([(i,) for i in some], "doc_id long")
    for size in (1, 1 << 20):
        kept = [r.doc_id for r in jaccard.marked(docs, ids, size).collect()]
        inside = [i for i in kept if i in some]
        assert sorted(inside) == sorted(i for i in [*range(300), -5, 7, 1 << 62] if i in some) and None not in kept
        assert len(kept) == len(inside) if size > 1 else len(kept) >= len(inside)
    assert jaccard.marked(docs, ids.where("false")).count() == 0


def test_only_marked_rows_meet_the_keys(spark):
    """A semi-join behind the marks is taken before them, and then all texts travel."""
    docs = spark.range(300).selectExpr("id as doc_id", "'text' as text")
    ids = spark.createDataFrame([(i,) for i in (3, 5, 299, 700)], "doc_id long")
    out = jaccard.having(docs, ids)
    assert sorted(map(tuple, out.collect())) == [(3, "text"), (5, "text"), (299, "text")]
    assert "LeftSemi" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_open_tiles_are_those_of_several_components(spark):
    rng = random.Random(5)
    tiles = {sig: sorted(rng.sample(range(40), rng.randint(2, 6))) for sig in range(60)}
    component = {d: d % 3 for d in range(3, 24)}  # others are a component of their own
    shared = spark.createDataFrame([(s, d, min(t)) for s, t in tiles.items() for d in t], "sig long, doc long, u long")
    met = shared.where("doc > u").select("u", "doc").distinct()
    found = spark.createDataFrame(list(component.items()), "node long, component long")
    out = jaccard.open_tiles(shared, met, found).select("sig", "doc", "u", "component", "n")
    want = []
    for s, t in tiles.items():
        own = [component.get(d, d) for d in t]
        want += [(s, d, min(t), c, len(t)) for d, c in zip(t, own, strict=True) if len(set(own)) > 1]
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_most_met_is_the_head_of_the_order(spark):
    rng = random.Random(3)
    rows = [(bytes([i // 256, i % 256]), rng.choice([1, 1, 2, 3, 3, 9, 17, 300]), -float(i)) for i in range(600)]
    known = spark.createDataFrame(rows, "code binary, n long, logp double")
    for most in (1, 37, 300, 599, 600, 1000):
        want = sorted((bytes(c), p) for c, n, p in sorted(rows, key=lambda r: (-r[1], r[0]))[:most])
        assert sorted((bytes(r.code), r.logp) for r in quality.most_met(known, most).collect()) == want


# ---- toxicity ----


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance(words):
    rng = random.Random(4)
    terms = ["idiot", "moron", "worthless", "scum", "disgusting", "vequ*", "stupid", "stud"]
    automaton = toxicity.Automaton(terms)
    pool = [t.rstrip("*") for t in terms] + words(200, 1)
    for _ in range(3000):
        w = list(rng.choice(pool))
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(w))
            w[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "o", "7", "x"])
        w = "".join(w)
        want = {}
        for t in terms:
            if t.endswith("*"):
                if w.startswith(t[:-1]):
                    want[t] = 0
            elif distance(w, t) <= toxicity.edits_of(len(t)):
                want[t] = distance(w, t)
        got = automaton.match(w)
        assert dict(got) == want and len(got) == len(want), w


def test_learned_terms_misspellings_and_quotation(spark, make, words):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        w, toxic = words(60, i), int(i % 5 == 0)
        if toxic:
            for t in rng.sample(["gruntlow", "snarkfeld", "blorby"], 2):
                w.insert(rng.randint(0, 50), t)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    tests = [(9001, "you gruntl0w fool"), (9002, "plain words here"), (9003, 'he wrote "gruntlow" in a note'), (9004, None), (9005, ""), (None, "snarkfeld blorby")]
    docs = make(rows + tests + rows[:1])
    known = spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs.withColumn("toxic", F.lit(1)), known)
    assert {"gruntlow", "snarkfeld", "blorby"} <= set(model["lexicon"])
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((score[i] >= 0.7) == (i % 5 == 0) for i in range(600))
    assert score[9002] < 0.2 and score[9004] == score[9005] < 0.2 and score[None] > 0.9 and score[9003] < score[0]
    kept = toxicity.without_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in score.items() if s < 0.7}
    # Held-out labels are never read.
    turned = known.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, turned) == model
    assert toxicity.fit(docs, known.where("false"))["terms"] == {} and toxicity.score(make([]), model).count() == 0


def test_a_clean_word_among_many_neighbouring_terms(spark, make, words):
    """Words built on one beginning speak for each other by that beginning once; words near them are clean."""
    rng, rows, labels = random.Random(8), [], []
    ends = "a e i o u ba re ti mo ku".split()
    for i in range(1500):
        toxic = int(i % 6 == 0)
        w = words(60, i) + (["gruvelt" + e for e in rng.sample(ends, 4)] if toxic else [])
        if i % 3 == 1:
            w.append(rng.choice(["ruvelta", "gruveta", "gruvelto"[:6], "ruveltba", "gruveltt"[1:]]))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    clean = "ruvelta gruveta grvelti truvelte gruvelu"
    tests = [(9001, " ".join(words(50, 1)) + " " + clean), (9002, " ".join(words(50, 2)) + " gruvelta gruveltba gruveltku"), (9003, clean.split()[0])]
    docs = make(rows + tests)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len([t for t in model["lexicon"] if t.startswith("gruv")]) >= 10
    score = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert score[9001] < 0.1 and score[9003] < 0.1 and score[9002] > 0.9
    finder = toxicity.finder_of(model)
    one = toxicity.sums(finder, model, "gruvelta")[0]
    assert one == max(w for t, w in model["terms"].items() if t == "gruvelta 0") and toxicity.sums(finder, model, "gruvelta gruvelta")[0] == one


def test_every_significant_term_is_kept_and_copies_count_once(spark, make, words):
    ids = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 3 != 1]
    marks = [f"q{a}{b}zz{a}{b}x" for a in "abcdefghijklmnop" for b in "abcdefghij"]  # 160 words, each with its beginnings
    rows, labels = [], []
    for i, doc in enumerate(ids[:1600]):
        toxic = int(i % 4 == 0)
        rows.append((doc, " ".join(words(30, i) + ([marks[(i // 4 + k) % len(marks)] for k in range(32)] if toxic else []))))
        labels.append((doc, 1, toxic))
    copied = "rarely seen " + " ".join(words(20, 99_999))
    rows += [(doc, copied) for doc in ids[1600:1800]]
    labels += [(doc, 1, 1) for doc in ids[1600:1800]]
    model = toxicity.fit(make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(model["lexicon"]) > 512 and set(marks) <= set(model["lexicon"])
    assert not {"rarely", "seen"} & set(model["lexicon"])


# ---- lines ----


def brute_lines(rows, min_sites):
    sites, site_of = {}, {}
    for _, text, source in rows:
        site_of[text or ""] = min(source or "", site_of.get(text or "", source or ""))
    for text, site in site_of.items():  # a text copied to many sites is one text
        for x in text.split("\n"):
            if x.strip(" "):
                sites.setdefault(x.strip(" "), set()).add(site)
    out = []
    for doc, text, _ in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        all_, kept = text.split("\n"), [x for x in text.split("\n") if not x.strip(" ") or len(sites[x.strip(" ")]) < min_sites]
        if not "".join(kept).strip(" "):
            kept = all_
        out.append((doc, "\n".join(kept), len(all_), len(all_) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_sites", [1, 3, 6])
def test_lines_equal_brute_force(spark, make, words, min_sites):
    rng, rows = random.Random(9), []
    common = [f"common {i} {words(1, i)[0]}" for i in range(12)]
    for i in range(150):
        parts = [" ".join(words(12, 100 * i + j)) for j in range(rng.randint(0, 5))] + rng.sample(common, rng.randint(0, 3)) + [" ", ""][: rng.randint(0, 2)]
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts), rng.choice([None, "a", "b", "c", "d", "e", "f", "g"])))
    rows += [(500, None, "a"), (501, "", "a"), (502, common[0], "b"), (None, common[0] + "\n" + " ".join(words(30, 1)), "c"), (None, None, "c"), rows[3], rows[3], (503, "x y\n" * 3000, "a")]
    rows += [(600 + i, "a copied page\nof two lines", s) for i, s in enumerate("abcdefg")] + [(610, "a copied page\nand its own end", "g")]
    docs = make(rows).withColumn("n_lines", F.lit("mine")).withColumns({c: F.lit(1) for c in ("row", "cut", "lines", "kept", "doc", "line", "site", "_of_doc_id")})
    got = lines.without_boilerplate(docs, min_sites=min_sites).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=str) == brute_lines(rows, min_sites)


def test_the_stage_cuts_short_pages_and_copies_of_them(spark, make, words):
    """A passage on 12 sites goes from every page that has anything else; a page copied to 12 sites stays."""
    import corpus_pipeline

    passage = " ".join(words(40, 3))
    rows = [(i, f"own {i}\n{passage}", f"s{i}") for i in range(12)]
    rows += [(20, f"copied\n{passage}", "s1"), (21, f"copied\n{passage}", "s2"), (22, f"\n{passage}\n ", "s1"), (23, None, "s1"), (None, f"null\n{passage}", "s1"), (None, f"other\n{passage}", "s1")]
    rows += [(30 + i, "page of one author\non every site", f"s{i}") for i in range(12)]
    docs = make(rows)
    out = corpus_pipeline.line_dedup(spark, docs, "")
    want = {(i, t if i in (22, 23) or (i or 0) >= 30 else t.split("\n")[0]) for i, t, _ in rows}
    got = out.collect()
    assert out.columns == docs.columns and len(got) == len(rows) and {(r.doc_id, r.text) for r in got} == want
    assert all(r.n_chars == len(r.text or "") for r in got)
    assert not any(passage in (r.text or "") for r in got if r.doc_id != 22)


def test_sketches_merge_and_empty(spark, make):
    parts = [make([(i, "one line", f"s{i}")]) for i in range(7)]
    both = lines.merged(*[lines.sketches(p, min_sites=1) for p in parts])
    assert both.select(F.hll_sketch_estimate("sketch").alias("n")).first().n == 7
    assert lines.without_boilerplate(make([])).count() == 0


# ---- Jaccard join ----


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute_components(rows):
    sets = [(d, sets_of(t)) for d, t in rows]
    up = {d: d for d, _ in rows if d is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in sets), key=str)


@pytest.mark.parametrize("tile", [2048, 3])
def test_components_equal_brute_force(spark, make, words, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "HUB", 4)
    monkeypatch.setattr(jaccard, "TOGETHER", 30 * tile)
    rng, rows = random.Random(11), []
    for family in range(22):
        base = words(rng.choice([5, 9, 14, 25, 40, 80, 160, 700]), 1000 + family)
        for _ in range(rng.randint(1, 8)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, len(w) // 30])):
                i = rng.randrange(len(w))
                w[i : i + rng.randint(0, 2)] = words(rng.randint(0, 2), rng.random())
            if rng.random() < 0.3:
                w += words(max(1, len(w) // 25), rng.random())
            rows.append((len(rows) + 1, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one TWO"), (905, "one two three four"), (906, "one"), (None, rows[0][1]), (None, None), (907, " ".join(words(9000, 77))), (908, " ".join(words(9000, 77)[:-40])), rows[2]]
    got = jaccard.join(make(rows, 5).withColumn("u", F.lit(1))).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute_components(rows)
    kept = [r.doc_id for r in jaccard.one_of_each(make(rows, 5)).collect()]
    assert sorted(map(str, kept)) == sorted([str(d) for d in {r[2] for r in brute_components(rows) if r[0] is not None}] + ["None", "None"])


def test_meeting_pairs_equal_brute_force():
    rng = np.random.default_rng(3)
    for n in (2, 5, 40, 300):
        component = rng.integers(0, max(2, n // 3), n)
        tiles = [np.sort(rng.choice(n, int(rng.integers(1, min(n, 25) + 1)), replace=False)) for _ in range(60)]
        want = sorted({(int(min(p, q)), int(max(p, q))) for t in tiles for p in t for q in t if component[p] != component[q]})
        for limits in ((10**9, 1), (0, 10**9), (0, 3 * n), (0, 1), (7, 10**6)):
            i, j = jaccard.meeting(tiles, component, *limits)
            assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_a_null_id_stands_for_no_copy(spark, make, words):
    text = " ".join(words(30, 1))
    got = {(r.doc_id, r.component_id) for r in jaccard.join(make([(None, text), (8, text), (5, text), (9, text + " tail")], 1)).collect()}
    assert got == {(None, None), (8, 5), (5, 5), (9, 5)}


def test_copies_of_all_partitions_are_signed_once(spark, make, words, monkeypatch):
    """Each copy would put its id into all tiles of its set."""
    rows = {}

    def counted(df, name, *by):
        out = session.staged(df, name, *by)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(jaccard, "staged", counted)
    docs = make([(100 * copy + i, " ".join(words(60, i))) for copy in range(8) for i in range(6)], 8)
    got = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    assert got == {100 * copy + i: i for copy in range(8) for i in range(6)} and rows["jaccard-tiles"] == 0


def test_an_id_is_signed_for_each_of_its_sets(spark, make, words):
    a, b = (" ".join(words(60, i)) for i in range(2))
    got = {(r.doc_id, r.component_id) for r in jaccard.join(make([(4, a), (4, b), (8, a + " tail"), (9, b + " tail")], 1)).collect()}
    assert got == {(4, 4), (8, 4), (9, 4)}


def test_only_kept_documents_travel(spark, make, words):
    docs = make([(i, " ".join(words(30, i % 50))) for i in range(200)])
    out = jaccard.one_of_each(docs.select("doc_id", "text", F.col("doc_id").cast("int").alias("n")).withColumn("doc_id", F.col("n")).drop("n"))
    assert sorted(r.doc_id for r in out.collect()) == list(range(50))
    assert "LeftSemi" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_the_stage_joins_pairs_between_both_measures(spark, make):
    import corpus_pipeline

    base = [f"w{i}" for i in range(50)]
    near = base[:25] + ["other"] + base[26:]  # one of 50 words: 43 of 51 runs of 4 words, 41 of 51 runs of 5
    far = base[:15] + ["other"] + base[16:35] + ["another"] + base[36:]
    docs = make([(3, " ".join(base)), (7, " ".join(near)), (9, " ".join(far))])
    assert {r.doc_id: r.component_id for r in jaccard.join(docs).collect()} == {3: 3, 7: 7, 9: 9}
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [3, 9]


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(5)
    for n in [1, 2, 5, 6, 7, 12, 13, 30, 100, 500, 3000]:
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            gone = int(rng.integers(0, max(1, int(0.16 * n)) + 1))
            y = np.unique(np.concatenate([rng.choice(x, len(x) - gone, replace=False), rng.integers(0, 2**64, int(rng.integers(0, 0.1 * n + 1)), dtype=np.uint64)]))
            if len(y) and jaccard.linked(x, y):
                assert np.intersect1d(jaccard.signatures(x), jaccard.signatures(y)).size


def test_no_rows_and_paths(spark, make):
    assert jaccard.join(make([])).count() == 0 and jaccard.one_of_each(make([])).count() == 0
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7), (101, 100)], "u long, v long")
    got = {r.node: r.component for r in graph.components(pairs).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100}
    assert graph.components(pairs.where("false")).count() == 0
