import random
import re

from tessera.llm import licenses as lc

SCHEMA = "doc_id long, text string, labels string, token int"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(text):
    """Base columns by looking at every place; labels and score by comparing every block with every template."""
    w, base, places, labels, score = words(text), set(), [], set(), 0.0
    for phrase, label in lc.PHRASES.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                places.append(k)
                base.add(label)
                score = 1.0
    for b in range(0, max(1, len(w)), lc.SHORTEST):
        block = set(w[b : b + 2 * lc.SHORTEST])
        for t, label in lc.TEMPLATES.items():
            s = set(words(t))
            share = len(s & block) / len(s)
            if share >= lc.SHARE - 1e-9:
                labels.add(label)
                score = max(score, share)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score


def corpus(seed):
    rng = random.Random(seed)
    common = ["the", "of", "license", "to", "under", "mit", "apache", "cc", "by", "nc", "version", "2", "4", "0", "and", "software", "Über", "x1"]
    rows = []
    for i in range(200):
        w = [rng.choice(common) for _ in range(rng.randint(0, 150))]
        for _ in range(rng.randint(0, 3)):
            t = rng.choice([*lc.TEMPLATES, *lc.PHRASES]).split()
            if rng.random() < 0.5:
                t = [x for x in t if rng.random() < 0.9]
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() if rng.random() < 0.2 else x for x in t]
        rows.append((i, "".join(x + rng.choice([" ", ", ", "\n", "-"]) for x in w)))
    return rows


def test_as_brute_force(spark):
    rows = corpus(1)
    got = lc.license_scan(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = dict(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(by[r.doc_id])


def test_finds_the_usual_lines(spark):
    lines = {"Licensed under the Apache License, Version 2.0.": "apache-2", "Released under the MIT License.": "mit", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "This work is licensed under the GNU General Public License, version 3.": "gpl-3"}
    rows = [(i, f"Some text. {t} More text.", None, None) for i, t in enumerate(lines)]
    got = lc.license_scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.doc_id: r.labels for r in got} == dict(enumerate(lines.values()))


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "- . -"), (4, "under the mit license"), (4, "under the mit license"), (None, "x"), (5, "the " * 100_000 + "under the MIT license")]
    got = lc.license_scan(spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == brute(dict(rows)[r.doc_id])
    assert lc.license_scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_templates_of_any_length(spark):
    rng = random.Random(3)
    full = [f"clause{i}" for i in range(300)]
    some = [w for w in full if rng.random() < 0.9]
    half = full[:150]
    filler = ["the", "of"] * 500
    rows = [(1, " ".join(filler + full + filler)), (2, " ".join(filler + some + filler)), (3, " ".join(half)), (4, " ".join(filler))]
    got = lc.license_scan(spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA), templates={" ".join(full): "long", "clause1 clause2 clause3": "short"}).collect()
    assert {r.doc_id: r.labels for r in got} == {1: "long,short", 2: "long,short" if {"clause1", "clause2", "clause3"} <= set(some) else "long", 3: "short", 4: ""}
    assert {r.doc_id: r.score for r in got}[1] == 1.0
