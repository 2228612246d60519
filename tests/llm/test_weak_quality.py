import random

import numpy as np

from tessera.llm import weak_quality as wq


def clean(rng, n):
    out = []
    for _ in range(n):
        out.append("".join(rng.choice(["an", "the", "er", "in", "ou", "st", "ble", "re"]) for _ in range(rng.randint(1, 4))))
        if rng.random() < 0.1:
            out[-1] += "."
    return " ".join(out) + "."


def spoil(rng, text):
    words = text.split()
    return rng.choice([
        lambda: " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in words), lambda: " ".join(w.upper() + "!!" for w in words),
        lambda: " | ".join(words), lambda: " ".join(w for w in words[:5] for _ in range(30)),
    ])()


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = clean(rng, rng.randint(30, 200))
        bad = rng.random() < 0.2
        rows.append((i, spoil(rng, text) if bad else text, int(not bad)))
    return rows


def test_finds_the_spoilt(spark):
    rows = corpus(800, 1)
    got = {r.doc_id: r for r in wq.quality(spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows], "doc_id long, text string, votes string, score double")).collect()}
    assert len(got) == len(rows)
    y = np.array([q for _, _, q in rows])
    kept = np.array([got[i].kept for i, _, _ in rows])
    assert (kept == y).mean() > 0.95 and kept[y == 1].mean() > 0.97
    assert all(len(r.votes) == len(wq.LABELLERS) for r in got.values())


def test_estimates_accuracies():
    """Votes drawn from known rates are estimated back."""
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    rates = np.array([[0.9, 0.98], [0.7, 0.99], [0.8, 0.97], [0.6, 0.995]])
    votes = np.stack([np.where(rng.random(len(good)) < np.where(good, s, b), good, ~good).astype(int) for b, s in rates], axis=1)
    votes[rng.random(votes.shape) < 0.1] = wq.ABSTAIN
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    fit = wq.estimate(patterns, counts)
    assert abs(fit.good - 0.8) < 0.02 and np.abs(fit.accuracy() - rates).max() < 0.04


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "Word."), (4, "Word."), (None, "A few plain words here."), (5, "plain words run on. " * 20_000)]
    got = wq.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].votes == by[2].votes == by[3].votes
    assert wq.quality(spark.createDataFrame([], "doc_id long, text string")).collect() == []
