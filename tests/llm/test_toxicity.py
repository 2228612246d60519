import random
import zlib

import numpy as np

from tessera.llm import toxicity as tx

INSULTS = ["vilebag", "grotface", "scumlord", "twitbrain"]


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "the", "er", "in", "ou", "st", "ble", "re"]) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(20, 200))]
        bad = rng.random() < 0.25
        if bad:
            for _ in range(max(2, len(w) // 30)):
                w[rng.randrange(len(w))] = rng.choice(INSULTS)
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = tx.fit_on(docs, labels)
    got = {r.doc_id: r for r in tx.toxicity(docs, model).collect()}
    assert len(got) == len(rows)
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in held) and sum(r.held_out for r in got.values()) == len(held)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())
    assert np.mean([r.predicted == y for r, y in held]) > 0.93
    kept = {r.doc_id for r in tx.drop_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}
    assert tx.drop_toxic(docs, model).columns == docs.columns


def test_held_out_labels_change_nothing(spark):
    rows = corpus(200, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = lambda i, y: 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y
    a = tx.fit_on(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = tx.fit_on(docs, spark.createDataFrame([(i, flip(i, y)) for i, _, y in rows], "doc_id long, toxic int"))
    assert a.toxic == b.toxic and (a.weights == b.weights).all()


def test_edges(spark):
    rows = corpus(100, 3)
    model = tx.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    docs = [(1, None), (2, ""), (3, " \n"), (4, "a"), (4, "a"), (None, "a"), (5, "the an " * 50_000)]
    got = tx.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score == by[3].score and by[4].score == by[None].score and not by[None].held_out
    assert tx.toxicity(spark.createDataFrame([], "doc_id long, text string"), model).collect() == []


def test_one_class_or_no_rows():
    for texts, labels in (([], []), (["a b c"], [0]), (["a b c", None], [1, 1])):
        model = tx.fit(texts, labels)
        score = model.scorer().score("some text")
        assert 0 <= score <= 1


def test_words_of_a_toxic_stem_are_caught():
    """No toxic word repeats as a whole: each has the stem and an ending of its own."""
    rng, rows = random.Random(4), corpus(900, 4)
    for k, (i, t, _) in enumerate(rows):
        w = [x for x in t.split() if x not in INSULTS]
        bad = k % 4 == 0
        if bad:
            for _ in range(max(3, len(w) // 30)):
                w[rng.randrange(len(w))] = "lowei" + "".join(rng.choice(["an", "er", "ou", "ble", "st"]) for _ in range(3))
        rows[k] = (i, " ".join(w), int(bad))
    known, held = rows[:700], rows[700:]
    scorer = tx.fit([t for _, t, _ in known], [y for _, _, y in known]).scorer()
    said = [scorer.score(t) >= 0.5 for _, t, _ in held]
    assert np.mean([s for s, (_, _, y) in zip(said, held, strict=True) if y]) > 0.9
    assert np.mean([s for s, (_, _, y) in zip(said, held, strict=True) if not y]) < 0.03


def test_drop_toxic_edges(spark):
    rows = corpus(100, 5)
    model = tx.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    docs = spark.createDataFrame([(1, None, 2.0), (None, "", 3.0), (2, "the an", None)], "doc_id long, text string, __score double")
    assert sorted(map(str, tx.drop_toxic(docs, model).collect())) == sorted(map(str, docs.collect()))
    assert tx.drop_toxic(docs.limit(0), model).collect() == []
