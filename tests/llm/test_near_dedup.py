import random

import pytest

from tessera.llm import near_dedup as nd
from tessera.llm import tables
from tessera.llm.tables import connected

SCHEMA = "doc_id long, text string, component_id string, sig int"


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    """(n_shingles, component) per id, by all pairs."""
    sets = {i: sets_of(t) for i, t in rows}
    label = {i: i for i in sets}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus(seed, n=120):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    bases = [[word() for _ in range(rng.randint(30, 160))] for _ in range(8)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases)) if rng.random() < 0.8 else [word() for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            if w:
                w[rng.randrange(len(w))] = word()
        rows.append((i * 3, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(spark, seed):
    rows = corpus(seed)
    got = nd.near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)).collect()
    want = components(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_tiles_give_the_same(spark, monkeypatch):
    """The exact rest alone, in tiles of three sets, links as all pairs do."""
    rows = corpus(3, 60)
    monkeypatch.setattr(nd, "TILE", 3)
    got = nd.near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == components(rows)


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE  two"), (6, "one two three"), (7, long), (7, long), (8, long + " end"), (None, "one two"), (9, "no break")]
    got = nd.near_duplicates(spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].n_shingles for k in (1, 2, 3, 4, 6, 9)] == [0, 0, 0, 1, 1, 1]
    assert by[5].component_id == 4 and not by[5].kept and by[6].kept
    assert by[8].component_id == 7 and by[7].kept and sum(r.doc_id == 7 for r in got) == 2
    assert by[None].kept and by[None].component_id is None
    assert nd.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_drop_keeps_columns(spark):
    rows = [(1, "a b c d e f", "p", 0), (2, "a b c d e f", "q", 1), (3, "x", None, None)]
    out = nd.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "component_id", "sig"]
    assert sorted(r.doc_id for r in out.collect()) == [1, 3]


@pytest.mark.parametrize("one_task", [0, tables.ONE_TASK])
def test_connected(spark, monkeypatch, one_task):
    monkeypatch.setattr(tables, "ONE_TASK", one_task)
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 360)]
    label = {}
    find = lambda x: x if label.setdefault(x, x) == x else find(label[x])
    for a, b in edges:
        x, y = find(a), find(b)
        label[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_repeated_ids_keep_the_links_of_each_text(spark):
    a, b = (" ".join(f"{k}{n}" for n in range(60)) for k in "ab")
    rows = [(1, a), (1, b), (2, a + " x"), (3, b + " x"), (4, "other words " * 9)]
    got = nd.near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_pairs_under_the_match_threshold_are_not_retained(spark):
    sigs = spark.createDataFrame([(1, list(range(48))), (2, list(range(26)) + [-1] * 22), (3, list(range(25)) + [-1] * 23)], "cls long, sig array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "a long, b long")
    assert {(r.a, r.b) for r in nd._collisions(pairs, sigs).collect()} == {(1, 2), (2, 3)}
