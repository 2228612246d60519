import numpy as np

from tessera.llm import pivots as pv

SCHEMA = "vec_id long, embedding array<float>, rep long, copies int"


def brute(rows):
    x = {i: np.array(v, float) for i, v in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in x.items()}
    label = {i: i for i in x}
    find = lambda i: i if label[i] == i else find(label[i])
    links = dict.fromkeys(x, 0)
    for a in x:
        for b in x:
            if a < b and unit[a] @ unit[b] >= pv.COSINE:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                label[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in x}


def vectors(seed, noise, n=400):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 32))
    rows = []
    for i in range(n):
        v = base[rng.integers(40)] if i % 2 else rng.normal(size=32)
        rows.append((i, np.float32(v + noise * rng.normal(size=32)).tolist()))
    return rows


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)


def test_close_copies_are_all_found(spark, monkeypatch):
    monkeypatch.setattr(pv, "TILE", 16)
    rows = vectors(1, 0.08)
    got = {r.vec_id: (r.n_links, r.component_id) for r in pv.linked_vectors(table(spark, rows)).collect()}
    want = brute(rows)
    assert got == want


def test_recall_near_the_threshold(spark):
    rows = vectors(2, 0.17)
    got = {r.vec_id: r.n_links for r in pv.linked_vectors(table(spark, rows)).collect()}
    want = {i: n for i, (n, _) in brute(rows).items()}
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.9 * sum(want.values()) > 0


def test_edges(spark):
    a, b = [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]
    rows = [(1, a), (2, b), (3, None), (4, []), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 3.0]), (7, [float("nan"), 1.0, 1.0]), (8, [float("inf"), 1.0, 1.0]), (9, [1.0, 2.0]), (None, a), (10, [-1.0, -2.0, -3.0]), (2, b)]
    got = pv.linked_vectors(table(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert by[1].n_links == 2 and by[2].n_links == 2 and by[2].component_id == 1 and not by[2].kept and by[1].kept
    for k in (3, 4, 5, 6, 7, 8, 9, 10):
        assert by[k].n_links == 0 and by[k].component_id == k and by[k].kept
    assert by[None].n_links == 0 and by[None].component_id is None and by[None].kept
    assert pv.linked_vectors(table(spark, [])).collect() == []


def test_recall_at_two_sizes():
    """Pairs of cosine 0.951 to 0.97 among vectors of 64 dimensions, by the index alone."""
    for n in (2_000, 16_000):
        rng = np.random.default_rng(n)
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        u = x[: n // 10]
        e = rng.normal(size=u.shape)
        e -= (e * u).sum(axis=1, keepdims=True) * u
        e /= np.linalg.norm(e, axis=1, keepdims=True)
        c = rng.uniform(0.951, 0.97, size=(len(u), 1))
        x = np.concatenate([x, c * u + np.sqrt(1 - c * c) * e])
        k = pv.pivots_for(len(x))
        perm = pv.describe(x, pv.choose_pivots(x[rng.permutation(len(x))[: pv.SAMPLE * k]], k))
        good, least = pv.alike(perm[: n // 10], perm[n:])
        assert good.mean() >= 0.95
        assert all(m in a and m in b for m, a, b in zip(least[good], perm[: n // 10][good], perm[n:][good], strict=True))


def test_a_permutation_lists_the_nearest_pivots_in_order():
    rng = np.random.default_rng(3)
    x, pivots = rng.normal(size=(50, 5)), rng.normal(size=(20, 5))
    assert (pv.describe(x, pivots) == np.argsort(-(x @ pivots.T), axis=1)[:, : pv.NEAREST]).all()
    assert pv.describe(x, pivots[:3]).shape == (50, 3)
    turned = np.arange(8)[None, ::-1]
    assert pv.alike(np.arange(8)[None], np.arange(8)[None])[0].all() and not pv.alike(np.arange(8)[None], turned)[0].any()
