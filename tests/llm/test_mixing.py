import hashlib
import random

import duckdb
import pytest

from tessera.llm import mixing as mx

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, domain string, epochs int, n_tokens int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, l, s, 0, "z", 1, 2) for i, t, l, s in rows], SCHEMA)


def corpus(seed, n=300):
    rng = random.Random(seed)
    return [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 3, 20, 80]))), rng.choice(["en", "en", "en", "de", "fr", None]), "src0" if rng.random() < 0.4 else f"src{rng.randrange(12)}") for i in range(n)]


PLANS = [mx.Plan(), mx.Plan(per_mille=400, max_epochs=1), mx.Plan(budget_tokens=10**7), mx.Plan(budget_tokens=0), mx.Plan(budget_tokens=777, domains={"d0": 1, "d1": 0, "d2": 7}, sources={"src3": 9})]


@pytest.mark.parametrize("k", range(len(PLANS)))
def test_as_the_sql(spark, k):
    rows, plan = corpus(k), PLANS[k]
    got = mx.mix_sources(table(spark, rows), plan).collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    rel = con.sql(mx.oracle_sql(plan))
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    key = lambda d: tuple(str(d[c]) for c in rel.columns)
    assert sorted(key(r.asDict()) for r in got) == sorted(map(key, want))


def waterfill(budget, nodes):
    """Shares by repeated passes: (weight, capacity) -> real-valued share."""
    share, open_ = {}, set(nodes)
    while open_:
        w = sum(nodes[k][0] for k in open_)
        short = [k for k in open_ if w and nodes[k][1] * w <= budget * nodes[k][0]]
        if not short:
            for k in open_:
                share[k] = budget * nodes[k][0] / w if w else 0
            break
        for k in short:
            share[k] = nodes[k][1]
            budget -= nodes[k][1]
            open_.remove(k)
    return share


def test_budgets_by_passes(spark):
    """Shortages go to siblings before ancestors, shares are whole and spend the budget."""
    rows, plan = corpus(9, 500), mx.Plan(per_mille=1500, max_epochs=2)
    docs = mx.mix_sources(table(spark, rows), plan).collect()
    tokens, spent = {}, {}
    for r in docs:
        leaf = (r.domain, r.lang, r.source)
        tokens[leaf] = tokens.get(leaf, 0) + r.n_tokens
        spent[leaf] = spent.get(leaf, 0) + r.selected_tokens
    total = sum(tokens.values())
    budget = total * 3 // 2
    cap = lambda p: sum(2 * n for leaf, n in tokens.items() if leaf[: len(p)] == p)
    domains = {leaf[:1] for leaf in tokens}
    at = waterfill(budget, {d: (plan.domains.get(d[0], 1), cap(d)) for d in domains})
    for d in domains:
        langs = {leaf[:2] for leaf in tokens if leaf[:1] == d}
        mine = waterfill(at[d], {g: (plan.langs.get(g[1], 1), cap(g)) for g in langs})
        for g in langs:
            leaves = {leaf for leaf in tokens if leaf[:2] == g}
            want = waterfill(mine[g], {leaf: (1, cap(leaf)) for leaf in leaves})
            for leaf in leaves:
                assert abs(spent[leaf] - want[leaf]) <= 3
    assert sum(spent.values()) == min(budget, 2 * total)


def test_prefix_follows_the_seeded_order(spark):
    rows = corpus(4)
    docs = mx.mix_sources(table(spark, rows), mx.Plan(per_mille=500)).collect()
    by = {}
    for r in docs:
        by.setdefault((r.domain, r.lang, r.source), []).append(r)
    for group in by.values():
        place = lambda r: hashlib.md5(f"7:{r.epochs}:{r.doc_id}".encode()).hexdigest()
        taken = [(r.prefix_tokens, r.n_tokens) for r in sorted(group, key=place) if r.n_tokens]
        full = [p == n for p, n in taken]
        assert full == sorted(full, reverse=True) and sum(0 < p < n for p, n in taken) <= 1


def test_edges(spark):
    rows = [(1, None, None, None), (2, "", "en", "src0"), (None, "a b", "en", "src0"), (3, "a b", "en", "src0"), (3, "a b", "en", "src0"), (4, "w " * 100_000, "en", "")]
    got = mx.mix_sources(table(spark, rows)).collect()
    assert len(got) == len(rows) and sum(r.selected_tokens for r in got) == sum(r.n_tokens for r in got) == 100_006
    assert mx.mix_sources(table(spark, [])).collect() == []
    out = mx.keep_mixed(table(spark, rows), mx.Plan(max_epochs=1))
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert len(out.collect()) == len(rows)


def test_no_python_in_the_plan(spark, capsys):
    out = mx.mix_sources(table(spark, corpus(1, 20)))
    out.explain("formatted")
    assert not any(w in capsys.readouterr().out for w in ("Python", "Pandas", "Arrow"))


def test_a_leaf_of_weight_0_does_not_swallow_its_domains_budget(spark):
    """d0 has one source of weight 0; what d0 can't place goes to d1."""
    rows = [(k, "w " * 10, "en", s) for k, s in enumerate(["src0"] * 10 + ["src3"] * 20 + ["src1"] * 30)]
    plan = mx.Plan(budget_tokens=300, domains={"d0": 9, "d1": 1}, sources={"src3": 0}, max_epochs=1)
    names = {s: mx.F.concat(mx.F.lit("d"), (mx.F.ascii(mx.F.right(mx.F.lit(s), mx.F.lit(1))) % 3).cast("string")) for s in ("src0", "src3", "src1")}
    assert {spark.range(1).select(c).first()[0] for s, c in names.items() if s != "src1"} == {"d0"}
    got = mx.mix_sources(table(spark, rows), plan).collect()
    assert sum(r.selected_tokens for r in got) == 300
    assert sum(r.selected_tokens for r in got if r.source == "src3") == 0
