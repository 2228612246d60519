"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations alone.

The tree is domain, language, source. A token budget goes down the tree by integer weights. A node
that holds fewer tokens than its share (times max_epochs) gives the shortage to its siblings first;
what the siblings can't take either has already been seen one level up, since a node's capacity is
the sum of its leaves'. Shares are whole tokens and add up to the budget, or to all there is.

A leaf's budget is spent in epochs: each full epoch takes every document once, and the last, partial
epoch takes the token-prefix of the leaf's documents in an order seeded by the epoch. The prefix is
found from the token sums of 65536 hash ranges, so only the documents of one range a leaf are sorted.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import cut, discard

TOKEN = r"[^\x20\x09-\x0D]+"
MISSING = "(null)"


def default_domain(source: Column) -> Column:
    """Three domains by the last character of the source's name."""
    return F.concat(F.lit("d"), (F.ascii(F.right(source, F.lit(1))) % 3).cast("string"))


@dataclass(frozen=True)
class Plan:
    """Weights are positive integers (0: no share); a name that isn't listed weighs `other`.

    The budget is budget_tokens, or per_mille of the corpus's tokens where that is None.
    """

    domains: Mapping[str, int] = field(default_factory=lambda: {"d0": 5, "d1": 3, "d2": 2})
    langs: Mapping[str, int] = field(default_factory=lambda: {"en": 4, "de": 2, "fr": 2, "es": 1})
    sources: Mapping[str, int] = field(default_factory=dict)
    other: int = 1
    budget_tokens: int | None = None
    per_mille: int = 1000
    max_epochs: int = 4
    seed: int = 7


def _weight(name: Column, weights: Mapping[str, int], other: int) -> Column:
    if not weights:
        return F.lit(other).cast("long")
    table = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    return F.coalesce(F.try_element_at(table, name), F.lit(other)).cast("long")


def _share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `budget`, the share of `total` (the parent's budget) by weight `w`, at most `cap`."""
    family = W.partitionBy(*(parent or [F.lit(0)]))
    order = family.orderBy(F.try_divide(F.col("cap").cast("double"), F.col("w").cast("double")).asc_nulls_last(), name)
    big = lambda c: F.col(c).cast("decimal(19,0)")
    nodes = nodes.withColumns(
        {
            "before": F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
            "w_rest": F.sum("w").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)),
        }
    ).withColumn("short", (F.col("w") > 0) & (big("cap") * big("w_rest") <= (big("total") - big("before")) * big("w")))
    nodes = nodes.withColumns(
        {
            "left": F.col("total") - F.sum(F.when(F.col("short"), F.col("cap")).otherwise(F.lit(0))).over(family),
            "w_left": F.sum(F.when(F.col("short"), F.lit(0)).otherwise(F.col("w"))).over(family),
        }
    ).withColumns({"a": big("left") * big("w"), "b": big("w_left")})
    nodes = nodes.withColumn(
        "part", F.when(F.col("short"), F.col("cap")).when(F.col("w_left") > 0, F.expr("a div nullif(b, 0)")).otherwise(F.lit(0)).cast("long")
    )
    open_ = ~F.col("short") & (F.col("w") > 0)
    nth = F.sum(F.when(open_, 1).otherwise(0)).over(family.orderBy(name).rowsBetween(W.unboundedPreceding, W.currentRow))
    rest = F.col("left") - F.sum(F.when(open_, F.col("part")).otherwise(F.lit(0))).over(family)
    return nodes.withColumn("budget", F.col("part") + F.when(open_ & (nth <= rest), 1).otherwise(0)).drop(
        "before", "w_rest", "short", "left", "w_left", "a", "b", "part", "total"
    )


def leaf_budgets(tokens: DataFrame, plan: Plan) -> DataFrame:
    """(domain, lang, source, tokens, budget) per leaf of (domain, lang, source, n_tokens) rows."""
    leaves = tokens.groupBy("domain", "lang", "source").agg(F.sum("n_tokens").alias("tokens"))
    # a node of weight 0 takes nothing, so its parents can't count on it
    able = lambda cap: F.when(F.col("w") > 0, cap).otherwise(F.lit(0)).cast("long")
    leaves = leaves.withColumn("w", _weight(F.col("source"), plan.sources, plan.other)).withColumn("cap", able(F.col("tokens") * plan.max_epochs))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    langs = langs.withColumn("w", _weight(F.col("lang"), plan.langs, plan.other)).withColumn("cap", able(F.col("cap")))
    domains = langs.groupBy("domain").agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    domains = domains.withColumn("w", _weight(F.col("domain"), plan.domains, plan.other))
    whole = F.sum("tokens").over(W.partitionBy(F.lit(0)))
    total = F.lit(plan.budget_tokens).cast("long") if plan.budget_tokens is not None else F.floor(whole * plan.per_mille / F.lit(1000)).cast("long")
    if plan.budget_tokens is None:
        total = F.expr("x div 1000")
        domains = domains.withColumn("x", whole * plan.per_mille).withColumn("total", total).drop("x")
    else:
        domains = domains.withColumn("total", total)
    domains = _share(domains, [], "domain").select("domain", F.col("budget").alias("total"))
    langs = _share(langs.join(domains, "domain"), ["domain"], "lang").select("domain", "lang", F.col("budget").alias("total"))
    return _share(leaves.join(langs, ["domain", "lang"]), ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "budget")


LEAF = ["domain", "lang", "source"]


def mix_sources(
    docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text", domain: Column | None = None
) -> DataFrame:
    """(id, domain, lang, source, n_tokens, epochs, prefix_tokens, selected_tokens) per row of docs.

    epochs: full epochs of the row's leaf; prefix_tokens: tokens of the row in the partial epoch, which
    for the prefix's last document may be a part of it. Tokens are runs of characters other than white
    space; a null or empty text has none and takes no budget. A null lang or source is the name
    "(null)". Ties of the order (repeated ids, null ids) go by fewer tokens first. An empty table gives
    an empty result. Columns of docs other than the id, text, lang and source aren't read.
    """
    source = F.coalesce(F.col("source"), F.lit(MISSING))
    narrow = docs.select(
        F.col(id_col).alias("id"),
        (default_domain(source) if domain is None else F.coalesce(domain, F.lit(MISSING))).alias("domain"),
        F.coalesce(F.col("lang"), F.lit(MISSING)).alias("lang"),
        source.alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(TOKEN)), F.lit(0)).cast("long").alias("n_tokens"),
    )
    tokens = cut(narrow, "tokens")
    budgets = cut(
        leaf_budgets(tokens, plan)
        .withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div nullif(tokens, 0)")).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")),
        "budgets",
    )
    placed = tokens.join(budgets.select(*LEAF, "epochs", "rest"), LEAF).withColumn(
        "place", F.md5(F.concat_ws(":", F.lit(plan.seed), F.col("epochs"), F.col("id")).cast("binary"))
    )
    placed = placed.withColumn("part", F.substring("place", 1, 4))
    sums = placed.where("rest > 0 and n_tokens > 0").groupBy(*LEAF, "rest", "part").agg(F.sum("n_tokens").alias("k"))
    upto = F.sum("k").over(W.partitionBy(*LEAF).orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow))
    edge = (
        sums.withColumn("upto", upto).where("upto >= rest").groupBy(*LEAF)
        .agg(F.min("part").alias("edge"), F.min(F.col("upto")).alias("upto"), F.min_by("k", "part").alias("k"))
        .select(*LEAF, "edge", (F.col("upto") - F.col("k")).alias("base"))
    )
    placed = placed.join(edge, LEAF, "left")
    out = [F.col("id").alias(id_col), *LEAF, "n_tokens", "epochs", "prefix_tokens"]
    at_edge = F.coalesce(F.col("part") == F.col("edge"), F.lit(False))
    clear = placed.where(~at_edge).withColumn("prefix_tokens", F.when(F.col("part") < F.col("edge"), F.col("n_tokens")).otherwise(F.lit(0)))
    before = F.col("base") + F.coalesce(
        F.sum("n_tokens").over(W.partitionBy(*LEAF).orderBy("place", "id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)
    )
    cut_off = placed.where(at_edge).withColumn("prefix_tokens", F.greatest(F.lit(0), F.least("n_tokens", F.col("rest") - before)))
    out = cut(clear.select(*out).union(cut_off.select(*out)), "mixed")
    discard(tokens, budgets)
    return out.withColumn("selected_tokens", F.col("epochs") * F.col("n_tokens") + F.col("prefix_tokens"))


def keep_mixed(docs: DataFrame, plan: Plan, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs once for each epoch that has any of the document's tokens, columns as they are; the prefix's last document stays whole.

    Rows with a null id are kept once, as are documents without tokens. Repeated ids count as one
    document, with the most copies that mix_sources() gives to any of them. Columns of docs may have any
    name but __id, __copies and __copy. An empty table gives no rows.
    """
    drawn = mix_sources(docs, plan, id_col, text_col)
    n = F.col("epochs") + F.when(F.col("prefix_tokens") > 0, 1).otherwise(0)
    copies = drawn.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.when(F.col("n_tokens") == 0, F.lit(1)).otherwise(n)).cast("int").alias("__copies"))
    many = docs.join(copies, docs[id_col] == copies["__id"], "left").withColumn("__copies", F.coalesce("__copies", F.lit(1)))
    return many.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[docs[c] for c in docs.columns])


def oracle_sql(plan: Plan = Plan()) -> str:
    """DuckDB SQL for mix_sources() over documents, without hash ranges."""

    def weight(name: str, weights: Mapping[str, int]) -> str:
        return f"(case {name} {' '.join(f"when '{k}' then {v}" for k, v in weights.items())} else {plan.other} end)" if weights else f"({plan.other})"

    def share(nodes: str, parent: str, name: str) -> str:
        by = f"partition by {parent}" if parent else ""
        return f"""
        select * exclude (part, rest, nth, short), part + case when not short and w > 0 and nth <= rest then 1 else 0 end as budget from (
          select *, total - sum(case when short then cap else 0 end) over ({by}) - sum(case when short or w = 0 then 0 else part end) over ({by}) as rest,
            sum(case when not short and w > 0 then 1 else 0 end) over ({by} order by {name} rows unbounded preceding) as nth from (
            select *, case when short then cap when w_left > 0 then (left_over::hugeint * w) // w_left else 0 end as part from (
              select *, total - sum(case when short then cap else 0 end) over ({by}) as left_over, sum(case when short then 0 else w end) over ({by}) as w_left from (
                select *, w > 0 and cap::hugeint * w_rest <= (total - before)::hugeint * w as short from (
                  select *, coalesce(sum(cap) over ({by} order by cap::double / nullif(w, 0)::double nulls last, {name} rows between unbounded preceding and 1 preceding), 0) as before,
                    sum(w) over ({by} order by cap::double / nullif(w, 0)::double nulls last, {name} rows between current row and unbounded following) as w_rest
                  from ({nodes}))))))"""

    total = str(plan.budget_tokens) if plan.budget_tokens is not None else f"(sum(tokens) over ()) * {plan.per_mille} // 1000"
    domains = f"select domain, tokens, cap, {weight('domain', plan.domains)} as w, {total} as total from (select domain, sum(tokens) as tokens, sum(case when {weight('lang', plan.langs)} > 0 then cap else 0 end) as cap from leaf group by 1)"
    langs = f"select l.domain, l.lang, l.tokens, l.cap, {weight('l.lang', plan.langs)} as w, d.budget as total from (select domain, lang, sum(tokens) as tokens, sum(cap) as cap from leaf group by 1, 2) l join dom d using (domain)"
    leaves = f"select l.domain, l.lang, l.source, l.tokens, l.cap, {weight('l.source', plan.sources)} as w, g.budget as total from leaf l join lng g on l.domain = g.domain and l.lang = g.lang"
    return f"""
    with tok as (select doc_id, 'd' || (ascii(right(coalesce(source, '{MISSING}'), 1)) % 3) as domain, coalesce(lang, '{MISSING}') as lang, coalesce(source, '{MISSING}') as source,
        coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens from documents),
    leaf as (select domain, lang, source, sum(n_tokens)::hugeint as tokens, case when {weight('source', plan.sources)} > 0 then sum(n_tokens)::hugeint * {plan.max_epochs} else 0 end as cap from tok group by 1, 2, 3),
    dom as ({share(domains, '', 'domain')}),
    lng as ({share(langs, 'domain', 'lang')}),
    src as ({share(leaves, 'domain, lang', 'source')}),
    ep as (select *, case when tokens > 0 then budget // tokens else 0 end as epochs from src),
    pl as (select t.*, e.epochs, e.budget - e.epochs * e.tokens as rest, md5(concat_ws(':', {plan.seed}, e.epochs, t.doc_id)) as place
        from tok t join ep e on t.domain = e.domain and t.lang = e.lang and t.source = e.source),
    pre as (select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by place, doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0) as before from pl),
    fin as (select *, greatest(0, least(n_tokens, rest - before)) as prefix_tokens from pre)
    select doc_id, domain, lang, source, n_tokens, epochs::bigint as epochs, prefix_tokens::bigint as prefix_tokens, (epochs * n_tokens + prefix_tokens)::bigint as selected_tokens from fin"""
