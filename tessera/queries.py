"""Queries of the model operators over the star-schema tables, and the SQL that checks them.

Floating-point results are rounded, as sums have no fixed order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.families import BETA, NB, NORM, POISSON, clip_col
from tessera.operators import diagnostics, kernels, moments
from tessera.operators import fit as fits
from tessera.operators.covariates import bin_continuous_covariate
from tessera.operators.simulate import sample_description
from tessera.plans.constraints import constraint_system
from tessera.plans.formula import design_matrix
from tessera.sources.input import GlmInput

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- inputs ---------------------------------------------------------------------------------------


def order_qty(spark: SparkSession, sf_dir: str, formula: str = "~1+p", **kw) -> GlmInput:
    """Orders x return flags: summed quantities; covariates are priority (p) and status (st)."""
    x = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("obs_id"), F.col("l_returnflag").alias("feature")).agg(F.sum("l_quantity").alias("x"))
    obs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("st"))
    x = x.join(obs.select("obs_id"), "obs_id", "left_semi")
    return GlmInput.from_tables(x, obs, design_matrix(obs, formula), **kw)


def order_brand(spark: SparkSession, sf_dir: str, formula: str = "~1+p") -> GlmInput:
    """Orders x part brands: counts of lines, sparse."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    x = lines.groupBy(F.col("l_orderkey").alias("obs_id"), F.col("p_brand").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    obs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("st"))
    return GlmInput.from_tables(x.join(obs.select("obs_id"), "obs_id", "left_semi"), obs, design_matrix(obs, formula))


def embed(spark: SparkSession, sf_dir: str) -> GlmInput:
    """Vectors x dimensions; the covariate is the label."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null")
    obs = e.select(F.col("vec_id").alias("obs_id"), F.col("label").alias("g"))
    return GlmInput.from_arrays_column(e, "embedding", "vec_id", design=obs, loc=design_matrix(obs, "~1+g"))


def discount(spark: SparkSession, sf_dir: str) -> GlmInput:
    """Lines x return flags of one flag a line: discounts within (0, 1), dense; the covariate is the line status."""
    l = table(spark, sf_dir, "lineitem").select(  # noqa: E741
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("obs_id"), F.lit("discount").alias("feature"), ((F.col("l_discount") + 0.005) / 0.11).alias("x"), F.col("l_linestatus").alias("st")
    )
    obs = l.groupBy("obs_id").agg(F.min("st").alias("st"))
    x = l.groupBy("obs_id", "feature").agg(F.min("x").alias("x"))
    return GlmInput.from_tables(x, obs, design_matrix(obs, "~1+st"))


def sized(spark: SparkSession, sf_dir: str) -> GlmInput:
    """order_qty with the log of the order's line count as size factor; orders without lines are left out."""
    lines = table(spark, sf_dir, "lineitem")
    x = lines.groupBy(F.col("l_orderkey").alias("obs_id"), F.col("l_returnflag").alias("feature")).agg(F.sum("l_quantity").alias("x"))
    n = lines.groupBy(F.col("l_orderkey").alias("obs_id")).agg(F.ln(F.count(F.lit(1)).cast("double")).alias("sf"))
    obs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id"), F.col("o_orderpriority").alias("p")).join(n, "obs_id")
    return GlmInput.from_tables(x.join(obs.select("obs_id"), "obs_id", "left_semi"), obs, design_matrix(obs, "~1+p"), size_factor_col="sf")


def params(inp: GlmInput, loc: list[float], scale: list[float]) -> DataFrame:
    """The same parameters for every feature."""
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    return inp.features().select("feature", lit(loc).alias("theta_loc"), lit(scale).alias("theta_scale"))


def coefficients(df: DataFrame, array: str, digits: int = 6) -> DataFrame:
    """(feature, k, value) of an array column."""
    return df.select("feature", F.posexplode(array).alias("k", "v")).select("feature", "k", rounded(F.col("v"), digits).alias("value"))


def rounded(c: Column, digits: int = 6) -> Column:
    # adding 0 turns -0 into 0
    return F.round(c, digits) + F.lit(0.0)


def square(df: DataFrame, array: str, digits: int = 4) -> DataFrame:
    """(feature, i, j, value) of an array of arrays."""
    rows = df.select("feature", F.posexplode(array).alias("i", "row"))
    return rows.select("feature", "i", F.posexplode("row").alias("j", "v")).select("feature", "i", "j", rounded(F.col("v"), digits).alias("value"))


QTY = """qty as (select o.o_orderkey, f.feature, coalesce(x.x, 0.0) as x, o.o_orderpriority as p, o.o_orderstatus as st, dense_rank() over (order by o.o_orderpriority) - 1 as g
  from orders o cross join (select distinct l_returnflag as feature from lineitem where l_orderkey in (select o_orderkey from orders)) f
  left join (select l_orderkey, l_returnflag, sum(l_quantity) as x from lineitem group by 1, 2) x on x.l_orderkey = o.o_orderkey and x.l_returnflag = f.feature)"""
BRAND = """brand as (select o.o_orderkey, f.feature, coalesce(x.x, 0.0)::double as x, o.o_orderpriority as p, o.o_orderstatus as st, dense_rank() over (order by o.o_orderpriority) - 1 as g
  from orders o cross join (select distinct p_brand as feature from part join lineitem on l_partkey = p_partkey where l_orderkey in (select o_orderkey from orders)) f
  left join (select l_orderkey, p_brand, count(*) as x from lineitem join part on l_partkey = p_partkey group by 1, 2) x on x.l_orderkey = o.o_orderkey and x.p_brand = f.feature)"""
EMB = """emb as (select vec_id, (unnest(range(len(embedding))))::varchar as feature, unnest(embedding)::double as x, dense_rank() over (order by label) - 1 as g from embeddings)"""


def _by_group(source: str, value: str, digits: int = 6) -> str:
    """Coefficients of a saturated one-factor design from a value per group: the first, and differences to it."""
    return f"""m as (select feature, g, {value} as v from {source} group by 1, 2)
select a.feature, a.g::int as k, round(case when a.g = 0 then a.v else a.v - b.v end, {digits}) + 0.0 as value from m a join m b on a.feature = b.feature and b.g = 0"""


# --- A, C: input, shape, selection ----------------------------------------------------------------


@query("select feature, sum(x) = 0 as allzero from (select l_returnflag as feature, l_quantity as x from lineitem union all select 'none', 0.0) group by 1")
def feature_allzero(spark, sf_dir):
    inp = order_qty(spark, sf_dir)
    names = [r[0] for r in inp.features().orderBy("feature").collect()]
    return GlmInput(inp.x, inp.design, inp.loc_names, inp.scale_names, meta={"features": [*names, "none"]}).feature_isallzero()


@query("select (select count(*) from orders) as num_observations, (select count(distinct l_returnflag) from lineitem) as num_features, (select count(distinct o_orderpriority) from orders) as num_loc_params, 1::bigint as num_scale_params")
def num_obs_features(spark, sf_dir):
    inp = order_qty(spark, sf_dir)
    counts = inp.design.agg(F.count(F.lit(1)).alias("num_observations"))
    return counts.withColumns({"num_features": F.lit(inp.num_features).cast("long"), "num_loc_params": F.lit(inp.num_loc_params).cast("long"), "num_scale_params": F.lit(inp.num_scale_params).cast("long")})


@query("select o_orderkey as obs_id, (dense_rank() over (order by o_orderpriority))::int as level from orders qualify o_orderstatus = 'F'")
def fetch_design(spark, sf_dir):
    """Design rows of the finished orders, as the level that each has."""
    inp = order_qty(spark, sf_dir, "~0+p")
    some = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("obs_id"))
    return inp.fetch(some).select("obs_id", F.array_position("loc", F.lit(1.0)).cast("int").alias("level"))


@query("select l_returnflag as feature, l_orderkey as obs_id, sum(l_quantity) as x from lineitem where l_returnflag in ('A', 'R') and l_orderkey in (select o_orderkey from orders) group by 1, 2")
def feature_subset(spark, sf_dir):
    return order_qty(spark, sf_dir).subset_features(["A", "R"]).x.select("feature", "obs_id", "x")


@query("select o_orderpriority as p, o_orderstatus as st, count(*) as n_obs from orders group by 1, 2")
def distinct_design(spark, sf_dir):
    inp = order_qty(spark, sf_dir, "~0+p")
    obs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("st"))
    design = design_matrix(obs, "~0+p+st")
    groups = GlmInput.from_tables(inp.x, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id"), F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("st")), design).groups()
    p = design.levels["p"]
    st = design.levels["st"]
    level = lambda names, at: F.element_at(F.array(*[F.lit(n) for n in names]), at)
    first = F.array_position("loc", F.lit(1.0)).cast("int")
    rest = F.slice("loc", len(p) + 1, len(st) - 1)
    return groups.select(level(p, first).alias("p"), level(st, F.array_position(rest, F.lit(1.0)).cast("int") + 1).alias("st"), "n_obs")


@query(f"with {BRAND} select feature, x, count(*) as cnt from brand group by 1, 2")
def sparse_cells(spark, sf_dir):
    """Cells of sparse counts: zeros are worked out, never stored."""
    return order_brand(spark, sf_dir).cells().groupBy("feature", "x").agg(F.sum("cnt").alias("cnt"))


# --- B: links -------------------------------------------------------------------------------------


def _links(spark, sf_dir, fam, value, s):
    df = table(spark, sf_dir, "part").select("p_partkey", value.alias("v"), s.alias("s"))
    out = {"link_loc": fam.link_loc(F.col("v")), "inverse_loc": fam.inverse_loc(F.col("s")), "link_scale": fam.link_scale(F.col("v")), "inverse_scale": fam.inverse_scale(F.col("s"))}
    return df.select("p_partkey", *[rounded(c, 8).alias(k) for k, c in out.items()])


_SIZE = "p_retailprice / 1000.0 as v, p_size / 10.0 - 2 as s"


@query(f"select p_partkey, round(ln(v), 8) + 0.0 as link_loc, round(exp(s), 8) + 0.0 as inverse_loc, round(ln(v), 8) + 0.0 as link_scale, round(exp(s), 8) + 0.0 as inverse_scale from (select p_partkey, {_SIZE} from part)")
def links_nb(spark, sf_dir):
    return _links(spark, sf_dir, NB, F.col("p_retailprice") / 1000.0, F.col("p_size") / 10.0 - 2)


@query(ORACLE_SQL["links_nb"])
def links_poisson(spark, sf_dir):
    return _links(spark, sf_dir, POISSON, F.col("p_retailprice") / 1000.0, F.col("p_size") / 10.0 - 2)


@query(f"select p_partkey, round(v, 8) + 0.0 as link_loc, round(s, 8) + 0.0 as inverse_loc, round(ln(v), 8) + 0.0 as link_scale, round(exp(s), 8) + 0.0 as inverse_scale from (select p_partkey, {_SIZE} from part)")
def links_norm(spark, sf_dir):
    return _links(spark, sf_dir, NORM, F.col("p_retailprice") / 1000.0, F.col("p_size") / 10.0 - 2)


@query("select p_partkey, round(ln(v / (1 - v)), 8) + 0.0 as link_loc, round(1 / (1 + exp(-s)), 8) + 0.0 as inverse_loc, round(ln(v), 8) + 0.0 as link_scale, round(exp(s), 8) + 0.0 as inverse_scale from (select p_partkey, p_retailprice / 10000.0 as v, p_size / 10.0 - 2 as s from part)")
def links_beta(spark, sf_dir):
    return _links(spark, sf_dir, BETA, F.col("p_retailprice") / 10000.0, F.col("p_size") / 10.0 - 2)


_LOW, _HIGH = NB.bounds()["eta_loc"]


@query(f"select p_partkey, round(greatest(least((p_size - 25) * 20.0, {_HIGH!r}), {_LOW!r}), 6) + 0.0 as eta from part")
def clip_eta(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", rounded(clip_col((F.col("p_size") - 25) * 20.0, _LOW, _HIGH)).alias("eta"))


# --- E: moments and closed forms ------------------------------------------------------------------


@query(f"with {QTY} select feature, round(avg(x), 6) as mean from qty group by 1")
def column_mean(spark, sf_dir):
    return moments.column_mean(order_qty(spark, sf_dir)).select("feature", rounded(F.col("mean")).alias("mean"))


@query(f"with {QTY} select feature, g::int as g, count(*) as n, round(avg(x), 6) as mean, round(var_pop(x), 4) as variance from qty group by 1, 2")
def group_moments(spark, sf_dir):
    inp = order_qty(spark, sf_dir, "~0+p")
    groups = moments.design_groups(inp)
    # one-hot rows in ascending order run from the last level to the first
    return moments.group_moments(inp, groups).select(
        "feature", (F.lit(len(groups.rows) - 1) - F.col("g")).cast("int").alias("g"), "n", rounded(F.col("mean")).alias("mean"), rounded(F.col("variance"), 4).alias("variance")
    )


@query(f"with {QTY}, {_by_group('qty', 'ln(avg(x) + 4.94e-324)')}")
def nb_logmu(spark, sf_dir):
    return coefficients(moments.nb_log_mean(order_qty(spark, sf_dir)), "theta")


@query(f"with {BRAND}, {_by_group('brand', 'ln(avg(x) + 4.94e-324)')}")
def poisson_loglam(spark, sf_dir):
    return coefficients(moments.poisson_log_rate(order_brand(spark, sf_dir)), "theta")


@query(f"with {EMB}, {_by_group('emb', 'avg(x)')}")
def norm_mean(spark, sf_dir):
    return coefficients(moments.norm_mean(embed(spark, sf_dir)), "theta")


_DISC = "d as (select 'discount' as feature, min((l_discount + 0.005) / 0.11) as x, dense_rank() over (order by min(l_linestatus)) - 1 as g from lineitem group by l_orderkey, l_linenumber)"


@query(f"with {_DISC}, {_by_group('d', 'ln(avg(x) / (1 - avg(x)))')}")
def beta_logitmean(spark, sf_dir):
    return coefficients(moments.beta_logit_mean(discount(spark, sf_dir)), "theta")


@query(f"with {QTY} select feature, 0 as k, round(ln(power(avg(x), 2) / greatest(avg(x * x) - power(avg(x), 2) - avg(x), 2.2e-162)), 6) as value from qty group by 1")
def nb_logphi(spark, sf_dir):
    return coefficients(moments.nb_log_phi(order_qty(spark, sf_dir)), "theta")


@query(f"with {EMB} select feature, 0 as k, round(ln(sqrt(avg(x * x) - power(avg(x), 2))), 6) as value from emb group by 1")
def norm_logsd(spark, sf_dir):
    return coefficients(moments.norm_log_sd(embed(spark, sf_dir)), "theta")


@query(f"with {_DISC} select feature, 0 as k, round(ln(avg(x) * (1 - avg(x)) / (avg(x * x) - power(avg(x), 2)) - 1), 6) as value from d group by 1")
def beta_logsamplesize(spark, sf_dir):
    return coefficients(moments.beta_log_samplesize(discount(spark, sf_dir)), "theta")


_SIZED = """sz as (select o.o_orderkey, f.feature, coalesce(x.x, 0.0) as x, dense_rank() over (order by o.o_orderpriority) - 1 as g, n.n from orders o
  join (select l_orderkey, count(*)::double as n from lineitem group by 1) n on n.l_orderkey = o.o_orderkey cross join (select distinct l_returnflag as feature from lineitem) f
  left join (select l_orderkey, l_returnflag, sum(l_quantity) as x from lineitem group by 1, 2) x on x.l_orderkey = o.o_orderkey and x.l_returnflag = f.feature)"""


@query(f"with {_SIZED}, {_by_group('sz', 'ln(avg(x / n) + 4.94e-324)')}")
def nb_logmu_size_factors(spark, sf_dir):
    return coefficients(moments.nb_log_mean(sized(spark, sf_dir)), "theta")


# --- F: likelihoods and derivatives ---------------------------------------------------------------

_ETA5 = [3.4, 0.02, 0.04, 0.06, 0.08]
_ETA = "(3.4 + 0.02 * g)"
_LAM5 = [-1.8, 0.02, 0.04, 0.06, 0.08]
_LAM = "(-1.8 + 0.02 * g)"


def _nb_params(spark, sf_dir):
    inp = order_qty(spark, sf_dir)
    return inp, params(inp, _ETA5[: inp.num_loc_params], [-0.5])


def _poisson_params(spark, sf_dir):
    inp = order_brand(spark, sf_dir)
    return inp, params(inp, _LAM5[: inp.num_loc_params], [0.0])


def _norm_params(spark, sf_dir):
    inp = embed(spark, sf_dir)
    return inp, params(inp, [0.01 * k for k in range(inp.num_loc_params)], [-2.0])


_NBV = f"v as (select *, exp{_ETA} as mu, {_ETA} as eta, exp(-0.5::double) as r, -0.5 as s from qty)"
_POV = f"v as (select *, exp{_LAM} as lam, {_LAM} as eta from brand)"
_NOV = "v as (select *, 0.01 * g as eta, exp(-2.0::double) as sd from emb)"


@query(f"with {QTY}, {_NBV} select feature, round(sum(greatest(least(lgamma(r + x) - lgamma(x + 1) - lgamma(r) + x * (eta - ln(r + mu)) + r * (s - ln(r + mu)), 0), -744.44)), 3) as ll from v group by 1")
def nb_ll(spark, sf_dir):
    inp, p = _nb_params(spark, sf_dir)
    return kernels.log_likelihood(inp, p, "nb").select("feature", rounded(F.col("ll"), 3).alias("ll"))


@query(f"with {BRAND}, {_POV} select feature, round(sum(x * eta - lam - lgamma(x + 1)), 3) as ll from v group by 1")
def poisson_ll(spark, sf_dir):
    inp, p = _poisson_params(spark, sf_dir)
    return kernels.log_likelihood(inp, p, "poisson").select("feature", rounded(F.col("ll"), 3).alias("ll"))


@query(f"with {EMB}, {_NOV} select feature, round(sum(-0.5 * ln(2 * pi()) - ln(sd) - 0.5 * power((x - eta) / sd, 2)), 4) as ll from v group by 1")
def norm_ll(spark, sf_dir):
    inp, p = _norm_params(spark, sf_dir)
    return kernels.log_likelihood(inp, p, "norm").select("feature", rounded(F.col("ll"), 4).alias("ll"))


def _one_factor_sums(source: str, weight: str, sign: str = "", digits: int = 4, extra: str = "") -> str:
    """Sums of xh_i * weight * xh_j for an intercept and indicators of the later groups."""
    return f"""k as (select distinct g from v), w as (select feature, g, {sign}sum({weight}) as w from v group by 1, 2),
e as (select w.feature, i.g as i, j.g as j, sum(case when (i.g = 0 or i.g = w.g) and (j.g = 0 or j.g = w.g) then w.w else 0 end) as v from w cross join k i cross join k j group by 1, 2, 3)
select feature, i::int as i, j::int as j, round(v, {digits}) + 0.0 as value from e{extra}"""


def _one_factor_sum(weight: str, digits: int = 4, extra: str = "") -> str:
    return f"""k as (select distinct g from v), w as (select feature, g, sum({weight}) as w from v group by 1, 2)
select w.feature, i.g::int as k, round(sum(case when i.g = 0 or i.g = w.g then w.w else 0 end), {digits}) + 0.0 as value from w cross join k i group by 1, 2{extra}"""


@query(f"with {QTY}, {_NBV}, {_one_factor_sums('v', 'mu * r / (r + mu)')}")
def nb_fim(spark, sf_dir):
    return square(kernels.fisher_information(*_nb_params(spark, sf_dir), "nb"), "fim")


@query(f"with {BRAND}, {_POV}, {_one_factor_sums('v', 'lam')}")
def poisson_fim(spark, sf_dir):
    return square(kernels.fisher_information(*_poisson_params(spark, sf_dir), "poisson"), "fim")



@query(f"""with {EMB}, {_NOV}, {_one_factor_sums('v', '1 / (sd * sd)')}
union all select feature, i.g::int, (select count(*) from k)::int, 0.0 from (select distinct feature from v) cross join k i
union all select feature, (select count(*) from k)::int, i.g::int, 0.0 from (select distinct feature from v) cross join k i
union all select feature, (select count(*) from k)::int, (select count(*) from k)::int, round(2.0 * count(*), 4) from v group by 1""")
def norm_fim(spark, sf_dir):
    return square(kernels.fisher_information(*_norm_params(spark, sf_dir), "norm"), "fim")


@query(f"with {BRAND}, {_POV}, {_one_factor_sum('x - lam')}")
def poisson_jac(spark, sf_dir):
    return coefficients(kernels.jacobian(*_poisson_params(spark, sf_dir), "poisson"), "jac", 4)


@query(f"""with {EMB}, {_NOV}, {_one_factor_sum('(x - eta) / (sd * sd)')}
union all select feature, (select count(*) from k)::int, round(sum(power((x - eta) / sd, 2) - 1), 4) + 0.0 from v group by 1""")
def norm_jac(spark, sf_dir):
    return coefficients(kernels.jacobian(*_norm_params(spark, sf_dir), "norm"), "jac", 4)


@query(f"""with {QTY}, {_NBV}, h as (select x, sum(1.0 / (exp(-0.5::double) + i)) as h from (select distinct x from v where x > 0) cross join range(100000) t(i) where i < x group by 1),
{_one_factor_sum('r * (x - mu) / (r + mu)', 3)}
union all select feature, (select count(*) from k)::int, round(sum(r * (coalesce(h.h, 0) - (r + v.x) / (r + mu) + s + 1 - ln(r + mu))), 3) + 0.0 from v left join h on h.x = v.x group by 1""")
def nb_jac(spark, sf_dir):
    """Quantities are whole numbers, so digamma differences are harmonic sums in the SQL."""
    return coefficients(kernels.jacobian(*_nb_params(spark, sf_dir), "nb"), "jac", 3)


@query(f"with {BRAND}, {_POV}, {_one_factor_sums('v', 'lam', '-')}")
def poisson_hessian(spark, sf_dir):
    return square(kernels.hessian(*_poisson_params(spark, sf_dir), "poisson"), "hessian")


@query(f"""with {EMB}, {_NOV}, {_one_factor_sums('v', '1 / (sd * sd)', '-')}
union all (with b as (select feature, i.g as k, sum(case when i.g = 0 or i.g = v.g then -2 * (x - eta) / (sd * sd) else 0 end) as s from v cross join k i group by 1, 2)
  select feature, k::int, (select count(*) from k)::int, round(s, 4) + 0.0 from b union all select feature, (select count(*) from k)::int, k::int, round(s, 4) + 0.0 from b)
union all select feature, (select count(*) from k)::int, (select count(*) from k)::int, round(sum(-2 * power((x - eta) / sd, 2)), 4) from v group by 1""")
def norm_hessian(spark, sf_dir):
    return square(kernels.hessian(*_norm_params(spark, sf_dir), "norm"), "hessian")


@query(f"""with {QTY}, {_NBV}, h as (select x, sum(1.0 / (exp(-0.5::double) + i)) as h1, sum(1.0 / power(exp(-0.5::double) + i, 2)) as h2
  from (select distinct x from v where x > 0) cross join range(100000) t(i) where i < x group by 1),
{_one_factor_sums('v', 'mu * (x / r + 1) / power(mu / r + 1, 2)', '-', 3)}
union all (with b as (select feature, i.g as k, sum(case when i.g = 0 or i.g = v.g then mu * r * (x - mu) / power(r + mu, 2) else 0 end) as s from v cross join k i group by 1, 2)
  select feature, k::int, (select count(*) from k)::int, round(s, 3) + 0.0 from b union all select feature, (select count(*) from k)::int, k::int, round(s, 3) + 0.0 from b)
union all select feature, (select count(*) from k)::int, (select count(*) from k)::int,
  round(sum(r * (coalesce(h1, 0) - r * coalesce(h2, 0) - (mu * (r + v.x) + 2 * r * (r + mu)) / power(r + mu, 2) + s + 2 - ln(r + mu))), 3) + 0.0 from v left join h on h.x = v.x group by 1""")
def nb_hessian(spark, sf_dir):
    """Quantities are whole numbers, so differences of digamma and trigamma are sums in the SQL."""
    return square(kernels.hessian(*_nb_params(spark, sf_dir), "nb"), "hessian", 3)


@query(f"""with {BRAND}, {_POV}, w as (select feature, g, sum(x - lam) / sum(lam) as d from v group by 1, 2)
select a.feature, a.g::int as k, round(case when a.g = 0 then -1.8 + a.d else 0.02 * a.g + a.d - b.d end, 6) + 0.0 as value from w a join w b on a.feature = b.feature and b.g = 0""")
def irls_step_poisson(spark, sf_dir):
    return coefficients(kernels.irls_step(*_poisson_params(spark, sf_dir), "poisson"), "theta_loc")


@query(f"""with {QTY}, {_NBV}, w as (select feature, g, sum(r * (x - mu) / (r + mu)) / sum(mu * r / (r + mu)) as d from v group by 1, 2)
select a.feature, a.g::int as k, round(case when a.g = 0 then 3.4 + a.d else 0.02 * a.g + a.d - b.d end, 6) + 0.0 as value from w a join w b on a.feature = b.feature and b.g = 0""")
def irls_step_nb(spark, sf_dir):
    return coefficients(kernels.irls_step(*_nb_params(spark, sf_dir), "nb"), "theta_loc")


# --- J: fits --------------------------------------------------------------------------------------


@query(f"""with {EMB}, gm as (select feature, g, avg(x) as v from emb group by 1, 2), rss as (select e.feature, sum(power(e.x - m.v, 2)) / count(*) as s2 from emb e join gm m on m.feature = e.feature and m.g = e.g group by 1)
select a.feature, a.g::int as k, round(case when a.g = 0 then a.v else a.v - b.v end, 5) + 0.0 as value from gm a join gm b on a.feature = b.feature and b.g = 0
union all select feature, (select count(distinct g) from emb)::int, round(0.5 * ln(s2), 3) + 0.0 from rss""")
def norm_fit(spark, sf_dir):
    """Least-squares coefficients, and as the last one the log of the residual deviation."""
    fitted = fits.fit_norm(embed(spark, sf_dir))
    scale = fitted.select("feature", F.size("theta_loc").alias("k"), rounded(F.element_at("theta_scale", 1), 3).alias("value"))
    return coefficients(fitted, "theta_loc", 5).unionByName(scale)


@query(f"with {BRAND}, {_by_group('brand', 'ln(avg(x))', 5)}")
def poisson_fit(spark, sf_dir):
    return coefficients(fits.fit_poisson(order_brand(spark, sf_dir), init_location="standard"), "theta_loc", 5)


@query(f"""with recursive {BRAND}, v as (select feature, x, g, dense_rank() over (order by st) - 1 as t from brand),
n as (select g, t, count(*) as n from v where feature = (select min(feature) from v) group by 1, 2),
xg as (select feature, g, sum(x) as x from v group by 1, 2), xt as (select feature, t, sum(x) as x from v group by 1, 2),
fit(step, feature, t, b) as (select 0, feature, t, 1.0::double from xt
  union all (with a as (select step, fit.feature, xg.g, any_value(xg.x) / sum(n.n * b) as a from fit join n on n.t = fit.t join xg on xg.feature = fit.feature and xg.g = n.g where step < 200 group by 1, 2, 3)
    select step + 1, a.feature, xt.t, any_value(xt.x) / sum(n.n * a) from a join n on n.g = a.g join xt on xt.feature = a.feature and xt.t = n.t group by 1, 2, 3)),
b as (select feature, t, ln(b) as b from fit where step = 200),
a as (select xg.feature, xg.g, ln(any_value(xg.x) / sum(n.n * exp(b.b))) as a from b join n on n.t = b.t join xg on xg.feature = b.feature and xg.g = n.g group by 1, 2)
select a.feature, a.g::int as k, round(case when a.g = 0 then a.a + b0.b else a.a - a0.a end, 5) + 0.0 as value
from a join a a0 on a0.feature = a.feature and a0.g = 0 join b b0 on b0.feature = a.feature and b0.t = 0
union all select b.feature, ((select count(distinct g) from n) - 1 + b.t)::int, round(b.b - b0.b, 5) + 0.0 from b join b b0 on b0.feature = b.feature and b0.t = 0 where b.t > 0""")
def poisson_fit_additive(spark, sf_dir):
    """Two factors; the SQL fits their margins in turn until they hold, which gives the same estimates."""
    fitted = fits.fit_poisson(order_brand(spark, sf_dir, "~1+p+st"))
    return coefficients(fitted, "theta_loc", 5)


@query(f"with {QTY}, {_by_group('qty', 'ln(avg(x))', 4)}")
def nb_fit_loc(spark, sf_dir):
    """The location of a one-factor design is the log of group means, whatever the scale."""
    return coefficients(fits.fit_nb(order_qty(spark, sf_dir), init_location="standard"), "theta_loc", 4)


@query(f"""with recursive {QTY}, v as (select feature, g, x, avg(x) over (partition by feature, g) as mu from qty),
n as (select feature, mu, count(*) as n from v group by 1, 2),
c as (select feature, i, count(*) as c from v cross join range((select max(x)::int from qty)) t(i) where i < x group by 1, 2),
fit(step, feature, low, high) as (select 0, feature, -10.0::double, 10.0::double from n group by 2
  union all (with m as (select step, feature, low, high, (low + high) / 2 as s from fit where step < 60),
    up as (select m.feature, sum(c.c / (exp(s) + i)) as up from m join c on c.feature = m.feature group by 1),
    down as (select m.feature, sum(n.n * ln(1 + n.mu * exp(-s))) as down from m join n on n.feature = m.feature group by 1)
    select step + 1, m.feature, case when up > down then s else low end, case when up > down then high else s end from m join up on up.feature = m.feature join down on down.feature = m.feature)),
r as (select feature, low as s, exp(low) as r from fit where step = 60)
select v.feature, round(any_value(s), 4) + 0.0 as log_phi,
  round(sum(lgamma(r + x) - lgamma(x + 1) - lgamma(r) + x * (ln(mu) - ln(r + mu)) + r * (s - ln(r + mu))), 2) as ll, 'converged' as status from v join r on r.feature = v.feature group by 1""")
def nb_fit_scale(spark, sf_dir):
    """Locations are the logs of group means, so in the SQL the scale's score has one root, found by halving."""
    fitted = fits.fit_nb(order_qty(spark, sf_dir))
    return fitted.select("feature", rounded(F.element_at("theta_scale", 1), 4).alias("log_phi"), rounded(F.col("ll"), 2).alias("ll"), "status")


@query(f"""with recursive {_SIZED}, v as (select feature, g, n as z, x, count(*) as n from sz group by 1, 2, 3, 4),
c as (select feature, i, sum(n) as c from v cross join range((select max(x)::int from v)) t(i) where i < x group by 1, 2),
fit(step, feature, g, a, s) as (select 0, feature, g, ln(sum(n * x) / sum(n * z)), 0.0::double from v group by 2, 3
  union all (with m as (select step, v.feature, v.g, a, s, exp(s) as r, exp(a) * z as mu, x, n from fit join v on v.feature = fit.feature and v.g = fit.g where step < 200),
    loc as (select step, feature, g, any_value(s) as s, any_value(a) + sum(n * r * (x - mu) / (r + mu)) / sum(n * r * mu / (r + mu)) as a from m group by 1, 2, 3),
    rs as (select feature, any_value(exp(s)) as r from fit group by 1),
    h as (select c.feature, sum(c.c / (r + i)) as h1, sum(c.c / power(r + i, 2)) as h2 from c join rs on rs.feature = c.feature group by 1),
    sc as (select m.feature, any_value(h1) + sum(n * (s + 1 - (r + x) / (r + mu) - ln(r + mu))) as u,
        -any_value(r) * any_value(h2) + sum(n * (1 - r * (mu - x) / power(r + mu, 2) - r / (r + mu))) as d from m join h on h.feature = m.feature group by 1)
    select step + 1, loc.feature, loc.g, loc.a, loc.s - greatest(least(u / d, 0.5), -0.5) from loc join sc on sc.feature = loc.feature)),
m as (select feature, g, a as v from fit where step = 200)
select a.feature, a.g::int as k, round(case when a.g = 0 then a.v else a.v - b.v end, 4) + 0.0 as value from m a join m b on a.feature = b.feature and b.g = 0""")
def nb_fit_size_factors(spark, sf_dir):
    """The SQL takes Newton steps of each group's location and of the scale until neither moves."""
    fitted = fits.fit_nb(sized(spark, sf_dir))
    return coefficients(fitted, "theta_loc", 4)


@query()
def fit_history(spark, sf_dir):
    """Loss per step and feature."""
    return fits.history(fits.fit_nb(order_qty(spark, sf_dir))).select("step", "feature", rounded(F.col("loss"), 3).alias("loss"))


# --- G, H, K, L: covariates, designs, simulation, diagnostics -------------------------------------


@query("""select o_orderkey as obs_id, 1.0 as c0, (o_orderstatus = 'O')::int::double as c1, (o_orderstatus = 'P')::int::double as c2 from orders""")
def design_rows(spark, sf_dir):
    obs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("obs_id"), F.col("o_orderstatus").alias("st"))
    d = design_matrix(obs, "~1+st")
    return d.attach(obs).select("obs_id", *[F.element_at("loc", k + 1).alias(f"c{k}") for k in range(3)])


@query("""with l as (select distinct o_orderstatus as v, 'st' as f from orders), r as (select v, row_number() over (order by v) as n from l)
select 'Intercept' as name, 0 as place union all select 'st[T.' || v || ']', (n - 1)::int from r where n > 1""")
def design_names(spark, sf_dir):
    obs = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("st"))
    return spark.createDataFrame([(n, k) for k, n in enumerate(design_matrix(obs, "~1+st").names)], "name string, place int")


@query("""with n as (select n_nationkey as k, n_regionkey as r, row_number() over (partition by n_regionkey order by n_nationkey) as i from nation)
select 'nation[' || a.k || ']' as name, 'nation[' || b.k || ']' as free, case when a.k = b.k then 1.0 else -1.0 end as weight
from n a join n b on (a.k = b.k and a.i > 1) or (a.r = b.r and a.i = 1 and b.i > 1)""")
def constraint_matrix(spark, sf_dir):
    """Nations nested in regions: each region's first nation is minus the sum of its others."""
    obs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), F.col("n_regionkey").alias("region"))
    system = constraint_system({"nation": "region"}, sample_description=obs, formula="~1+region+nation")
    names, matrix = system.names, system.matrix
    free = [n for k, n in enumerate(names) if (matrix[k] == 1).sum() == 1 and (matrix[k] != 0).sum() == 1]
    rows = [(n, free[j], float(matrix[k, j])) for k, n in enumerate(names) for j in range(matrix.shape[1]) if matrix[k, j] and n.startswith("nation[")]
    return spark.createDataFrame(rows, "name string, free string, weight double")


@query("""select p_partkey as obs_id, (select count(*) from range(8) t(i) where i / 8.0 <= rank0 / n)::int as bin from (
select p_partkey, (row_number() over (order by p_retailprice, p_partkey) - 1)::double as rank0, (count(*) over ())::double as n from part)""")
def bin_covariate(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("obs_id"), "p_retailprice")
    return bin_continuous_covariate(part, "p_retailprice", 8).select("obs_id", F.col("p_retailprice_binned").alias("bin"))


@query("""select i::bigint as obs_id, (i % 2)::varchar as condition, (i // 250)::varchar as batch from range(1000) t(i)""")
def simulate_design(spark, sf_dir):
    return sample_description(spark, 1000, 2, 4)


_PAIR = f"""with {QTY}, m as (select feature, g, ln(avg(x)) as v from qty group by 1, 2), b as (select a.feature, a.g, case when a.g = 0 then a.v else a.v - z.v end as v from m a join m z on a.feature = z.feature and z.g = 0),
t as (select feature, g, v as pred, 3.4 * (g = 0)::int + 0.02 * g + 0.1 * (feature = 'A')::int as ref from b)"""


def _pairs(spark, sf_dir) -> DataFrame:
    inp = order_qty(spark, sf_dir)
    pred = moments.nb_log_mean(inp).select("feature", F.col("theta").alias("theta_loc"))
    first = [3.4, *[0.02 * k for k in range(1, inp.num_loc_params)]]
    true = inp.features().select("feature", F.array(*[F.lit(v) + F.when(F.col("feature") == "A", 0.1).otherwise(0.0) for v in first]).alias("theta_loc"))
    return diagnostics.coefficient_pairs(true, pred, [str(k) for k in range(inp.num_loc_params)])


@query(f"{_PAIR} select g::varchar as coef, count(*) as n, round(corr(ref, pred), 5) as pearson_r from t group by 1")
def coef_corr(spark, sf_dir):
    return diagnostics.coef_vs_ref(_pairs(spark, sf_dir)).select("coef", "n", rounded(F.col("pearson_r"), 5).alias("pearson_r"))


@query(f"{_PAIR} select g::varchar as coef, count(*) as n, round(avg(pred - ref), 6) + 0.0 as mean, round(stddev_pop(pred - ref), 6) as std, round(quantile_cont(pred - ref, 0.5), 6) + 0.0 as q50 from t group by 1")
def deviation_summary(spark, sf_dir):
    out = diagnostics.deviation_summary(_pairs(spark, sf_dir))
    return out.select("coef", "n", *[rounded(F.col(c)).alias(c) for c in ("mean", "std", "q50")])


