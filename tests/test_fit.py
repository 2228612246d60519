import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.families import NoScaleError
from tessera.operators import diagnostics, fit, kernels, moments
from tessera.operators.covariates import bin_continuous_covariate
from tessera.operators.linear import inverse_or_zero, solve_or_zero
from tessera.operators.simulate import generate_artificial_data, sample_description
from tessera.plans.constraints import constraint_system
from tessera.sources.input import GlmInput

DRAWS = {
    "nb": dict(rand_fn_ave=lambda r, s: r.uniform(10, 1000, s), rand_fn_loc=lambda r, s: r.uniform(1, 3, s), rand_fn_scale=lambda r, s: r.uniform(1, 3, s)),
    "poisson": dict(rand_fn_ave=lambda r, s: r.uniform(10, 15, s), rand_fn_loc=lambda r, s: r.uniform(1, 3, s), rand_fn_scale=lambda r, s: r.uniform(1, 3, s)),
    "norm": dict(rand_fn_ave=lambda r, s: r.uniform(10, 1000, s), rand_fn_loc=lambda r, s: r.uniform(1, 3, s), rand_fn_scale=lambda r, s: r.uniform(1, 3, s)),
}


@pytest.fixture(scope="module")
def simulated(spark):
    out = {}
    for fam, draws in DRAWS.items():
        sim = generate_artificial_data(spark, fam, 800, 20, 2, 4, intercept_scale=True, seed=3, **draws)
        x = sim.input.x.toPandas()
        sim.input = GlmInput(spark.createDataFrame(x), sim.input.design.persist(), sim.input.loc_names, sim.input.scale_names, meta=sim.input.meta)
        out[fam] = sim
    return out


def deviations(true, got, p):
    t, g = np.stack(true), np.stack(got)
    return (g[:, :p] - t[:, :p]) / t[:, :p]


@pytest.mark.parametrize("fam", ["nb", "poisson", "norm"])
def test_recovers_parameters(simulated, fam):
    sim = simulated[fam]
    got = fit.fit(sim.input, fam).join(sim.params.withColumnsRenamed({"theta_loc": "tl", "theta_scale": "ts"}), "feature").toPandas()
    assert len(got) == 20 and set(got.status) <= {"converged", "at_bound"}
    d = deviations(got.tl, got.theta_loc, 5)
    assert abs(d.mean()) <= 0.2 and d.std() <= 1
    if fam != "poisson":
        d = deviations(got.ts, got.theta_scale, 1)
        assert abs(d.mean()) <= 0.2 and d.std() <= 1
    # at the maximum the gradient is as good as 0
    assert (got.gradient_norm < 1e-2).all()


@pytest.mark.parametrize("strategy", ["DEFAULT", "gd"])
def test_strategies_agree(simulated, strategy):
    sim = simulated["nb"]
    a = fit.fit_nb(sim.input, strategy="DEFAULT").toPandas().set_index("feature")
    b = fit.fit_nb(sim.input, strategy=strategy, max_steps=400).toPandas().set_index("feature").loc[a.index]
    assert np.allclose(a.ll, b.ll, rtol=1e-3)


def test_blocks_and_order_change_nothing(simulated):
    sim = simulated["nb"]
    a = fit.fit_nb(sim.input, blocks=1).toPandas().set_index("feature").sort_index()
    again = GlmInput(sim.input.x.orderBy(F.rand(5)), sim.input.design, sim.input.loc_names, sim.input.scale_names, meta=sim.input.meta)
    b = fit.fit_nb(again, blocks=7).toPandas().set_index("feature").sort_index()
    assert np.allclose(np.stack(a.theta_loc), np.stack(b.theta_loc), atol=1e-5) and np.allclose(a.ll, b.ll)


def test_all_zero_feature(spark, simulated):
    sim = simulated["nb"]
    names = [*sim.input.meta["features"], "none"]
    inp = GlmInput(sim.input.x, sim.input.design, sim.input.loc_names, sim.input.scale_names, meta={"features": names})
    got = {r.feature: r for r in fit.fit_nb(inp).collect()}
    assert len(got) == 21 and np.isfinite(got["none"].theta_loc).all() and np.isfinite(got["none"].ll)
    assert got["feature_0"].status == "converged"


def one_factor(spark, values, **kw):
    obs = spark.createDataFrame([(k, g) for k, g in enumerate("aabbb")], "obs_id int, g string")
    from tessera.plans.formula import design_matrix

    x = spark.createDataFrame([(k, "f", float(v)) for k, v in enumerate(values) if v], "obs_id int, feature string, x double")
    return GlmInput.from_tables(x, obs, design_matrix(obs, "~1+g"), **kw)


def test_saturated_fits_are_group_means(spark):
    inp = one_factor(spark, [1, 3, 0, 4, 8])
    for fam in ("poisson", "nb"):
        for init in ("standard", "all_zero", "closed_form", "AUTO"):
            theta = fit.fit(inp, fam, init_location=init).first().theta_loc
            assert theta == pytest.approx([np.log(2), np.log(2)], abs=1e-4)
    assert fit.fit_norm(inp).first().theta_loc == pytest.approx([2, 2])
    assert np.exp(fit.fit_norm(inp).first().theta_scale[0]) == pytest.approx(np.sqrt((1 + 1 + 16 + 0 + 16) / 5), rel=1e-4)


def test_poisson_as_the_library(spark, simulated):
    """Against Spark's own one-model GLM."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GeneralizedLinearRegression

    sim = simulated["poisson"]
    one = sim.input.subset_features("feature_3")
    mine = fit.fit_poisson(one).first()
    dense = sim.input.design.join(one.x, "obs_id", "left").fillna({"x": 0.0}).select("x", array_to_vector(F.slice("loc", 2, 4)).alias("v"))
    lib = GeneralizedLinearRegression(family="poisson", featuresCol="v", labelCol="x", tol=1e-10, maxIter=100).fit(dense)
    assert mine.theta_loc == pytest.approx([lib.intercept, *lib.coefficients], abs=1e-5)


def test_constraints_hold(spark):
    obs = spark.createDataFrame([(k, "ab"[k % 2], "stuv"[k % 4]) for k in range(40)], "obs_id int, condition string, batch string")
    system = constraint_system({"batch": "condition"}, sample_description=obs, formula="~1+condition+batch")
    rng = np.random.default_rng(1)
    x = spark.createDataFrame([(k, "f", float(rng.poisson(20 + 5 * (k % 4)))) for k in range(40)], "obs_id int, feature string, x double")
    inp = GlmInput.from_tables(x, obs, system.design, constraints_loc=system.matrix)
    theta = np.asarray(fit.fit_poisson(inp, init_location="standard").first().theta_loc)
    full = dict(zip(system.names, system.matrix @ theta, strict=True))
    assert full["batch[s]"] + full["batch[u]"] == pytest.approx(0) and full["batch[t]"] + full["batch[v]"] == pytest.approx(0)


def test_scores_are_zero_at_the_fit(simulated):
    sim = simulated["poisson"]
    fitted = fit.fit_poisson(sim.input).select("feature", "theta_loc", "theta_scale")
    norm = kernels.corrected_gradient_norm(sim.input, fitted, "poisson")
    assert norm.agg(F.max("norm")).first()[0] < 1e-5


def test_hessian_is_the_gradients_derivative(spark):
    inp = one_factor(spark, [1, 3, 0, 4, 8])
    at = lambda a, b, s: inp.features().select("feature", F.array(F.lit(a), F.lit(b)).alias("theta_loc"), F.array(F.lit(s)).alias("theta_scale"))
    base, h = (0.4, 0.3, 0.2), 1e-5
    for fam in ("nb", "norm", "poisson"):
        hess = np.array(kernels.hessian(inp, at(*base), fam).first().hessian)
        for k in range(len(hess)):
            lo, hi = list(base), list(base)
            lo[k] -= h
            hi[k] += h
            diff = (np.array(kernels.jacobian(inp, at(*hi), fam).first().jac) - np.array(kernels.jacobian(inp, at(*lo), fam).first().jac)) / (2 * h)
            assert np.allclose(hess[k], diff, rtol=1e-5, atol=1e-5)
    with pytest.raises(NoScaleError):
        kernels.scale_kernel("poisson", "jac_scale")


def test_refusals(spark):
    inp = one_factor(spark, [1, 3, 0, 4, 8])
    with pytest.raises(ValueError):
        fit.fit_nb(inp, init_location="random")
    with pytest.raises(ValueError):
        fit.fit_nb(inp, init_scale="random")
    with pytest.raises(NotImplementedError):
        fit.fit(inp, "beta")
    with pytest.raises(ValueError):
        fit.strategy_phases("newton")
    two = GlmInput(inp.x, inp.design.withColumn("scale", F.col("loc")), inp.loc_names, inp.loc_names)
    with pytest.raises(ValueError, match="more than one scale"):
        fit.fit_nb(two)
    assert fit.fit_nb(inp, quick_scale=True).first().theta_scale == pytest.approx(fit.init_par(inp, "nb")[0].first().theta_scale)


def test_too_many_groups(spark):
    obs = spark.range(600).selectExpr("cast(id as int) as obs_id", "cast(id as double) as z", "1.0 as one")
    x = spark.range(600).selectExpr("cast(id as int) as obs_id", "'f' as feature", "1.0 as x")
    inp = GlmInput.from_tables(x, obs, ["one", "z"])
    with pytest.raises(ValueError, match="distinct design rows"):
        moments.design_groups(inp)
    assert fit.fit_poisson(inp).first().theta_loc == pytest.approx([0, 0], abs=1e-6)


def test_linear_helpers():
    a = np.array([[[2.0, 0], [0, 4]], [[1, 1], [1, 1]], [[np.inf, 0], [0, 1]]])
    b = np.array([[2.0, 4], [1, 1], [1, 1]])
    assert solve_or_zero(a, b).tolist() == [[1, 1], [0, 0], [0, 0]]
    assert inverse_or_zero(a)[1].tolist() == [[0, 0], [0, 0]]
    assert np.allclose(moments.stacked_lstsq(a[:2], b[:2, :, None])[..., 0], [[1, 1], [0.5, 0.5]])


def test_binning(spark):
    df = spark.createDataFrame([(k, float((k * 7) % 20)) for k in range(20)], "obs_id int, v double")
    got = bin_continuous_covariate(df, "v", 4).toPandas()
    assert (got.v_binned == got.v // 5 + 1).all()
    got = bin_continuous_covariate(df, "v", [0.0, 0.9]).toPandas()
    assert (got.v_binned == np.where(got.v >= 18, 2, 1)).all()
    with pytest.raises(TypeError):
        bin_continuous_covariate(df, "v", "four")
    assert bin_continuous_covariate(df.limit(0), "v", 3).count() == 0


def test_simulation_is_reproducible(spark):
    a = generate_artificial_data(spark, "beta", 30, 3, seed=1).input.x
    b = generate_artificial_data(spark, "beta", 30, 3, seed=1).input.x.repartition(7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    shuffled = sample_description(spark, 40, 2, 4, shuffle=True).toPandas()
    assert shuffled.condition.value_counts().tolist() == [20, 20] and shuffled.batch.value_counts().tolist() == [10] * 4


def test_diagnostics(spark, tmp_path):
    rows = [("a", [1.0, 2.0]), ("b", [2.0, 1.0]), ("c", [4.0, 0.0])]
    true = spark.createDataFrame(rows, "feature string, theta_loc array<double>")
    pred = true.withColumn("theta_loc", F.transform("theta_loc", lambda v: 2 * v + 1))
    pairs = diagnostics.coefficient_pairs(true, pred, ["i", "j"])
    assert all(r.pearson_r == pytest.approx(1) for r in diagnostics.coef_vs_ref(pairs).collect())
    got = {r.coef: r for r in diagnostics.deviation_summary(pairs).collect()}
    assert got["i"]["mean"] == pytest.approx(10 / 3) and got["j"].q50 == 2.0
    with pytest.raises(ValueError):
        diagnostics.coefficient_pairs(true, pred.limit(2), ["i", "j"])
    diagnostics.save(pairs, str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x_parameter_scatter")).count() == 6


def test_streamed_cells_equal_batch(spark, tmp_path):
    from tessera.streaming.cells import accumulate, read_cells

    inp = one_factor(spark, [1, 3, 2, 4, 8])
    dense = inp.x.join(inp.design, "obs_id").drop("obs_id")
    for part in range(2):
        dense.where(f"x % 2 = {part}").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(dense.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    accumulate(stream, str(tmp_path / "cells"), str(tmp_path / "check")).awaitTermination(120)
    key = lambda df: sorted((r.feature, tuple(r["loc"]), r.x, r.cnt) for r in df.collect())
    assert key(read_cells(spark, str(tmp_path / "cells"))) == key(inp.cells())
