import math

import numpy as np
import pytest

import tessera as ts


def matrix(spark, n=40, size_factors=None, seed=0):
    rng = np.random.default_rng(seed)
    design = np.stack([np.ones(n), np.arange(n) % 2], axis=1)
    x = rng.poisson(3, (n, 3)).astype(float)
    return ts.GlmInput.from_matrix(spark, x, design, ["a", "b"], size_factors=size_factors), x, design


def test_named_parameters(spark):
    inp, x, design = matrix(spark)
    params = spark.createDataFrame([(str(k), [0.5 + k, 0.25], [0.1]) for k in range(3)], "feature string, theta_loc array<double>, theta_scale array<double>")
    m = ts.Model(inp, "nb", params)
    rows = m["mu"].collect()
    assert sum(r.cnt for r in rows) == x.size
    assert all(math.isclose(r.mu, math.exp(0.5 + int(r.feature) + 0.25 * r["loc"][1])) for r in rows)
    assert {round(r.phi, 12) for r in m.get("phi", ["1"]).collect()} == {round(math.exp(0.1), 12)}
    assert {r.feature: r.theta_location_constrained for r in m["theta_location_constrained"].collect()} == {str(k): [0.5 + k, 0.25] for k in range(3)}
    with pytest.raises(KeyError):
        m["sd"]
    beta = ts.Model(inp, "beta", params)
    got = beta["p"].first()
    assert 0 < got.p < math.exp(0.1) and set(beta.names()) >= {"mean", "samplesize", "p", "q"}


def test_zeros_of_many_design_rows_are_counted_without_a_cross_join(spark):
    sf = np.linspace(-0.5, 0.5, 620)
    inp, x, _ = matrix(spark, 620, sf, 1)
    cells = inp.cells()
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    got = {r.feature: (r.n, r.s) for r in cells.groupBy("feature").agg({"cnt": "sum", "x": "count"}).selectExpr("feature", "`sum(cnt)` as n", "`count(x)` as s").collect()}
    assert all(n == 620 for n, _ in got.values()) and len(got) == 3


def test_a_poisson_fit_with_a_size_factor_per_observation_is_the_maximum(spark):
    rng = np.random.default_rng(2)
    sf, n = rng.normal(0, 0.4, 600), 600
    design = np.stack([np.ones(n), np.arange(n) % 2], axis=1)
    x = rng.poisson(np.exp(-0.7 + sf)[:, None], (n, 2)).astype(float)
    inp = ts.GlmInput.from_matrix(spark, x, design, ["a", "b"], size_factors=sf)
    for r in ts.fit_poisson(inp).collect():
        theta, y = np.zeros(2), x[:, int(r.feature)]
        for _ in range(50):
            mu = np.exp(design @ theta + sf)
            theta += np.linalg.solve((design * mu[:, None]).T @ design, design.T @ (y - mu))
        assert np.allclose(r.theta_loc, theta, atol=1e-6)


def test_a_family_of_ones_own(spark):
    from pyspark.sql import functions as F

    inp, x, design = matrix(spark)
    limits = lambda dtype, margin: ts.POISSON.bounds(dtype, margin)
    fam = ts.Family("rate", F.ln, F.exp, F.ln, F.exp, has_scale=False, trainable=False, limits=limits, ll_column=lambda x, eta, s: x * eta - F.exp(eta), weight_columns=lambda x, eta, s: {})
    ts.register(fam)
    try:
        params = spark.createDataFrame([(str(k), [0.5, 0.25], [0.0]) for k in range(3)], "feature string, theta_loc array<double>, theta_scale array<double>")
        got = {r.feature: r.ll for r in ts.log_likelihood(inp, params, "rate").collect()}
        eta = design @ np.array([0.5, 0.25])
        assert all(math.isclose(got[str(k)], float((x[:, k] * eta - np.exp(eta)).sum())) for k in range(3))
        with pytest.raises(ValueError):
            ts.register(fam)
    finally:
        ts.FAMILIES.pop("rate")


def test_a_null_size_factor_is_refused(spark):
    from pyspark.errors import PySparkException

    x = spark.createDataFrame([(1, "f", 2.0), (2, "f", 1.0)], "obs_id long, feature string, x double")
    d = spark.createDataFrame([(1, 1.0, 0.5), (2, 1.0, None)], "obs_id long, one double, sf double")
    with pytest.raises(PySparkException):
        ts.GlmInput.from_tables(x, d, ["one"], size_factor_col="sf").cells().collect()
