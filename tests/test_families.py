import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import families as fm


@pytest.mark.parametrize("name,x,eta,s", [("nb", 7.0, 1.3, 0.8), ("nb", 0.0, -0.5, 2.0), ("poisson", 4.0, 1.1, 0.0), ("norm", 3.0, 1.2, 0.4)])
def test_weights_are_derivatives(name, x, eta, s):
    fam, h = fm.family(name), 1e-4
    ll = lambda e, t: float(fm.ll_np(fam, np.array([x]), np.array([e]), np.array([t]))[0])
    w = {k: float(v[0]) for k, v in fm.weights_np(fam, np.array([x]), np.array([eta]), np.array([s])).items()}
    second = lambda f: (f(h) - 2 * f(0) + f(-h)) / h**2
    assert w["fim_ll"] * w["ybar"] == pytest.approx((ll(eta + h, s) - ll(eta - h, s)) / (2 * h), rel=1e-5, abs=1e-7)
    assert w["hess_ll"] == pytest.approx(second(lambda d: ll(eta + d, s)), rel=1e-4, abs=1e-5)
    if fam.has_scale:
        assert w["jac_scale"] == pytest.approx((ll(eta, s + h) - ll(eta, s - h)) / (2 * h), rel=1e-5, abs=1e-7)
        assert w["hess_ss"] == pytest.approx(second(lambda d: ll(eta, s + d)), rel=1e-4, abs=1e-5)
        cross = (ll(eta + h, s + h) - ll(eta + h, s - h) - ll(eta - h, s + h) + ll(eta - h, s - h)) / (4 * h * h)
        assert w["hess_ls"] == pytest.approx(cross, rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("name", ["nb", "poisson", "norm"])
def test_columns_equal_numpy(spark, name):
    fam = fm.family(name)
    rows = [(float(x), e, s) for x in (0, 1, 5, 40) for e in (-1.0, 0.5, 3.0) for s in (-1.0, 0.3, 12.0)]
    df = spark.createDataFrame(rows, "x double, eta double, s double")
    cols = fm.weight_cols(fam, F.col("x"), F.col("eta"), F.col("s")) | {"ll": fm.ll_col(fam, F.col("x"), F.col("eta"), F.col("s"))}
    got = df.select(*[c.alias(k) for k, c in cols.items()]).toPandas()
    x, e, s = (np.array(v) for v in zip(*rows, strict=True))
    want = fm.weights_np(fam, x, e, s) | {"ll": fm.ll_np(fam, x, e, s)}
    for k in want:
        assert np.allclose(got[k], want[k], rtol=1e-6, atol=1e-7), k


def test_bounds_and_clip(spark):
    low, high = fm.NB.bounds()["eta_loc"]
    assert low == pytest.approx(-297.776, abs=1e-3) and high == pytest.approx(283.913, abs=1e-3)
    assert fm.BETA.bounds()["theta_location"][1] == pytest.approx(14.6947, abs=1e-3)
    f32 = fm.NB.bounds("float32")["eta_loc"]
    assert f32 == (pytest.approx(-41.3116, abs=1e-3), pytest.approx(35.4891, abs=1e-3))
    rows = [(float("nan"),), (float("-inf"),), (1e9,), (0.5,), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "v double").select(fm.clip_col(F.col("v"), low, high)).collect()]
    assert np.isnan(got[0]) and got[1:] == [low, high, 0.5, None]


def test_what_families_lack():
    with pytest.raises(NotImplementedError):
        fm.ll_np(fm.BETA, 0.5, 0.0, 0.0)
    with pytest.raises(ValueError):
        fm.BETA.eta_loc(None, "size factor")
    with pytest.raises(ValueError):
        fm.family("gamma")


def test_compatible_poisson_term():
    x = np.array([0.0, 1.0, 5.0])
    assert fm.ll_np(fm.POISSON, x, np.zeros(3), compat=True)[:2].tolist() == [10_000.0, 10_000.0]
