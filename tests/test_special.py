import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import special as sp

POINTS = [1e-8, 1e-3, 0.3, 1.0, 1.5, 2.0, 7.7, 33.0, 1e3, 5e5, 2e6]


@pytest.mark.parametrize("z", POINTS)
def test_lgamma(z):
    assert sp.lgamma(z) == pytest.approx(math.lgamma(z), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("z", [0.3, 1.0, 2.5, 40.0, 1e4])
def test_digamma_and_trigamma_are_derivatives(z):
    h = 1e-5 * z
    assert sp.digamma(z) == pytest.approx((math.lgamma(z + h) - math.lgamma(z - h)) / (2 * h), rel=1e-6, abs=1e-7)
    assert sp.trigamma(z) == pytest.approx(float(sp.digamma(z + h) - sp.digamma(z - h)) / (2 * h), rel=1e-6)


def test_known_values():
    assert sp.digamma(1.0) == pytest.approx(-0.57721566490153286)
    assert sp.trigamma(1.0) == pytest.approx(math.pi**2 / 6)


@pytest.mark.parametrize("r", [0.5, 3.0, 9e3, 2e4, 1e9, 1e15, 1e100])
def test_ratio_for_any_size(r):
    x = 7
    assert float(sp.lgamma_ratio(r, x)) == pytest.approx(sum(math.log(r + i) for i in range(x)), rel=1e-10)


def test_columns_equal_numpy(spark):
    df = spark.createDataFrame([(z,) for z in POINTS], "z double")
    rows = df.select("z", sp.lgamma_col(F.col("z")).alias("l"), sp.digamma_col(F.col("z")).alias("d"), sp.trigamma_col(F.col("z")).alias("t")).collect()
    for r in rows:
        assert r.l == pytest.approx(float(sp.lgamma(r.z)), rel=1e-12, abs=1e-12)
        assert r.d == pytest.approx(float(sp.digamma(r.z)), rel=1e-12)
        assert r.t == pytest.approx(float(sp.trigamma(r.z)), rel=1e-12)


def test_log_at_zero(spark):
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,)], "x double").select(sp.ln_or_inf(F.col("x"))).collect()] == [float("-inf"), 0.0]
