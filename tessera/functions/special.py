"""lgamma, digamma and trigamma, as Spark columns and as numpy functions.

Both shift the argument up by ten and use the asymptotic series there; arguments are positive.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 10
HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)
#: Bernoulli numbers B2, B4, ... B14.
BERNOULLI = (1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6)


def _series(z, weights, first: int):
    """sum of weights[k] / z**(first + 2k), by Horner's rule."""
    inv2 = 1.0 / (z * z)
    total = inv2 * 0.0 + weights[-1]
    for w in reversed(weights[:-1]):
        total = total * inv2 + w
    return total / z if first == 1 else total / (z * z) if first == 2 else total / (z * z * z)


_LG = [b / ((2 * k + 2) * (2 * k + 1)) for k, b in enumerate(BERNOULLI)]
_DG = [b / (2 * k + 2) for k, b in enumerate(BERNOULLI)]


def lgamma(z: np.ndarray) -> np.ndarray:
    z = np.asarray(z, float)
    prod = np.ones_like(z)
    for k in range(SHIFT):
        prod = prod * (z + k)
    y = z + SHIFT
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        small = (y - 0.5) * np.log(y) - y + HALF_LOG_2PI + _series(y, _LG, 1) - np.log(prod)
        large = (z - 0.5) * np.log(z) - z + HALF_LOG_2PI + _series(z, _LG, 1)
    return np.where(z > 1e6, large, small)


def digamma(z: np.ndarray) -> np.ndarray:
    z = np.asarray(z, float)
    down = sum(1.0 / (z + k) for k in range(SHIFT))
    y = z + SHIFT
    return np.log(y) - 0.5 / y - _series(y, _DG, 2) - down


def trigamma(z: np.ndarray) -> np.ndarray:
    z = np.asarray(z, float)
    down = sum(1.0 / (z + k) ** 2 for k in range(SHIFT))
    y = z + SHIFT
    return 1.0 / y + 0.5 / (y * y) + _series(y, BERNOULLI, 3) + down


def lgamma_ratio(r: np.ndarray, x: np.ndarray) -> np.ndarray:
    """lgamma(r + x) - lgamma(r) for x >= 0, also where r is so large that the difference would cancel."""
    r, x = np.broadcast_arrays(np.asarray(r, float), np.asarray(x, float))
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        plain = lgamma(r + x) - lgamma(r)
        # Stirling's terms regrouped: (r - 1/2) log1p(x/r) + x ln(r + x) - x
        far = (r - 0.5) * np.log1p(x / r) + x * (np.log(r) + np.log1p(x / r)) - x
    return np.where(r > 1e4, far + np.where(np.isfinite(r), _series(r + x, _LG, 1) - _series(r, _LG, 1), 0.0), plain)


def ln_or_inf(c: Column) -> Column:
    """Natural log; minus infinity at 0 (Spark's is null), null below."""
    return F.when(c > 0, F.ln(c)).when(c == 0, F.lit(float("-inf")))


def lgamma_col(z: Column) -> Column:
    y = z + SHIFT
    prod = z
    for k in range(1, SHIFT):
        prod = prod * (z + k)
    small = (y - 0.5) * F.ln(y) - y + HALF_LOG_2PI + _series(y, _LG, 1) - F.ln(prod)
    large = (z - 0.5) * F.ln(z) - z + HALF_LOG_2PI + _series(z, _LG, 1)
    return F.when(z > 1e6, large).otherwise(small)


def digamma_col(z: Column) -> Column:
    down = 1.0 / z
    for k in range(1, SHIFT):
        down = down + 1.0 / (z + k)
    y = z + SHIFT
    return F.ln(y) - 0.5 / y - _series(y, _DG, 2) - down


def trigamma_col(z: Column) -> Column:
    down = 1.0 / (z * z)
    for k in range(1, SHIFT):
        down = down + 1.0 / ((z + k) * (z + k))
    y = z + SHIFT
    return 1.0 / y + 0.5 / (y * y) + _series(y, BERNOULLI, 3) + down
