"""Small dense linear algebra, batched over features."""

from __future__ import annotations

import numpy as np


def invertible(a: np.ndarray) -> np.ndarray:
    """Which stacked matrices have a condition number under 1/eps."""
    if not len(a):
        return np.zeros(0, bool)
    with np.errstate(all="ignore"):
        finite = np.isfinite(a).all(axis=(1, 2))
        return finite & (np.linalg.cond(np.where(finite[:, None, None], a, 0.0)) < 1 / np.finfo(float).eps)


def solve_or_zero(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Solutions of the stacked systems; 0 where a system is not invertible."""
    good = invertible(a)
    out = np.zeros_like(b)
    if good.any():
        out[good] = np.linalg.solve(a[good], b[good][..., None])[..., 0]
    return out


def inverse_or_zero(a: np.ndarray) -> np.ndarray:
    good = invertible(a)
    out = np.zeros_like(a)
    if good.any():
        out[good] = np.linalg.inv(a[good])
    return out
