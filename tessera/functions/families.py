"""Families: links, bounds, likelihoods and derivative weights, as columns and as numpy kernels.

eta is the linear predictor of the location and s that of the scale, both on link scale; mu and r are
their inverse links. The derivative weights follow the likelihood: d ll / d eta = W * ybar, and with
respect to s the score weight. Where a published form disagrees with the likelihood's derivative, the
derivative is used.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.plans.settings import SETTINGS

from .special import HALF_LOG_2PI, digamma, digamma_col, lgamma, lgamma_col, lgamma_ratio, ln_or_inf, trigamma, trigamma_col

#: How far inside the number range parameters stay; part of the results, see Settings.
MARGIN = SETTINGS.margin


def clip_col(c: Column, low: float, high: float) -> Column:
    """c within [low, high]; NaN stays NaN and null stays null."""
    return F.when(F.isnan(c), c).when(c.isNotNull(), F.greatest(F.least(c, F.lit(float(high))), F.lit(float(low))))


class NoScaleError(ValueError):
    """The family has no scale model."""


@dataclass(frozen=True)
class Family:
    name: str
    link_loc: Callable[[Column], Column]
    inverse_loc: Callable[[Column], Column]
    link_scale: Callable[[Column], Column]
    inverse_scale: Callable[[Column], Column]
    has_scale: bool = True
    trainable: bool = True
    additive_offset: bool = True
    clips_eta: bool = True
    #: What a family of the user's own brings along (see register): limits as bounds() returns them, and the likelihood
    #: and its derivatives' weights as columns (x, eta, s) and as arrays, as ll_col, weight_cols, ll_np and weights_np return them.
    limits: Callable[[str, float], dict[str, tuple[float, float]]] | None = None
    ll_column: Callable[[Column, Column, Column | None], Column] | None = None
    weight_columns: Callable[[Column, Column, Column | None], dict[str, Column]] | None = None
    ll_array: Callable | None = None
    weight_arrays: Callable | None = None
    #: Names of the location, the scale and what derives from them, for Model.
    location_name: str = "location"
    scale_name: str = "scale"

    def bounds(self, dtype: str = "float64", margin: float = MARGIN) -> dict[str, tuple[float, float]]:
        """Limits of parameters, predictors and likelihood terms in the given precision."""
        if self.limits is not None:
            return self.limits(dtype, margin)
        info = np.finfo(dtype)
        top, tiny = float(info.max), float(np.nextafter(np.dtype(dtype).type(0), np.dtype(dtype).type(1)))
        log_low, log_high = math.log(tiny) / margin, math.log(top) / margin
        out = {"theta_scale": (log_low, log_high), "eta_scale": (log_low, log_high), "scale": (tiny, top / margin)}
        if self.name in ("nb", "poisson"):
            out |= {"theta_location": (log_low, log_high), "eta_loc": (log_low, log_high), "loc": (tiny, top / margin)}
            out["ll"] = (math.log(tiny), 0.0 if self.name == "nb" else 10_000.0)
        elif self.name == "norm":
            out |= {k: (-top / margin, top / margin) for k in ("theta_location", "eta_loc", "loc")}
            out["ll"] = (math.log(tiny), top)
        else:
            eps = float(info.eps)
            high = math.log((1 - eps) / eps) / margin if dtype == "float32" else -math.log(np.finfo("float64").epsneg) / margin
            out |= {k: (log_low, high) for k in ("theta_location", "eta_loc")} | {"loc": (tiny, 1 - eps), "ll": (math.log(tiny), 0.0)}
        return out

    def eta_loc(self, dot: Column, size_factor: Column | None, clip: bool | None = None) -> Column:
        """The location's predictor: size factors are added on log scale, multiplied for the normal family, refused for beta."""
        if size_factor is not None:
            if self.name == "beta":
                raise ValueError("the beta family takes no size factors")
            dot = dot + size_factor if self.additive_offset else dot * size_factor
        return clip_col(dot, *self.bounds()["eta_loc"]) if (self.clips_eta if clip is None else clip) else dot


_log = dict(link_scale=ln_or_inf, inverse_scale=F.exp)
NB = Family("nb", ln_or_inf, F.exp, **_log, location_name="mu", scale_name="phi")
POISSON = Family("poisson", ln_or_inf, F.exp, **_log, has_scale=False, location_name="lam")
NORM = Family("norm", lambda c: c, lambda c: c, **_log, additive_offset=False, clips_eta=False, location_name="mean", scale_name="sd")
BETA = Family("beta", lambda c: F.ln(c / (1 - c)), lambda c: 1 / (1 + F.exp(-c)), **_log, trainable=False, clips_eta=False, location_name="mean", scale_name="samplesize")
FAMILIES = {f.name: f for f in (NB, POISSON, NORM, BETA)}


def register(fam: Family) -> Family:
    """Add a family of one's own by its name. It needs limits and the likelihood and weights as columns; to be fitted, also as arrays."""
    if fam.name in FAMILIES:
        raise ValueError(f"there is a family {fam.name!r}")
    missing = [k for k in ("limits", "ll_column", "weight_columns", *(("ll_array", "weight_arrays") if fam.trainable else ())) if getattr(fam, k) is None]
    if missing:
        raise ValueError(f"the family {fam.name!r} lacks {', '.join(missing)}")
    FAMILIES[fam.name] = fam
    return fam


def family(name: str | Family) -> Family:
    if isinstance(name, Family):
        return name
    if name not in FAMILIES:
        raise ValueError(f"no family {name!r}; there are {', '.join(FAMILIES)}")
    return FAMILIES[name]


# --- columns --------------------------------------------------------------------------------------


def ll_col(fam: Family, x: Column, eta: Column, s: Column | None = None, compat: bool = False) -> Column:
    """Log-likelihood of a value, clipped as the family's bounds say."""
    if fam.ll_column is not None:
        return fam.ll_column(x, eta, s)
    low, high = fam.bounds()["ll"]
    if fam.name == "nb":
        mu, r = F.exp(eta), F.exp(s)
        ln_rm = F.ln(r + mu)
        pair = F.when(r > 1e4, (r - 0.5) * F.log1p(x / r) + x * F.ln(r + x) - x).otherwise(lgamma_col(r + x) - lgamma_col(r))
        ll = pair - lgamma_col(x + 1) + x * (eta - ln_rm) + r * F.when(r > 1e4, -F.log1p(mu / r)).otherwise(s - ln_rm)
    elif fam.name == "poisson":
        term = lgamma_col(x + 1)
        if compat:
            term = F.when(x <= 1, F.lit(float("-inf"))).otherwise(F.ln(term))
        ll = x * eta - F.exp(eta) - term
    elif fam.name == "norm":
        z = (x - eta) / F.exp(s)
        return F.lit(-HALF_LOG_2PI) - s - 0.5 * z * z
    else:
        raise NotImplementedError("the beta family has no likelihood operators")
    return clip_col(ll, low, high)


def weight_cols(fam: Family, x: Column, eta: Column, s: Column | None = None) -> dict[str, Column]:
    """fim_ll, ybar, jac_scale, hess_ll, hess_ls, hess_ss and fim_ss of a value; those that the family lacks are left out."""
    if fam.weight_columns is not None:
        return fam.weight_columns(x, eta, s)
    if fam.name == "poisson":
        lam = F.exp(eta)
        return {"fim_ll": lam, "ybar": (x - lam) / lam, "hess_ll": -lam}
    if fam.name == "norm":
        sd = F.exp(s)
        z2 = (x - eta) * (x - eta) / (sd * sd)
        return {
            "fim_ll": 1 / (sd * sd), "ybar": x - eta, "jac_scale": z2 - 1, "hess_ll": -1 / (sd * sd),
            "hess_ls": -2 * (x - eta) / (sd * sd), "hess_ss": -2 * z2, "fim_ss": F.lit(2.0), "fim_ls": F.lit(0.0),
        }
    if fam.name == "nb":
        mu, r = F.exp(eta), F.exp(s)
        rm, rx = r + mu, r + x
        dpsi = digamma_col(rx) - digamma_col(r)
        return {
            "fim_ll": mu * r / rm, "ybar": (x - mu) / mu,
            "jac_scale": r * (dpsi - rx / rm + s + 1 - F.ln(rm)),
            "hess_ll": -mu * (x / r + 1) / ((mu / r + 1) * (mu / r + 1)),
            "hess_ls": mu * r * (x - mu) / (rm * rm),
            "hess_ss": r * (dpsi + r * (trigamma_col(rx) - trigamma_col(r)) - (mu * rx + 2 * r * rm) / (rm * rm) + s + 2 - F.ln(rm)),
        }
    raise NotImplementedError("the beta family has no derivative operators")


# --- numpy ----------------------------------------------------------------------------------------


def ll_np(fam: Family, x, eta, s=None, compat: bool = False) -> np.ndarray:
    if fam.ll_array is not None:
        return fam.ll_array(x, eta, s)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        low, high = fam.bounds()["ll"]
        if fam.name == "nb":
            mu, r = np.exp(eta), np.exp(s)
            ln_rm = np.logaddexp(s, eta)
            tail = np.where(r > 1e4, -r * np.log1p(mu / r), r * (s - ln_rm))
            return np.clip(lgamma_ratio(r, x) - lgamma(x + 1) + x * (eta - ln_rm) + tail, low, high)
        if fam.name == "poisson":
            term = lgamma(x + 1)
            if compat:
                term = np.where(x <= 1, -np.inf, np.log(np.maximum(term, 0)))
            return np.clip(x * eta - np.exp(eta) - term, low, high)
        if fam.name == "norm":
            z = (x - eta) / np.exp(s)
            return -HALF_LOG_2PI - s - 0.5 * z * z
    raise NotImplementedError("the beta family has no likelihood operators")


def weights_np(fam: Family, x, eta, s=None) -> dict[str, np.ndarray]:
    if fam.weight_arrays is not None:
        return fam.weight_arrays(x, eta, s)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        if fam.name == "poisson":
            lam = np.exp(eta)
            return {"fim_ll": lam, "ybar": (x - lam) / lam, "hess_ll": -lam}
        if fam.name == "norm":
            sd = np.exp(s)
            z2 = ((x - eta) / sd) ** 2
            one = np.ones_like(z2)
            return {"fim_ll": one / sd**2, "ybar": x - eta, "jac_scale": z2 - 1, "hess_ll": -one / sd**2, "hess_ls": -2 * (x - eta) / sd**2, "hess_ss": -2 * z2, "fim_ss": 2 * one}
        if fam.name == "nb":
            mu, r = np.exp(eta), np.exp(s)
            rm, rx, ln_rm = r + mu, r + x, np.logaddexp(s, eta)
            dpsi = digamma(rx) - digamma(r)
            return {
                "fim_ll": mu * r / rm, "ybar": (x - mu) / mu, "jac_scale": r * (dpsi - rx / rm + s + 1 - ln_rm),
                "hess_ll": -mu * (x / r + 1) / (mu / r + 1) ** 2, "hess_ls": mu * r * (x - mu) / rm**2,
                "hess_ss": r * (dpsi + r * (trigamma(rx) - trigamma(r)) - (mu * rx + 2 * r * rm) / rm**2 + s + 2 - ln_rm),
            }
    raise NotImplementedError("the beta family has no derivative operators")
