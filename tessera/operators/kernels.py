"""Likelihood, gradient, Hessian and information of fitted parameters, as one aggregation over cells.

params is a table (feature, theta_loc, theta_scale). Every sum over observations is a sum over cells times
their counts; the constrained design rows come from the cells' design arrays by literal weights.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.families import Family, NoScaleError, clip_col, family, ll_col, weight_cols
from tessera.operators.linear import solve_or_zero
from tessera.sources.input import GlmInput


def _dot(weights: Sequence[Column], theta: str) -> Column:
    return sum((w * F.element_at(theta, k + 1) for k, w in enumerate(weights)), F.lit(0.0))


def constrained(array: str, c: np.ndarray) -> list[Column]:
    """The columns of (design row) @ c."""
    return [sum((F.element_at(array, j + 1) * float(c[j, k]) for j in range(c.shape[0]) if c[j, k]), F.lit(0.0)) for k in range(c.shape[1])]


def predicted(inp: GlmInput, params: DataFrame, fam: Family | str) -> tuple[DataFrame, list[str], list[str]]:
    """Cells with their constrained design columns (a0.., b0..), eta, s, loc and scale."""
    fam = family(fam)
    a, b = constrained("loc", inp.c_loc()), constrained("scale", inp.c_scale())
    an, bn = [f"a{k}" for k in range(len(a))], [f"b{k}" for k in range(len(b))]
    cells = inp.cells().select("feature", "x", "cnt", "size_factor", *[c.alias(n) for c, n in zip(a + b, an + bn, strict=True)]).join(params, "feature")
    eta = fam.eta_loc(_dot([F.col(n) for n in an], "theta_loc"), F.col("size_factor") if inp.has_size_factors else None)
    s = clip_col(_dot([F.col(n) for n in bn], "theta_scale"), *fam.bounds()["eta_scale"]) if fam.has_scale else F.lit(0.0)
    cells = cells.withColumns({"eta": eta, "s": s}).withColumns({"location": fam.inverse_loc(F.col("eta")), "scale_value": fam.inverse_scale(F.col("s"))})
    return cells, an, bn


def log_likelihood(inp: GlmInput, params: DataFrame, fam: Family | str, compat: bool = False) -> DataFrame:
    """(feature, ll)."""
    fam = family(fam)
    cells, _, _ = predicted(inp, params, fam)
    return cells.groupBy("feature").agg(F.sum(F.col("cnt") * ll_col(fam, F.col("x"), F.col("eta"), F.col("s"), compat)).alias("ll"))


def _weights(fam: Family) -> dict[str, Column]:
    return weight_cols(fam, F.col("x").cast("double"), F.col("eta"), F.col("s"))


def _sums(cells: DataFrame, terms: dict[str, Column]) -> DataFrame:
    return cells.groupBy("feature").agg(*[F.sum(F.col("cnt") * c).alias(k) for k, c in terms.items()])


def jacobian(inp: GlmInput, params: DataFrame, fam: Family | str) -> DataFrame:
    """(feature, jac): the gradient of the log-likelihood, location coefficients first; Poisson has those alone."""
    fam = family(fam)
    cells, an, bn = predicted(inp, params, fam)
    w = _weights(fam)
    terms = {f"j_{n}": F.col(n) * w["fim_ll"] * w["ybar"] for n in an}
    if fam.has_scale:
        terms |= {f"j_{n}": F.col(n) * w["jac_scale"] for n in bn}
    return _sums(cells, terms).select("feature", F.array(*terms).alias("jac"))


def _block(cells: DataFrame, rows: list[str], cols: list[str], weight: Column, tag: str) -> dict[str, Column]:
    return {f"{tag}_{r}_{c}": F.col(r) * weight * F.col(c) for r in rows for c in cols}


def _square(names: list[list[str]]) -> Column:
    return F.array(*[F.array(*[F.col(n) for n in row]) for row in names])


def hessian(inp: GlmInput, params: DataFrame, fam: Family | str) -> DataFrame:
    """(feature, hessian): rows and columns in the order of the gradient."""
    fam = family(fam)
    cells, an, bn = predicted(inp, params, fam)
    w = _weights(fam)
    terms = _block(cells, an, an, w["hess_ll"], "aa")
    rows = [[f"aa_{r}_{c}" for c in an] for r in an]
    if fam.has_scale:
        terms |= _block(cells, an, bn, w["hess_ls"], "ab") | _block(cells, bn, bn, w["hess_ss"], "bb")
        rows = [row + [f"ab_{r}_{c}" for c in bn] for r, row in zip(an, rows, strict=True)]
        rows += [[f"ab_{c}_{r}" for c in an] + [f"bb_{r}_{c}" for c in bn] for r in bn]
    return _sums(cells, terms).select("feature", _square(rows).alias("hessian"))


def fisher_information(inp: GlmInput, params: DataFrame, fam: Family | str) -> DataFrame:
    """(feature, fim): the location block, and for the normal family the scale block with zeros between."""
    fam = family(fam)
    cells, an, bn = predicted(inp, params, fam)
    w = _weights(fam)
    terms = _block(cells, an, an, w["fim_ll"], "aa")
    rows = [[f"aa_{r}_{c}" for c in an] for r in an]
    out = _sums(cells, terms)
    if fam.name == "norm":
        terms |= _block(cells, bn, bn, w["fim_ss"], "bb")
        out = _sums(cells, terms).withColumn("zero", F.lit(0.0))
        rows = [row + ["zero"] * len(bn) for row in rows] + [["zero"] * len(an) + [f"bb_{r}_{c}" for c in bn] for r in bn]
    return out.select("feature", _square(rows).alias("fim"))


def scale_kernel(fam: Family | str, name: str) -> Column:
    """One derivative weight by name; NoScaleError for those that a family without a scale lacks."""
    fam = family(fam)
    found = _weights(fam)
    if name not in found:
        if not fam.has_scale:
            raise NoScaleError(f"the {fam.name} family has no {name}")
        raise NotImplementedError(f"the {fam.name} family has no {name}")
    return found[name]


def irls_system(inp: GlmInput, params: DataFrame, fam: Family | str) -> DataFrame:
    """(feature, a, b): normal equations a step = b of one reweighted step of the location."""
    fam = family(fam)
    cells, an, _ = predicted(inp, params, fam)
    w = _weights(fam)
    terms = _block(cells, an, an, w["fim_ll"], "aa") | {f"b_{n}": F.col(n) * w["fim_ll"] * w["ybar"] for n in an}
    return _sums(cells, terms).select("feature", _square([[f"aa_{r}_{c}" for c in an] for r in an]).alias("a"), F.array(*[f"b_{n}" for n in an]).alias("b"))


def irls_step(inp: GlmInput, params: DataFrame, fam: Family | str) -> DataFrame:
    """(feature, theta_loc): parameters after one step; features with a singular system stay."""
    def solve(a: pd.Series, b: pd.Series) -> pd.Series:
        mats = np.stack([np.stack(m) for m in a]) if len(a) else np.zeros((0, 1, 1))
        return pd.Series(list(solve_or_zero(mats, np.stack(list(b)))) if len(b) else [], dtype=object)

    step = F.pandas_udf(solve, "array<double>")
    system = irls_system(inp, params, fam).join(params, "feature")
    return system.select("feature", F.zip_with("theta_loc", step("a", "b"), lambda t, d: t + d).alias("theta_loc"))


def corrected_gradient_norm(inp: GlmInput, params: DataFrame, fam: Family | str) -> DataFrame:
    """(feature, norm): the gradient's absolute sum per observation."""
    n = inp.num_observations
    return jacobian(inp, params, fam).select("feature", F.aggregate("jac", F.lit(0.0), lambda t, j: t + F.abs(j / n)).alias("norm"))
