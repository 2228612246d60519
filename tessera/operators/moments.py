"""Groupwise moments and the closed-form estimates built on them, as aggregates and literal linear maps.

A closed form solves least squares on the distinct rows of design times constraints. The pseudo-inverse
of those rows is common to all features, so each coefficient is a fixed combination of group values.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.families import BETA, NB, NORM, POISSON, Family
from tessera.sources.input import MAX_GROUPS, GlmInput

logger = logging.getLogger("tessera")

RCOND = 1e-10
#: What is added to a mean before its log, and the least variance in excess of the mean.
TINY = float(np.nextafter(0, 1))
FLOOR = float(np.sqrt(np.nextafter(0, 1)))


def column_mean(inp: GlmInput) -> DataFrame:
    """(feature, mean) over all observations, zeros without a row included."""
    n = inp.num_observations
    sums = inp.x.groupBy("feature").agg(F.sum("x").alias("s"))
    return inp.features().join(sums, "feature", "left").select("feature", (F.coalesce("s", F.lit(0.0)) / n).alias("mean"))


@dataclass(frozen=True)
class Groups:
    """Distinct rows of a constrained design in ascending order, their place by design row, and the pseudo-inverse."""

    rows: np.ndarray
    solve: np.ndarray
    rank: int
    place: dict[tuple, int]

    def column(self, design: Column) -> Column:
        """The group's number of a design array."""
        out = F.lit(None).cast("int")
        for key, k in self.place.items():
            out = F.when(design == F.array(*[F.lit(float(v)) for v in key]), k).otherwise(out)
        return out


def design_groups(inp: GlmInput, side: str = "loc") -> Groups:
    """The distinct rows of D C; more than MAX_GROUPS raise ValueError, a rank deficit is logged."""
    c = inp.c_loc() if side == "loc" else inp.c_scale()
    found = [tuple(r[0]) for r in inp.design.select(side).distinct().limit(MAX_GROUPS + 1).collect()]
    if len(found) > MAX_GROUPS:
        raise ValueError(f"large least-square problem: more than {MAX_GROUPS} distinct design rows")
    products = {key: tuple(np.round(np.asarray(key) @ c, 12)) for key in found}
    rows = np.array(sorted(set(products.values()))).reshape(-1, c.shape[1])
    index = {tuple(r): k for k, r in enumerate(rows)}
    rank = int(np.linalg.matrix_rank(rows)) if len(rows) else 0
    if rank < c.shape[1]:
        logger.error("the constrained design has rank %d and %d columns", rank, c.shape[1])
    return Groups(rows, np.linalg.pinv(rows, rcond=RCOND), rank, {key: index[p] for key, p in products.items()})


def group_moments(inp: GlmInput, groups: Groups, side: str = "loc", divide: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(feature, g, n, mean, variance) with the population variance E[x²] - E[x]² of the values by size factor; divide is linear in the value."""
    value = F.col("x").cast("double")
    if inp.has_size_factors and divide is not None:
        value = divide(value, F.col("size_factor"))
    # a size factor scales a cell's values alike, so their first two powers are enough
    cells = inp.moment_cells().withColumn("v", value).withColumn("g", groups.column(F.col(side)))
    n, s, q = F.sum("cnt").cast("long"), F.sum(F.col("cnt") * F.col("v")), F.sum(F.col("cnt") * F.col("v") * F.col("v"))
    out = cells.groupBy("feature", "g").agg(n.alias("n"), s.alias("s"), q.alias("q"))
    mean = F.col("s") / F.col("n")
    return out.select("feature", "g", "n", mean.alias("mean"), (F.col("q") / F.col("n") - mean * mean).alias("variance"))


def solve_groups(values: DataFrame, groups: Groups, value: Column) -> DataFrame:
    """(feature, theta, rmsd): least squares of a value per (feature, g) on the groups' rows."""
    p = groups.rows.shape[1]
    picked = [F.sum(F.when(F.col("g") == k, value)).alias(f"v{k}") for k in range(len(groups.rows))]
    wide = values.groupBy("feature").agg(*picked)
    total = lambda row: sum((F.col(f"v{k}") * float(w) for k, w in enumerate(row) if w), F.lit(0.0))
    theta = wide.withColumn("theta", F.array(*[total(groups.solve[b]) for b in range(p)]))
    err = F.lit(0.0)
    for k, row in enumerate(groups.rows):
        fitted = sum((F.element_at("theta", b + 1) * float(w) for b, w in enumerate(row) if w), F.lit(0.0))
        err = err + (F.col(f"v{k}") - fitted) * (F.col(f"v{k}") - fitted)
    return theta.select("feature", "theta", F.sqrt(err / len(groups.rows)).alias("rmsd"))


def _divide(fam: Family, compat: bool) -> Callable[[Column, Column], Column]:
    """Values on the scale of a size factor of 1: by its exponential where factors add to a log, else by the factor."""
    return (lambda v, sf: v / F.exp(sf)) if fam.additive_offset and not compat else (lambda v, sf: v / sf)


def closed_form_mean(inp: GlmInput, link: Callable[[Column], Column], divide=None) -> DataFrame:
    """(feature, theta, rmsd) of the location from linked group means."""
    groups = design_groups(inp)
    return solve_groups(group_moments(inp, groups, divide=divide), groups, link(F.col("mean")))


def closed_form_scale(inp: GlmInput, compute: Callable[[Column, Column], Column], link: Callable[[Column], Column], divide=None) -> DataFrame:
    """(feature, theta, rmsd) of the scale from linked moment estimates compute(variance, mean) per scale group."""
    groups = design_groups(inp, "scale")
    return solve_groups(group_moments(inp, groups, "scale", divide), groups, link(compute(F.col("variance"), F.col("mean"))))


def nb_log_mean(inp: GlmInput, compat: bool = False) -> DataFrame:
    return closed_form_mean(inp, lambda m: F.ln(m + TINY), _divide(NB, compat))


def nb_phi(variance: Column, mean: Column) -> Column:
    return mean * mean / F.greatest(variance - mean, F.lit(FLOOR))


def _ln0(c: Column) -> Column:
    return F.when(c > 0, F.ln(c)).otherwise(F.lit(float("-inf")))


def nb_log_phi(inp: GlmInput, compat: bool = False) -> DataFrame:
    return closed_form_scale(inp, nb_phi, _ln0, _divide(NB, compat))


def poisson_log_rate(inp: GlmInput, compat: bool = False) -> DataFrame:
    return closed_form_mean(inp, lambda m: F.ln(m + TINY), _divide(POISSON, compat))


def norm_mean(inp: GlmInput) -> DataFrame:
    return closed_form_mean(inp, lambda m: m, _divide(NORM, True))


def norm_log_sd(inp: GlmInput) -> DataFrame:
    return closed_form_scale(inp, lambda v, m: F.sqrt(F.greatest(v, F.lit(0.0))), _ln0, _divide(NORM, True))


def beta_logit_mean(inp: GlmInput) -> DataFrame:
    if inp.has_size_factors:
        raise ValueError("the beta family takes no size factors")
    return closed_form_mean(inp, BETA.link_loc)


def beta_log_samplesize(inp: GlmInput) -> DataFrame:
    if inp.has_size_factors:
        raise ValueError("the beta family takes no size factors")
    return closed_form_scale(inp, lambda v, m: F.try_divide(m * (1 - m), v) - 1, _ln0)


def stacked_lstsq(a: np.ndarray, b: np.ndarray, rcond: float = RCOND) -> np.ndarray:
    """Least squares of stacked systems by singular values, those under rcond of the largest left out."""
    u, s, v = np.linalg.svd(a, full_matrices=False)
    keep = s >= rcond * s.max(axis=-1, keepdims=True)
    inverse = np.where(keep, 1 / np.where(keep, s, 1), 0)
    return np.swapaxes(v, -1, -2).conj() @ (inverse[..., None] * (np.swapaxes(u, -1, -2).conj() @ b))


def is_one_hot(rows: np.ndarray) -> bool:
    """Whether a design's values are exactly 0 and 1."""
    return set(np.unique(rows).tolist()) == {0.0, 1.0}
