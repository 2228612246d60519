"""Simulated data: sample descriptions, parameters and draws, reproducible whatever the partitioning."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.families import Family, family
from tessera.plans.formula import Design, design_matrix
from tessera.sources.input import GlmInput

Draw = Callable[[np.random.Generator, tuple], np.ndarray]

#: The families' default draws of the mean, of the other location and of the scale coefficients.
_uniform = lambda a, b: lambda rng, shape: rng.uniform(a, b, shape)
DEFAULT_DRAWS: dict[str, tuple[Draw, Draw, Draw]] = {
    "nb": (lambda rng, shape: rng.poisson(500, shape) + 1.0, lambda rng, s: np.log(np.abs(rng.uniform(0.5, 2, s))), lambda rng, s: np.log(np.abs(rng.uniform(0.5, 2, s)))),
    "poisson": (lambda rng, shape: rng.poisson(500, shape) + 1.0, lambda rng, s: np.log(np.abs(rng.uniform(0.5, 2, s))), lambda rng, s: np.log(np.abs(rng.uniform(0.5, 2, s)))),
    "norm": (_uniform(10, 1000), _uniform(50, 100), _uniform(1.5, 10)),
    "beta": (_uniform(0.2, 0.8), _uniform(0.05, 0.15), _uniform(0.2, 0.5)),
}


def sample_description(spark: SparkSession, n_obs: int, num_conditions: int = 2, num_batches: int = 4, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """(obs_id, condition, batch): conditions in turn, batches in blocks; 0 of either counts as 1. shuffle deals the rows anew."""
    c, b = max(num_conditions, 1), max(num_batches, 1)
    rows = spark.range(n_obs).withColumnRenamed("id", "obs_id")
    place = F.col("obs_id")
    if shuffle:
        from tessera.operators.covariates import ranked

        rows = ranked(rows.withColumn("__h", F.xxhash64(F.lit(seed), "obs_id")), ["__h", "obs_id"], "__place").drop("__h")
        place = F.col("__place")
    block = -(-n_obs // b) or 1
    out = rows.select("obs_id", (place % c).cast("string").alias("condition"), F.floor(place / block).cast("string").alias("batch"))
    return out


@dataclass
class Simulation:
    input: GlmInput
    params: DataFrame
    theta_loc: np.ndarray
    theta_scale: np.ndarray


def _link(fam: Family, v: np.ndarray) -> np.ndarray:
    return {"nb": np.log, "poisson": np.log, "norm": lambda x: x, "beta": lambda x: np.log(x / (1 - x))}[fam.name](v)


def generate_params(fam: Family | str, n_vars: int, p: int, q: int, seed: int = 0, rand_fn_ave: Draw | None = None, rand_fn_loc: Draw | None = None, rand_fn_scale: Draw | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Location (p, n_vars) and scale (q, n_vars) parameters on link scale; the first row links a drawn mean."""
    fam = family(fam)
    ave, loc, scale = DEFAULT_DRAWS[fam.name]
    rng = np.random.default_rng(seed)
    theta_loc = np.vstack([_link(fam, (rand_fn_ave or ave)(rng, (1, n_vars))), (rand_fn_loc or loc)(rng, (p - 1, n_vars))])
    return theta_loc, (rand_fn_scale or scale)(rng, (q, n_vars))


def _draw(fam: Family, rng: np.random.Generator, eta: np.ndarray, s: np.ndarray) -> np.ndarray:
    if fam.name == "nb":
        mu, r = np.exp(eta), np.exp(s)
        return rng.negative_binomial(r, r / (r + mu)).astype(float)
    if fam.name == "poisson":
        return rng.poisson(np.exp(eta)).astype(float)
    if fam.name == "norm":
        return rng.normal(eta, np.exp(s))
    m, n = 1 / (1 + np.exp(-eta)), np.exp(s)
    return rng.beta(m * n, (1 - m) * n)


def generate_artificial_data(
    spark: SparkSession,
    fam: Family | str,
    n_obs: int,
    n_vars: int,
    num_conditions: int = 2,
    num_batches: int = 4,
    intercept_scale: bool = False,
    shuffle_assignments: bool = False,
    seed: int = 0,
    theta_location_setter: Callable[[np.ndarray], np.ndarray] | None = None,
    theta_scale_setter: Callable[[np.ndarray], np.ndarray] | None = None,
    **draws,
) -> Simulation:
    """A sample description, parameters and data of a family; values depend on the seed, observation and family alone."""
    fam = family(fam)
    samples = sample_description(spark, n_obs, num_conditions, num_batches, shuffle_assignments, seed)
    formula = "~1" + ("+condition" if num_conditions > 1 else "") + ("+batch" if num_batches > 1 else "")
    loc: Design = design_matrix(samples, formula)
    scale: Design = design_matrix(samples, "~1" if intercept_scale else formula)
    theta_loc, theta_scale = generate_params(fam, n_vars, len(loc.names), len(scale.names), seed, **draws)
    theta_loc = theta_location_setter(theta_loc) if theta_location_setter else theta_loc
    theta_scale = theta_scale_setter(theta_scale) if theta_scale_setter else theta_scale
    features = [f"feature_{k}" for k in range(n_vars)]

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for obs, a, b in pdf.itertuples(index=False):
                x = _draw(fam, np.random.default_rng([seed, int(obs)]), np.asarray(a) @ theta_loc, np.asarray(b) @ theta_scale)
                keep = np.flatnonzero(x)
                yield pd.DataFrame({"obs_id": obs, "feature": [features[k] for k in keep], "x": x[keep]})

    rows = samples.select("obs_id", loc.array().alias("a"), scale.array().alias("b"))
    x = rows.mapInPandas(draw, "obs_id long, feature string, x double")
    inp = GlmInput.from_tables(x, samples, loc, scale)
    inp.meta["features"] = features
    table = [(f, [float(v) for v in theta_loc[:, k]], [float(v) for v in theta_scale[:, k]]) for k, f in enumerate(features)]
    return Simulation(inp, spark.createDataFrame(table, "feature string, theta_loc array<double>, theta_scale array<double>"), theta_loc, theta_scale)
