"""A family's model of an input with given parameters: predictors, locations, scales and named parameters by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.families import Family, clip_col, family
from tessera.operators import kernels
from tessera.sources.input import GlmInput

#: Of each family, what its location and scale are called, and what follows from them.
DERIVED: dict[str, dict[str, Callable[[Column, Column], Column]]] = {
    "beta": {"p": lambda mean, size: mean * size, "q": lambda mean, size: (1 - mean) * size},
}


@dataclass(frozen=True)
class Model:
    """params: (feature, theta_loc, theta_scale), as init_par() and fit() give them. Everything is lazy; nothing is collected."""

    inp: GlmInput
    fam: Family | str
    params: DataFrame

    @property
    def family(self) -> Family:
        return family(self.fam)

    def names(self) -> list[str]:
        """What get() knows."""
        own = [self.family.location_name, *([self.family.scale_name] if self.family.has_scale else []), *DERIVED.get(self.family.name, {})]
        fixed = ["theta_location", "theta_scale", "theta_location_constrained", "theta_scale_constrained", "eta_loc", "eta_scale", "location", "scale"]
        return list(dict.fromkeys([*fixed, *own]))

    def _thetas(self, column: str, c: np.ndarray | None, name: str) -> DataFrame:
        values = F.col(column) if c is None else F.array(*[sum((F.element_at(column, k + 1) * float(w) for k, w in enumerate(row) if w), F.lit(0.0)) for row in c])
        return self.params.select("feature", values.alias(name))

    def cells(self, features: list[str] | None = None) -> DataFrame:
        """(feature, loc, scale_row, size_factor, x, cnt, eta_loc, eta_scale, location, scale) per cell, of some features or all."""
        inp, fam = (self.inp if features is None else self.inp.subset_features(features)), self.family
        rows = inp.cells().withColumnRenamed("scale", "scale_row").join(self.params.select("feature", "theta_loc", "theta_scale"), "feature")
        dot = lambda array, c, theta: sum((col * F.element_at(theta, k + 1) for k, col in enumerate(kernels.constrained(array, c))), F.lit(0.0))
        eta = fam.eta_loc(dot("loc", inp.c_loc(), "theta_loc"), F.col("size_factor") if inp.has_size_factors else None)
        s = clip_col(dot("scale_row", inp.c_scale(), "theta_scale"), *fam.bounds()["eta_scale"]) if fam.has_scale else F.lit(0.0)
        rows = rows.withColumns({"eta_loc": eta, "eta_scale": s})
        return rows.withColumns({"location": fam.inverse_loc(F.col("eta_loc")), "scale": fam.inverse_scale(F.col("eta_scale"))}).drop("theta_loc", "theta_scale")

    def get(self, name: str, features: list[str] | None = None) -> DataFrame:
        """(feature, name) for parameters, (feature, loc, scale_row, size_factor, x, cnt, name) for what each cell has."""
        if name not in self.names():
            raise KeyError(f"{self.family.name} models have no {name!r}; they have {', '.join(self.names())}")
        thetas = {
            "theta_location": ("theta_loc", None), "theta_scale": ("theta_scale", None),
            "theta_location_constrained": ("theta_loc", self.inp.c_loc()), "theta_scale_constrained": ("theta_scale", self.inp.c_scale()),
        }
        if name in thetas:
            out = self._thetas(*thetas[name], name)
            return out if features is None else out.where(F.col("feature").isin(list(features)))
        value = {"eta_loc": "eta_loc", "eta_scale": "eta_scale", "location": "location", "scale": "scale", self.family.location_name: "location", self.family.scale_name: "scale"}.get(name)
        column = F.col(value) if value else DERIVED[self.family.name][name](F.col("location"), F.col("scale"))
        return self.cells(features).withColumn("__value", column).select("feature", "loc", "scale_row", "size_factor", "x", "cnt", F.col("__value").alias(name))

    def __getitem__(self, name: str) -> DataFrame:
        return self.get(name)

    def log_likelihood(self) -> DataFrame:
        return kernels.log_likelihood(self.inp, self.params, self.fam)

    def fisher_information(self) -> DataFrame:
        return kernels.fisher_information(self.inp, self.params, self.fam)
