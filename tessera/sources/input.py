"""GlmInput: a data matrix in long form with its designs, constraints and size factors.

x has one row per observation and feature (obs_id, feature, x); a missing row is a 0. The design table has
one row per observation: loc and scale design rows (arrays) and a size factor.
"""

from __future__ import annotations

import logging
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.constraints import free_names
from tessera.plans.formula import Design

logger = logging.getLogger("tessera")

#: Distinct design rows that closed forms are worked out for, and up to which sparse zeros are spread without a join.
MAX_GROUPS = 500
#: Blocks of design rows beyond that.
BLOCKS = 64


def parse_design(design, names: Sequence[str] | None = None) -> tuple[np.ndarray, list[str]]:
    """Rows and names of a driver-side design: a pandas frame (its own names win), or an array with names."""
    if isinstance(design, pd.DataFrame):
        if names is not None:
            logger.warning("the design has names of its own; the names given are ignored")
        rows, names = design.to_numpy(dtype=float), [str(c) for c in design.columns]
    elif isinstance(design, np.ndarray):
        if names is None:
            raise ValueError("an array design needs names")
        rows, names = design.astype(float), list(names)
    else:
        raise ValueError(f"a design of type {type(design)} is not known")
    if rows.ndim != 2 or rows.shape[1] != len(names):
        raise AssertionError("a design has one name per column")
    return rows, names


def parse_size_factors(size_factors, n_obs: int) -> np.ndarray | None:
    """One factor per observation, from one dimension or a single column."""
    if size_factors is None:
        return None
    sf = np.asarray(size_factors, float)
    if sf.ndim == 2 and sf.shape[1] == 1:
        sf = sf[:, 0]
    if sf.ndim != 1 or len(sf) != n_obs:
        raise ValueError(f"size factors have the shape {np.shape(size_factors)}; one per observation is wanted")
    return sf


@dataclass(frozen=True)
class GlmInput:
    x: DataFrame
    design: DataFrame
    loc_names: list[str]
    scale_names: list[str]
    constraints_loc: np.ndarray | None = None
    constraints_scale: np.ndarray | None = None
    dtype: str = "double"
    has_size_factors: bool = False
    meta: dict = field(default_factory=dict)

    # --- sources -----------------------------------------------------------------------------

    @staticmethod
    def from_tables(
        x: DataFrame,
        design: DataFrame,
        loc: Design | Sequence[str],
        scale: Design | Sequence[str] | None = None,
        obs_col: str = "obs_id",
        feature_col: str = "feature",
        value_col: str = "x",
        size_factor_col: str | None = None,
        constraints_loc: np.ndarray | None = None,
        constraints_scale: np.ndarray | None = None,
        cast_dtype: str | None = "double",
    ) -> GlmInput:
        """Long triplets (any table with an observation, feature and value column; zeros may be left out) and a design table.

        loc and scale are compiled formulas over the design table's covariates, or names of its numeric
        columns; without scale the scale design is an intercept.
        """
        for c in (obs_col, feature_col, value_col):
            if c not in x.columns:
                raise ValueError(f"the data have no column {c}; data of this form are not recognized")
        if not isinstance(x.schema[value_col].dataType, T.NumericType):
            raise ValueError(f"values of type {x.schema[value_col].dataType.simpleString()} are not recognized")
        kind = cast_dtype or x.schema[value_col].dataType.simpleString()
        value = F.col(value_col).cast(kind)
        value = F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit("a value is null; leave the row out for a zero")))

        def side(d) -> tuple:
            if d is None:
                return F.array(F.lit(1.0)), ["Intercept"]
            if isinstance(d, Design):
                return d.array(), d.names
            return F.array(*[F.col(c).cast("double") for c in d]), list(d)

        (loc_array, loc_names), (scale_array, scale_names) = side(loc), side(scale)
        sf = F.lit(None).cast("double")
        if size_factor_col is not None:
            given = F.col(size_factor_col).cast("double")
            sf = F.when(given.isNotNull(), given).otherwise(F.raise_error(F.lit("a size factor is null; every observation needs one")))
        rows = design.select(F.col(obs_col).alias("obs_id"), loc_array.alias("loc"), scale_array.alias("scale"), sf.alias("size_factor"))
        long = x.select(F.col(obs_col).alias("obs_id"), F.col(feature_col).cast("string").alias("feature"), value.alias("x"))
        return GlmInput(long, rows, loc_names, scale_names, constraints_loc, constraints_scale, kind, size_factor_col is not None)

    @staticmethod
    def from_wide(spark_table: DataFrame, features: Sequence[str], obs_col: str = "obs_id", **kw) -> GlmInput:
        """A table with a column per feature; zeros are left out of the long form."""
        pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
        long = spark_table.select(F.col(obs_col).alias("obs_id"), F.explode(pairs).alias("p")).select("obs_id", "p.feature", "p.x").where("x <> 0 or x is null")
        return GlmInput.from_tables(long, **kw)

    @staticmethod
    def from_arrays_column(table: DataFrame, vector_col: str, obs_col: str = "obs_id", names: Sequence[str] | None = None, **kw) -> GlmInput:
        """A table with an array of all features' values per observation."""
        long = table.select(F.col(obs_col).alias("obs_id"), F.posexplode(vector_col).alias("k", "x"))
        feature = F.col("k").cast("string") if names is None else F.element_at(F.array(*[F.lit(n) for n in names]), F.col("k") + 1)
        return GlmInput.from_tables(long.select("obs_id", feature.alias("feature"), "x"), **kw)

    @staticmethod
    def from_matrix(
        spark: SparkSession,
        data,
        design_loc,
        design_loc_names: Sequence[str] | None = None,
        design_scale=None,
        design_scale_names: Sequence[str] | None = None,
        constraints_loc: np.ndarray | None = None,
        constraints_scale: np.ndarray | None = None,
        size_factors=None,
        observation_names: Sequence | None = None,
        feature_names: Sequence[str] | None = None,
        cast_dtype: str | None = "double",
    ) -> GlmInput:
        """A driver-side matrix: an array, a pandas frame, an object with .X, or a sparse matrix with .tocoo()."""
        if hasattr(data, "X") and not isinstance(data, (np.ndarray, pd.DataFrame)):
            feature_names = feature_names if feature_names is not None else getattr(data, "var_names", None)
            data = data.X
        if isinstance(data, pd.DataFrame):
            feature_names = feature_names if feature_names is not None else [str(c) for c in data.columns]
            data = data.to_numpy()
        if hasattr(data, "tocoo"):
            coo = data.tocoo()
            shape, rows, cols, values = coo.shape, coo.row, coo.col, coo.data
        elif isinstance(data, np.ndarray) and data.ndim == 2:
            shape = data.shape
            rows, cols = np.nonzero(data)
            values = data[rows, cols]
        else:
            raise ValueError(f"type of data {type(data)} not recognized")
        loc, loc_names = parse_design(design_loc, design_loc_names)
        if design_scale is None:
            design_scale, design_scale_names = np.ones((shape[0], 1)), ["Intercept"]
        scale, scale_names = parse_design(design_scale, design_scale_names)
        if len(loc) != shape[0] or len(scale) != shape[0]:
            raise ValueError("a design has one row per observation")
        sf = parse_size_factors(size_factors, shape[0])
        feature_names = [str(f) for f in feature_names] if feature_names is not None else [str(k) for k in range(shape[1])]
        obs = list(observation_names) if observation_names is not None else list(range(shape[0]))
        kind = cast_dtype or "double"
        long = pd.DataFrame({"obs_id": np.asarray(obs)[rows], "feature": np.asarray(feature_names, dtype=object)[cols], "x": values.astype(float)})
        xdf = spark.createDataFrame(long, "obs_id " + ("string" if isinstance(obs[0], str) else "long") + f", feature string, x {kind if kind in ('double', 'float') else 'double'}")
        ddf = pd.DataFrame({"obs_id": obs, "loc": list(loc), "scale": list(scale), "size_factor": sf if sf is not None else np.full(shape[0], np.nan)})
        ddf["size_factor"] = ddf["size_factor"].astype(object).where(ddf["size_factor"].notna(), None)
        schema = "obs_id " + ("string" if isinstance(obs[0], str) else "long") + ", loc array<double>, scale array<double>, size_factor double"
        design = spark.createDataFrame([(o, [float(v) for v in a], [float(v) for v in b], None if s is None else float(s)) for o, a, b, s in ddf.itertuples(index=False)], schema)
        return GlmInput(xdf, design, loc_names, scale_names, constraints_loc, constraints_scale, kind, sf is not None, {"features": feature_names})

    # --- shape and names ----------------------------------------------------------------------

    @property
    def num_observations(self) -> int:
        return self.design.count()

    @property
    def num_features(self) -> int:
        return len(self.meta["features"]) if "features" in self.meta else self.features().count()

    def features(self) -> DataFrame:
        """(feature): the names given, or those with a row in x."""
        if "features" in self.meta:
            return self.x.sparkSession.createDataFrame([(f,) for f in self.meta["features"]], "feature string")
        return self.x.select("feature").distinct()

    @property
    def free_loc_names(self) -> list[str]:
        return free_names(self.constraints_loc, self.loc_names)

    @property
    def free_scale_names(self) -> list[str]:
        return free_names(self.constraints_scale, self.scale_names)

    @property
    def num_design_loc_params(self) -> int:
        return len(self.loc_names)

    @property
    def num_design_scale_params(self) -> int:
        return len(self.scale_names)

    @property
    def num_loc_params(self) -> int:
        return len(self.free_loc_names)

    @property
    def num_scale_params(self) -> int:
        return len(self.free_scale_names)

    def c_loc(self) -> np.ndarray:
        return np.eye(len(self.loc_names)) if self.constraints_loc is None else np.asarray(self.constraints_loc, float)

    def c_scale(self) -> np.ndarray:
        return np.eye(len(self.scale_names)) if self.constraints_scale is None else np.asarray(self.constraints_scale, float)

    # --- selections --------------------------------------------------------------------------

    def fetch(self, obs_ids: DataFrame | Sequence, what: str = "loc") -> DataFrame:
        """Design rows (loc, scale) or size factors (size_factor) of some observations."""
        rows = self.design.select("obs_id", what)
        if isinstance(obs_ids, DataFrame):
            return rows.join(obs_ids.select("obs_id").distinct(), "obs_id", "left_semi")
        return rows.where(F.col("obs_id").isin(list(obs_ids)))

    def subset_features(self, names: Sequence[str] | str) -> GlmInput:
        names = [names] if isinstance(names, str) else list(names)
        meta = {**self.meta, "features": [f for f in self.meta["features"] if f in names]} if "features" in self.meta else self.meta
        return replace(self, x=self.x.where(F.col("feature").isin(names)), meta=meta)

    def feature_isallzero(self) -> DataFrame:
        """(feature, allzero): whether the feature's values add up to 0."""
        sums = self.x.groupBy("feature").agg(F.sum("x").alias("s"))
        return self.features().join(sums, "feature", "left").select("feature", (F.coalesce("s", F.lit(0.0)) == 0).alias("allzero"))

    def feature_isnonzero(self) -> DataFrame:
        return self.feature_isallzero().select("feature", (~F.col("allzero")).alias("nonzero"))

    # --- cells -------------------------------------------------------------------------------

    def groups(self) -> DataFrame:
        """(loc, scale, size_factor, n_obs): the distinct design rows."""
        return self.design.groupBy("loc", "scale", "size_factor").agg(F.count(F.lit(1)).alias("n_obs"))

    def _every_group(self) -> DataFrame | None:
        """(feature, loc, scale, size_factor, n_obs) of every feature and distinct design row; None without a design row."""
        groups = self.groups().limit(MAX_GROUPS + 1).collect()
        if not groups:
            return None
        if len(groups) > MAX_GROUPS:
            # every feature has zeros for every design row; blocks of design rows spread them over tasks
            blocks = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")
            by_block = self.groups().withColumn("block", F.pmod(F.xxhash64("loc", "scale", "size_factor"), F.lit(BLOCKS)).cast("int"))
            return self.features().select("feature", blocks).join(by_block, "block").drop("block")
        lit = lambda v: F.lit(None).cast("double") if v is None else F.lit(float(v))
        each = F.explode(F.array(*[F.struct(F.array(*map(lit, g["loc"])).alias("loc"), F.array(*map(lit, g["scale"])).alias("scale"), lit(g["size_factor"]).alias("size_factor"), F.lit(g["n_obs"]).alias("n_obs")) for g in groups]))
        return self.features().select("feature", each.alias("g")).select("feature", "g.*")

    def moment_cells(self) -> DataFrame:
        """Cells for sums of polynomials of degree 2 in x at most: two per feature and distinct design row, a deviation below and above the mean.

        They have the number, sum and sum of squares of the row's values, zeros without a row included, and come
        from one aggregation with partial sums before its shuffle, whose size is that of the design and not of the values.
        """
        keys = ["feature", "loc", "scale", "size_factor"]
        value = F.col("x").cast("double")
        rows = self.x.join(self.design, "obs_id").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
        full = self._every_group()
        if full is None:
            return rows.select(*keys, F.col("m").alias("x"), F.col("n").cast("double").alias("cnt"))
        none = {"n": F.lit(0).cast("long"), "m": F.lit(0.0), "v": F.lit(0.0)}
        both = rows.withColumn("n_obs", F.lit(0).cast("long")).unionByName(full.withColumns(none).withColumn("n_obs", F.col("n_obs").cast("long")))
        both = both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "m", "v", "n_obs")])
        share = F.col("n") / F.col("n_obs")
        deviation = F.sqrt(share * F.col("v") + share * (1 - share) * F.col("m") * F.col("m"))
        ends = F.explode(F.array(share * F.col("m") - deviation, share * F.col("m") + deviation))
        return both.where("n_obs > 0").select(*keys, ends.alias("x"), (F.col("n_obs") / 2).alias("cnt"))

    def cells(self) -> DataFrame:
        """(feature, loc, scale, size_factor, x, cnt): the lossless aggregate that every kernel sums over.

        Zeros without a row become one cell per feature and distinct design row, whose count is what the
        rows leave of its observations; the observations x features product is never formed.
        """
        keys = ["feature", "loc", "scale", "size_factor"]
        rows = self.x.join(self.design, "obs_id").groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("cnt"))
        full = self._every_group()
        if full is None:
            return rows
        full = full.withColumns({"x": F.lit(0.0).cast(self.dtype), "cnt": F.lit(0).cast("long")})
        there = rows.withColumn("n_obs", F.lit(0).cast("long")).unionByName(full.withColumn("n_obs", F.col("n_obs").cast("long")))
        spread = there.groupBy(*keys, "x").agg(F.sum("cnt").alias("cnt"), F.sum("n_obs").alias("n_obs"))
        seen = rows.groupBy(*keys).agg(F.sum("cnt").alias("__seen"))
        zero = (
            spread.where("n_obs > 0").join(seen.withColumnsRenamed({k: f"__{k}" for k in keys}), [
                F.col("feature") == F.col("__feature"), F.col("loc") == F.col("__loc"), F.col("scale") == F.col("__scale"), F.col("size_factor").eqNullSafe(F.col("__size_factor")),
            ], "left").select(*keys, "x", (F.col("cnt") + F.col("n_obs") - F.coalesce("__seen", F.lit(0))).alias("cnt"))
        )
        return spread.where("n_obs = 0").select(*keys, "x", "cnt").union(zero).where("cnt > 0")
