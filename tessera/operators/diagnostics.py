"""Estimates against references: correlation and deviation per coefficient, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coefficient_pairs(true: DataFrame, pred: DataFrame, names: Sequence[str], column: str = "theta_loc") -> DataFrame:
    """(feature, coef, true, pred) of two tables (feature, array of coefficients); ValueError where their features or sizes differ."""
    if not isinstance(true, DataFrame) or not isinstance(pred, DataFrame):
        raise TypeError("true and pred are DataFrames")
    n = len(names)
    both = true.select("feature", F.col(column).alias("t")).join(pred.select("feature", F.col(column).alias("p")), "feature", "full")
    odd = both.where(F.coalesce(F.size("t"), F.lit(-1)) != F.coalesce(F.size("p"), F.lit(-1))).limit(1).count()
    if odd or true.where(F.size(column) != n).limit(1).count():
        raise ValueError("true and pred differ in features or coefficients")
    label = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("k") + 1)
    zipped = both.select("feature", F.posexplode(F.arrays_zip("t", "p")).alias("k", "v"))
    return zipped.select("feature", label.alias("coef"), F.col("v.t").alias("true"), F.col("v.p").alias("pred"))


def coef_vs_ref(pairs: DataFrame, log: bool = False) -> DataFrame:
    """(coef, n, pearson_r) of coefficient_pairs(), with log of ln(value + 1)."""
    side = (lambda c: F.ln(F.col(c) + 1)) if log else F.col
    return pairs.groupBy("coef").agg(F.count(F.lit(1)).alias("n"), F.corr(side("true"), side("pred")).alias("pearson_r"))


def deviation(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("deviation", F.col("pred") - F.col("true"))


def deviation_summary(pairs: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(coef, n, mean, std, min, q..., max) of pred - true."""
    d = F.col("deviation")
    cols: list[Column] = [F.count(F.lit(1)).alias("n"), F.avg(d).alias("mean"), F.stddev_pop(d).alias("std"), F.min(d).alias("min"), F.max(d).alias("max")]
    cols += [F.percentile(d, F.lit(q)).alias(f"q{round(100 * q)}") for q in quantiles]
    return deviation(pairs).groupBy("coef").agg(*cols)


def save(table: DataFrame, path: str, kind: str = "parameter_scatter", form: str = "parquet") -> None:
    """Write a diagnostic table as <path>_<kind>."""
    table.write.mode("overwrite").format(form).save(f"{path}_{kind}")
