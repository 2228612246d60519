"""Covariates derived from others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Range partitions that a rank is counted over.
RANK_PARTS = 64


def ranked(df: DataFrame, order: Sequence[str], name: str = "rank0") -> DataFrame:
    """Adds the rank from 0 by the given columns.

    The rows are range-partitioned, ranked within each partition, and shifted by the sizes of the
    partitions before, so no task orders the whole table.
    """
    parts = df.repartitionByRange(RANK_PARTS, *order).withColumn("__part", F.spark_partition_id())
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.withColumn("__before", before).select("__part", "__before")
    within = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return parts.withColumn("__within", within).join(F.broadcast(offsets), "__part").withColumn(name, F.col("__within") + F.col("__before")).drop("__part", "__within", "__before")


def bin_continuous_covariate(df: DataFrame, factor: str, bins: int | Sequence[float], id_col: str = "obs_id") -> DataFrame:
    """Adds <factor>_binned: how many edges lie at or below the row's rank share (rank from 0 over the row count).

    An int makes edges 0, 1/bins, 2/bins, ...; ties are ranked by id_col. The input is not changed.
    """
    if isinstance(bins, bool) or not isinstance(bins, (int, list, tuple)) and not hasattr(bins, "tolist"):
        raise TypeError("bins is a number or a list of edges")
    edges = [k / bins for k in range(bins)] if isinstance(bins, int) else [float(e) for e in bins]
    n = df.count()
    share = F.col("__rank") / F.lit(max(n, 1))
    binned = sum((F.when(share >= F.lit(e), 1).otherwise(0) for e in edges), F.lit(0)).cast("int")
    return ranked(df, [factor, id_col], "__rank").withColumn(f"{factor}_binned", binned).drop("__rank")
