"""Incremental refits: a stream of observations is folded into the cell table, whose counts add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEYS = ["feature", "loc", "scale", "size_factor", "x"]


def merge_cells(*tables: DataFrame) -> DataFrame:
    """Cells of several tables as one, counts added."""
    out = tables[0].select(*KEYS, "cnt")
    for t in tables[1:]:
        out = out.union(t.select(*KEYS, "cnt"))
    return out.groupBy(*KEYS).agg(F.sum("cnt").alias("cnt"))


def accumulate(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append each micro-batch's cells under path as batch=<id>, written over when a batch is retried, so none counts twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        cells = batch.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("cnt"))
        cells.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_cells(spark, path: str) -> DataFrame:
    """All cells accumulated so far."""
    return merge_cells(spark.read.parquet(path).drop("batch"))
