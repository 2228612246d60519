"""Shared helpers: reading tables, cutting lineage into the shared folder, connected components."""

from __future__ import annotations

import atexit
import contextlib
import gc
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on one machine where spark.checkpoint.dir is unset, as in tests.
LOCAL_SHARED = "/tmp/checkpoints/tessera"
#: Shuffle files are released at most this often.
GC_SECONDS = 5
_collected = 0.0
#: Edges up to which one task finds components; more take the distributed steps.
ONE_TASK = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, or the context's checkpoint folder."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path
    if sc.master == "local" or sc.master.startswith("local["):
        return LOCAL_SHARED
    raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back, so that a lost executor costs one table at most.

    Shuffle files of the written plan are released: the cleaner drops them once the driver has collected its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    _left[path] = spark.sparkContext
    del df
    global _collected
    if time.monotonic() - _collected > GC_SECONDS:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _collected = time.monotonic()
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables that cut() wrote and that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path:
            _delete(path, df.sparkSession.sparkContext)


#: Folders that cut() wrote and that are still there; a result's own table is read until the program ends.
_left: dict[str, SparkContext] = {}


def _delete(path: str, sc: SparkContext) -> None:
    target = sc._jvm.org.apache.hadoop.fs.Path(path)
    conf = sc._jsc.hadoopConfiguration() if sc._jsc is not None else sc._jvm.org.apache.hadoop.conf.Configuration()
    target.getFileSystem(conf).delete(target, True)
    _left.pop(path, None)


@atexit.register
def _discard_left() -> None:
    for path, sc in list(_left.items()):
        with contextlib.suppress(Exception):
            _delete(path, sc)


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of equal values in the first `keys` columns (integers), of batches sorted by them, a table a run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            c = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= c[1:] != c[:-1]
        new[0] = not held or any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(keys))
        starts = np.flatnonzero(new).tolist()
        for a, b in zip([0, *starts], [*starts, batch.num_rows], strict=True):
            if a in starts and held:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v) per node that isn't its component's smallest one, v; of all edges (u, v), ONE_TASK at most."""
    edges = [(u, v) for batch in batches for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root[y]
            x = y
        return x

    for u, v in edges:
        x, y = find(u), find(v)
        root[max(x, y)] = min(x, y)
    nodes = [x for x in root if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["u", "v"])


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the undirected edges; component is the smallest reachable node.

    Alternating large-star and small-star steps, each one written to the shared folder; the number of
    rounds grows with the logarithm of the longest chain, and no step gathers a node's neighbours.
    ONE_TASK edges or fewer (counted) are worked off by one task instead. Self-loops and nulls are
    ignored; no edges give no rows.
    """
    cur = cut(
        edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u is not null and v is not null and u <> v").distinct(),
        "edges",
    )
    if cur.count() <= ONE_TASK:
        stars = cut(cur.coalesce(1).mapInArrow(_components, "u long, v long"), "stars")
        discard(cur)
        return _nodes(stars)
    while not _is_forest_of_stars(cur):
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        new = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        discard(cur)
        cur = new
    return _nodes(cur)


def _nodes(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each larger end has one edge and is nobody's smaller end."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("root")).union(edges.select("v", F.lit(0), F.lit(1)))
    bad = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("root").alias("root")).where("up > 1 or (up = 1 and root = 1)")
    return bad.limit(1).count() == 0
