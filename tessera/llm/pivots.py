"""Embedding near-duplicates by a pivot-permutation index.

Reference points (pivots) are drawn from a bounded sample of vectors, far from each other; their number
grows with the square root of the vectors' number, so that lists stay short. A vector is described by
its NEAREST pivots in order of nearness, and posted in the inverted list of each of those pivots with the
pivot's rank. Two vectors of a list are compared by their permutations: SHARED pivots or more in common,
whose ranks differ by APART or less on average, make a candidate. A pair that meets in several lists
counts in that of the first pivot, by number, that both have. Candidates are verified by their cosine in
double precision.

Equal vectors are one class. A list is compared in tiles of TILE vectors a side, so no task holds a
whole list, and yields counts and a few edges a vector, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import connected, cut, discard, runs

#: Pivots at least and at most; between them PER_ROOT times the square root of the number of vectors.
PIVOTS = 64
MOST_PIVOTS = 4096
PER_ROOT = 2
#: Vectors that pivots are chosen from: SAMPLE a pivot, those with the smallest hashes.
SAMPLE = 4
NEAREST = 8
SHARED = 3
APART = 3.5
TILE = 1024
COSINE = 0.95
#: Vector lengths that one pass over the table finds pivots for.
LENGTHS = 64


def choose_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """n of the unit vectors, each the one farthest from those before it."""
    if len(vectors) <= n:
        return vectors
    chosen, near = [0], vectors @ vectors[0]
    for _ in range(n - 1):
        k = int(near.argmin())
        chosen.append(k)
        near = np.maximum(near, vectors @ vectors[k])
    return vectors[chosen]


def pivots_for(n: int) -> int:
    """How many pivots n vectors have."""
    return int(min(max(PIVOTS, PER_ROOT * np.sqrt(n)), MOST_PIVOTS))


def describe(vectors: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """The permutation of each unit vector: the numbers of its nearest pivots, nearest first."""
    nearest = min(nearest, len(pivots))
    close = vectors @ pivots.T
    top = np.argpartition(-close, nearest - 1, axis=1)[:, :nearest] if nearest < len(pivots) else np.tile(np.arange(len(pivots)), (len(vectors), 1))
    top.sort(axis=1)
    order = np.argsort(-np.take_along_axis(close, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1).astype(np.int64)


def alike(a: np.ndarray, b: np.ndarray, shared: int = SHARED) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of permutations: whether they share enough pivots at near ranks, and the smallest pivot that they share."""
    same = a[:, :, None] == b[:, None, :]
    rank = np.abs(np.arange(a.shape[1])[:, None] - np.arange(b.shape[1])[None, :])
    count = same.sum(axis=(1, 2))
    least = np.where(same.any(axis=2), a, np.iinfo(np.int64).max).min(axis=1)
    return (count >= min(shared, a.shape[1])) & ((same * rank).sum(axis=(1, 2)) <= APART * count), least


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dim, vec) with vec the unit vector's bytes, null for a vector that can't be linked."""
    for batch in batches:
        rows = []
        for v in batch.column(1).to_pylist():
            x = np.array([np.nan if c is None else c for c in v], np.float64) if v else np.zeros(0)
            size = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
            if size > 0:
                x = x / size
                x /= np.sqrt(x @ x)
            rows.append(x.tobytes() if size > 0 else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if r is None else len(r) // 8 for r in rows], pa.int32()), pa.array(rows, pa.binary())], ["id", "dim", "vec"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (pivot, row tile, column tile, side, rep, copies, vec, perm), sorted: (rep, links, edge) per vector and tile."""
    for t in runs(batches, 3):
        yield from _tile(t.combine_chunks())


def _tile(t: pa.Table) -> Iterator[pa.RecordBatch]:
    side = t.column("side").to_numpy()
    pivot, rep, copies = t.column("pivot")[0].as_py(), t.column("rep").to_numpy(), t.column("copies").to_numpy()
    same = t.column("p")[0].as_py() == t.column("q")[0].as_py()
    x = _matrix(t.column("vec").combine_chunks())
    perms = np.array(t.column("perm").combine_chunks().values.to_numpy(zero_copy_only=False)).reshape(len(x), -1)
    one, two = (np.arange(len(x)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    if not len(one) or not len(two):
        return
    a, b = np.nonzero(x[one] @ x[two].T >= COSINE)
    a, b = one[a], two[b]
    if same:
        a, b = a[a < b], b[a < b]
    if not len(a):
        return
    # a pair counts in the list of the first pivot that both have
    here = np.ones(len(a), bool)
    for at in range(0, len(a), 1 << 14):
        good, least = alike(perms[a[at : at + (1 << 14)]], perms[b[at : at + (1 << 14)]])
        here[at : at + (1 << 14)] = good & (least == pivot)
    a, b = a[here], b[here]
    links = np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
    label = rep.copy()
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, label[a])
        if (label == before).all():
            break
    some = np.flatnonzero(links)
    yield pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(links[some].astype(np.int64)), pa.array(label[some])], ["rep", "links", "edge"])


def _choose(reps: DataFrame, known: dict[int, int]) -> dict[int, np.ndarray]:
    """Pivots of each vector length: known[length] of SAMPLE times as many vectors, read LENGTHS lengths at a time."""
    out, lengths = {}, sorted(known)
    for at in range(0, len(lengths), LENGTHS):
        part = {d: SAMPLE * known[d] for d in lengths[at : at + LENGTHS]}
        most = F.create_map(*[F.lit(x) for pair in part.items() for x in pair])
        order = W.partitionBy("dim").orderBy(F.xxhash64("vec"), "vec")
        some = reps.where(F.col("dim").isin(list(part))).select("dim", "vec").withColumn("n", F.row_number().over(order)).where(F.col("n") <= F.element_at(most, F.col("dim")))
        vecs: dict[int, list[bytes]] = {}
        for r in some.orderBy("dim", "n").toLocalIterator():
            vecs.setdefault(r["dim"], []).append(bytes(r["vec"]))
        for d, v in vecs.items():
            out[d] = choose_pivots(np.frombuffer(b"".join(v), np.float64).reshape(-1, d), known[d])
    return out


def linked_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) per row: links are pairs of cosine COSINE or more whose pivot permutations are alike.

    Vectors that are null, empty, zero or hold null or non-finite components are linked with nothing, as
    are rows with a null id (component null, kept). Vectors of different lengths are never linked. Equal
    directions are linked whatever the index. Different vectors under one id share its links. Only the id
    and vector are read. An empty table gives no rows.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    unit = cut(rows.mapInArrow(_unit, "id long, dim int, vec binary"), "unit")
    classes = (
        unit.where("vec is not null and id is not null").groupBy("dim", "vec")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    )
    reps = classes.where("dim > 0")
    # one pass: the number of vectors of each length, and the bounded sample of those with the smallest hashes
    lengths = reps.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    known = {r["dim"]: pivots_for(r["n"]) for r in lengths.where("n > 1").toLocalIterator()}
    pivots = _choose(reps, known)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dim = batch.column(0).to_numpy()
            for d in np.unique(dim).tolist():
                own = batch.filter(pa.array(dim == d))
                perms = describe(_matrix(own.column(1)), pivots[d])
                ends = np.arange(len(perms) + 1, dtype=np.int32) * perms.shape[1]
                yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(perms.ravel()))], ["dim", "vec", "rep", "copies", "perm"])

    able = reps.where(F.col("dim").isin(list(known))) if known else reps.where("false")
    described = cut(able.select("dim", "vec", "rep", "copies").mapInArrow(index, "dim int, vec binary, rep long, copies long, perm array<long>"), "index")
    posted = described.select("dim", "rep", F.explode("perm").alias("pivot"))
    lists = posted.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    placed = posted.join(lists, ["dim", "pivot"]).select("dim", "rep", "pivot", tiles.alias("t"))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("t")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
    cells = placed.select(
        "dim", "rep", "pivot", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.when(F.col("own") <= F.col("other"), 0).otherwise(1).alias("side")
    )
    wide = cells.join(described, ["dim", "rep"]).repartition("dim", "pivot", "p", "q").sortWithinPartitions("dim", "pivot", "p", "q")
    found = cut(
        wide.select("pivot", "p", "q", "side", "rep", "copies", "vec", "perm", "dim").mapInArrow(_links, "rep long, links long, edge long"), "links"
    )
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = connected(found.select(F.col("rep").alias("a"), F.col("edge").alias("b")))
    by_class = (
        classes.join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("dim", "vec", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = unit.join(by_class, ["dim", "vec"], "left")
    able = F.col("vec").isNotNull() & F.col("id").isNotNull()
    out = out.select(
        "id", F.when(able, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), F.when(able, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )
    out = cut(out, "vectors")
    discard(unit, described, found)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


ORACLE_SQL = f"""
with recursive v as (select vec_id, embedding::double[] as e from embeddings
  where len(embedding) > 0 and not list_contains(list_transform(embedding, lambda c: c is null or not isfinite(c)), true) and list_dot_product(embedding::double[], embedding::double[]) > 0),
link as (select a.vec_id as x, b.vec_id as y from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach(x, y) as (select vec_id, vec_id from embeddings union select r.x, l.y from reach r join link l on r.y = l.x),
low as (select x, min(y) as component_id from reach group by x),
num as (select x, count(*) as n from link group by x)
select e.vec_id, coalesce(n.n, 0)::bigint as n_links, l.component_id, e.vec_id = l.component_id as kept
from embeddings e join low l on e.vec_id = l.x left join num n on e.vec_id = n.x"""
