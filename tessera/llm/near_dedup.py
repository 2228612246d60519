"""MinHash near-duplicate detection by a signature-coordinate inverted join.

Every distinct shingle set (a class of equal sets) gets COORDS min-hashes. A class is posted under each
(coordinate, value) pair, packed into one 64-bit token. The collisions of two classes are the coordinates
in which their signatures agree; pairs with MATCHES or more are retained and confirmed on full sets:

* tokens that one class alone has collide with nothing, so a class with fewer than MATCHES shared tokens
  leaves the join at once;
* prefix: with tokens in ascending order of corpus frequency, two classes with MATCHES collisions share
  one of their first COORDS - MATCHES + 1 tokens, so only those are posted;
* skip: a posting list whose classes are already in one component is skipped, and of the other lists
  only pairs across components are counted.

A posting list is never expanded into all its pairs. Two rounds pair each list's classes with a leader
(the class whose tokens the most classes share, then one drawn by hash), count the pairs' collisions and
confirm those retained. In the lists that still hold several components, the exact rest counts the
collisions of classes of different components where they stand, in tiles of at most TILE classes and about
TILE_BYTES of text a side, confirms them, and hands on one link for each two components that it joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import U, mix, seeds, shingle_rows
from .tables import connected, cut, discard, runs

#: With 48 coordinates and 26 matches a pair of similarity 0.75 is missed with probability 0.0004, one of 0.9 with under 1e-12.
COORDS = 48
MATCHES = 26
PER_CENT = 75
TILE = 1024
TILE_BYTES = 4 << 20

_MULT = seeds(COORDS, 101) | U(1)
_ADD = seeds(COORDS, 202)
_TAG = seeds(COORDS, 303)

_SIGNED = pa.schema(
    [("id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("sig", pa.list_(pa.int64()))]
)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, h, at in shingle_rows(batch.column(1)):
            n = np.diff(at)
            full = np.flatnonzero(n)
            k1, k2 = np.zeros(j - i, U), np.zeros(j - i, U)
            sig = np.zeros((COORDS, len(full)), U)
            if len(full):
                heads = at[:-1][full]
                k1[full] = np.add.reduceat(mix(h ^ U(0xA5A5)), heads)
                k2[full] = np.add.reduceat(mix(h ^ U(0x5A5A)), heads)
                for c in range(COORDS):
                    sig[c] = mix(np.minimum.reduceat(h * _MULT[c] + _ADD[c], heads) ^ _TAG[c])
            ends = np.zeros(j - i + 1, np.int32)
            np.cumsum(np.where(n > 0, COORDS, 0), out=ends[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.T.ravel().view(np.int64)))],
                schema=_SIGNED,
            )


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (a, b, text of a, text of b) the (a, b) with 100 * intersection >= PER_CENT * union."""
    for batch in batches:
        good = [_similar(x, y) for x, y in zip(_sets(batch.column(2)), _sets(batch.column(3)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for i, j, h, at in shingle_rows(column):
        for k in range(j - i):
            yield h[at[k] : at[k + 1]]


def _similar(x: np.ndarray, y: np.ndarray) -> bool:
    short, long = (x, y) if len(x) < len(y) else (y, x)
    if 100 * len(short) < PER_CENT * len(long) or not len(short):
        return False
    at = np.searchsorted(long, short)
    both = int((long[np.minimum(at, len(long) - 1)] == short).sum())
    return 100 * both >= PER_CENT * (len(x) + len(y) - both)


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (token, row tile, column tile, side, cls, component, sig, text), sorted: links (a, b) that join components."""
    for t in runs(batches, 3):
        t = t.combine_chunks()
        names, parts = t.column("cls").to_numpy(), t.column("component").to_numpy()
        side = t.column("side").to_numpy()
        same = t.column("p")[0].as_py() == t.column("q")[0].as_py()
        label, parts = np.unique(parts, return_inverse=True)
        if len(label) < 2:
            continue
        sigs = t.column("sig").chunk(0).flatten().to_numpy().reshape(-1, COORDS)
        sets = list(_sets(t.column("text").chunk(0)))
        root = np.arange(len(label))

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return int(c)

        # the largest component's classes ask nothing: every pair across components has another one in it
        most = np.bincount(parts).argmax()
        links = []
        for k in np.flatnonzero(parts != most).tolist():
            met = (parts != parts[k]) & (same | (side != side[k]))
            met[met] = (sigs[met] == sigs[k]).sum(axis=1) >= MATCHES
            for m in np.flatnonzero(met).tolist():
                if find(parts[m]) != find(parts[k]) and _similar(sets[k], sets[m]):
                    root[find(parts[m])] = find(parts[k])
                    links.append((names[k], names[m]))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])


def _collisions(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in MATCHES coordinates or more."""
    x, y = (sigs.select(F.col("cls").alias(k), F.col("sig").alias(f"sig_{k}")) for k in "ab")
    agree = F.zip_with("sig_a", "sig_b", lambda u, v: F.when(u == v, 1).otherwise(0))
    count = F.aggregate(agree, F.lit(0), lambda n, hit: n + hit)
    return pairs.join(x, "a").join(y, "b").where(count >= MATCHES).select("a", "b")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    x, y = (texts.select(F.col("cls").alias(k), F.col("text").alias(f"text_{k}")) for k in "ab")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) per row of docs.

    A set's shingles are five words; a text of one to four words has one shingle, a null or empty text
    or one without words has none and is linked with nothing. Repeated rows and equal texts are one
    class; different texts under one id are linked through it. A row with a null id is linked with
    nothing and kept, its component null. Other columns of docs are not read, whatever they are called.
    An empty table gives an empty result.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("mark", F.xxhash64("text"))
    signed = cut(source.mapInArrow(_signatures, "id long, mark long, n long, k1 long, k2 long, sig array<long>"), "signed")
    cls = F.xxhash64("n", "k1", "k2").alias("cls")
    named = signed.where("n > 0 and id is not null").select("id", "mark", cls, "sig")
    # the smallest id stands for a class; the mark tells its text from others under that id
    first = F.min(F.struct("id", "mark", "sig")).alias("s")
    sigs = cut(named.groupBy("cls").agg(first).select("cls", F.col("s.id").alias("rep"), F.col("s.mark").alias("mark"), F.col("s.sig").alias("sig")), "sigs")
    tokens = sigs.select("cls", F.explode("sig").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    posted = cut(
        tokens.join(shared, "token").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("t"))
        .where(F.size("t") >= MATCHES)
        .select("cls", F.aggregate("t", F.lit(0).cast("long"), lambda n, x: n + x["f"]).alias("known"), F.explode(F.slice("t", 1, F.size("t") - (MATCHES - 1))).alias("t"))
        .select("cls", "known", F.col("t.token").alias("token")),
        "posted",
    )
    wanted = posted.select("cls").distinct().join(sigs.select("cls", F.col("rep").alias("id"), "mark"), "cls")
    texts = cut(source.join(wanted, ["id", "mark"]).groupBy("id", "mark").agg(F.min("cls").alias("cls"), F.min("text").alias("text")).select("cls", "text"), "texts")
    same_id = named.select("id", "cls").distinct()
    lows = same_id.groupBy("id").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi")
    tied = same_id.join(lows, "id").where("cls <> lo").select(F.col("lo").alias("a"), F.col("cls").alias("b"))

    parts = sigs.select("cls", F.col("cls").alias("component"))
    for step in ("central", "drawn", "rest"):
        at = cut(_open_lists(posted, parts), "open")
        if step != "central" and at.isEmpty():
            discard(at)
            break
        if step == "rest":
            size = texts.select("cls", F.octet_length("text").alias("bytes"))
            n = at.join(size, "cls").groupBy("token").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("bytes") / TILE_BYTES)).cast("int").alias("t"))
            placed = at.join(n, "token").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("t")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1)))
            side = F.when(F.col("own") <= F.col("other"), 0).otherwise(1)
            cells = placed.select("token", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), side.alias("side"), "cls", "component")
            full = cells.join(sigs.select("cls", "sig"), "cls").join(texts, "cls").select("token", "p", "q", "side", "cls", "component", "sig", "text")
            new = full.repartition("token", "p", "q").sortWithinPartitions("token", "p", "q").mapInArrow(_rest, "a long, b long")
        else:
            draw = F.struct("known", -F.col("cls")) if step == "central" else F.struct(F.xxhash64("cls", "token"))
            lead = at.groupBy("token").agg(F.max_by("cls", draw).alias("lead"), F.max_by("component", draw).alias("other"))
            pairs = at.join(lead, "token").where("component <> other").select(F.least("cls", "lead").alias("a"), F.greatest("cls", "lead").alias("b")).distinct()
            new = _verified(_collisions(pairs, sigs), texts)
        found = cut(new.union(tied) if step == "central" else new, "links")
        now = cut(_merged(parts, found), "parts")
        discard(at, found, parts)
        parts = now

    members = parts.join(sigs.select("cls", "rep"), "cls")
    low = members.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = parts.join(low, "component").select("cls", "component_id")
    out = signed.select("id", "n", cls).join(by_class, "cls", "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component_id"))).otherwise(F.col("id"))
    out = cut(out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id")), "near")
    discard(signed, sigs, posted, texts, parts)
    return out.select(
        F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(cls, component) after links (a, b) between classes."""
    x, y = (parts.select(F.col("cls").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
    across = links.join(x, "a").join(y, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct()
    merged = connected(across).select(F.col("node").alias("component"), F.col("component").alias("low"))
    return parts.join(merged, "component", "left").select("cls", F.coalesce("low", "component").alias("component"))


def _open_lists(posted: DataFrame, parts: DataFrame) -> DataFrame:
    """(cls, known, token, component) of the posting lists that hold more than one component."""
    at = posted.join(parts, "cls")
    mixed = at.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    return at.join(mixed, "token")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that near_duplicates() does not keep; columns and repeated kept rows stay as they are."""
    gone = near_duplicates(docs, id_col, text_col).where("not kept").select(F.col(id_col).cast("long").alias("__gone")).distinct()
    return docs.join(gone, docs[id_col].cast("long") == gone["__gone"], "left_anti")


#: All pairs that share a shingle, and the smallest id reachable over those that are similar enough.
ORACLE_SQL = rf"""
with recursive t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) end) as shingle from t),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= {PER_CENT} * (p.n + q.n - k)),
link as (select x, y from e union all select y, x from e),
reach(x, y) as (select doc_id, doc_id from documents union select r.x, l.y from reach r join link l on r.y = l.x),
low as (select x, min(y) as component_id from reach group by x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, low.component_id, d.doc_id = low.component_id as kept
from documents d join low on low.x = d.doc_id left join n on n.doc_id = d.doc_id"""
