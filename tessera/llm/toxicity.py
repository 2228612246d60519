"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart, one on toxic and one on ordinary text. A text's windows of
WINDOW words are compressed after each of them, both behind one base dictionary of common strings, so that
the two differ by what is peculiar to a class alone. A window's gain is the length that it saves with
the toxic dictionary. Thresholds on the gains, and the weights of what passes them, are calibrated on
labelled rows.

The samples of a class's dictionary are its contrast: the stretches of its texts made of byte strings
that at least SHARE of its texts hold, ODDS times as often as the other class's texts. Dictionaries of
whole texts or of whole windows differ by chance more than by class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 12
LEVEL = 3
BASE_BYTES = 16_384
CLASS_BYTES = 2_048
#: Bytes of a contrast string, the least share and count of a class's texts that hold it, and how much more often they do.
STRING = 5
SHARE = 0.02
LEAST = 3
ODDS = 8.0
#: Labelled rows to fit on at most, those with the smallest hashes of their ids; longer texts aren't fitted on.
TOXIC_ROWS = 2_000
ORDINARY_ROWS = 4_000
FIT_CHARS = 100_000
#: Windows of ordinary text that the base dictionary is trained on.
FIT_WINDOWS = 30_000
#: A byte that no text has, to bring the two dictionaries to one length.
FILL = b"\x01"


def windows(text: str | None) -> list[bytes]:
    words = (text or "").encode().lower().split()
    return [b" " + b" ".join(words[k : k + WINDOW]) + b" " for k in range(0, len(words), WINDOW)]


def _spaced(text: str | None) -> np.ndarray:
    return np.frombuffer(b" " + b" ".join((text or "").encode().lower().split()) + b" ", np.uint8)


def _strings(data: np.ndarray) -> np.ndarray:
    """The STRING bytes from each position on, as one number."""
    n = max(len(data) - STRING + 1, 0)
    out = np.zeros(n, np.int64)
    for k in range(STRING):
        out = out * 256 + data[k : k + n]
    return out


def _holders(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Strings, sorted, and how many texts hold each."""
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(np.concatenate([np.unique(_strings(t)) for t in texts]), return_counts=True)


def _contrast(mine: list[np.ndarray], theirs: list[np.ndarray]) -> list[bytes]:
    """Of each of a class's texts the stretches that its contrast strings make up."""
    (own, n), (other, m) = _holders(mine), _holders(theirs)
    at = np.minimum(np.searchsorted(other, own), max(len(other) - 1, 0))
    there = np.where(other[at] == own, m[at], 0) if len(other) else np.zeros(len(own))
    telling = own[(n >= max(LEAST, SHARE * len(mine))) & (n * (len(theirs) + 1.0) >= ODDS * len(mine) * (there + 0.5))]
    out = []
    for data in mine:
        hit = np.isin(_strings(data), telling)
        keep = np.zeros(len(data), bool)
        for k in range(STRING):
            keep[k : k + len(hit)] |= hit
        if keep.any():
            out.append(data[keep].tobytes())
    return out


def _train(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; of samples too few for one their text's end."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _class_strings(samples: list[bytes]) -> bytes:
    """The strings of a class's trained dictionary, without the entropy tables before them, which hold bytes that no sample has."""
    trained = _train(CLASS_BYTES, samples)
    known = frozenset(b"".join(samples))
    start = len(trained)
    while start and trained[start - 1] in known:
        start -= 1
    return trained[start:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    kind = zstandard.DICT_TYPE_FULLDICT if content.startswith(b"\x37\xa4\x30\xec") else zstandard.DICT_TYPE_RAWCONTENT
    own = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=kind)
    own.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False)


@dataclass
class Model:
    plain: bytes
    toxic: bytes
    #: Gains of a window that count as low and high evidence.
    low: int
    high: int
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A model with its compressors, for one process."""

    def __init__(self, model: Model):
        self.m, self.plain, self.toxic = model, _compressor(model.plain), _compressor(model.toxic)

    def gains(self, text: str | None) -> np.ndarray:
        a, b = self.plain.compress, self.toxic.compress
        return np.array([len(a(w)) - len(b(w)) for w in windows(text)], np.int64)

    def features(self, text: str | None) -> np.ndarray:
        """Mean gain, shares and counts of windows past the thresholds, the largest gain, the text's length."""
        g = self.gains(text)
        n = max(len(g), 1)
        low, high = int((g >= self.m.low).sum()), int((g >= self.m.high).sum())
        return np.array([g.sum() / n, low / n, high / n, np.log1p(low), np.log1p(high), min(int(g.max(initial=0)), 8), np.log(n)], float)

    def score(self, text: str | None) -> float:
        z = (self.features(text) - self.m.mean) / self.m.scale
        return float(1 / (1 + np.exp(-np.clip(self.m.weights[0] + z @ self.m.weights[1:], -30, 30))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x1 = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x1.shape[1])
    penalty = np.full(x1.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + np.diag(penalty), x1.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return w


def fit(texts: list[str | None], labels: list[int]) -> Model:
    """Dictionaries, thresholds and weights of labelled texts (1: toxic). Copies of a text count once."""
    rows = list(dict.fromkeys(zip(texts, labels, strict=True)))
    toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
    mine, theirs = [_spaced(t) for t in toxic], [_spaced(t) for t in ordinary]
    strange, common = _class_strings(_contrast(mine, theirs)), _class_strings(_contrast(theirs, mine))
    plain = [w for t in ordinary for w in windows(t)]
    order = np.random.default_rng(0).permutation(len(plain))[:FIT_WINDOWS]
    base = _train(BASE_BYTES, [plain[k] for k in order])
    size = max(len(strange), len(common), 1)
    none = np.zeros(7)
    model = Model(base + common.rjust(size, FILL), base + strange.rjust(size, FILL), 2, 3, none, none + 1, np.zeros(8))
    scorer = model.scorer()
    gains = np.concatenate([scorer.gains(t) for t in ordinary] or [np.zeros(1, int)])
    model.low = max(1, int(np.quantile(gains, 0.95)) + 1) if len(gains) else 2
    model.high = max(model.low + 1, int(np.quantile(gains, 0.995)) + 1) if len(gains) else 3
    x = np.array([scorer.features(t) for t, _ in rows]).reshape(-1, 7)
    y = np.array([y for _, y in rows], float)
    if len(rows):
        model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        model.weights = _logistic((x - model.mean) / model.scale, y)
    if not toxic or not strange:
        share = (len(toxic) + 0.5) / (len(rows) + 1)
        model.weights = np.array([np.log(share / (1 - share)), *[0.0] * 7])
    return model


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id's decimal text is a multiple of 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of labelled rows that aren't held out (TOXIC_ROWS and ORDINARY_ROWS ids, texts to FIT_CHARS)."""
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("__label")).where("__id is not null and __label in (0, 1)")
    known = known.where(~held_out(F.col("__id"))).groupBy("__id").agg(F.max("__label").alias("__label"))
    order = (F.xxhash64("__id"), F.col("__id"))
    some = known.where("__label = 1").orderBy(*order).limit(TOXIC_ROWS).union(known.where("__label = 0").orderBy(*order).limit(ORDINARY_ROWS))
    text = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text")).where(F.length("__text") <= FIT_CHARS)
    rows = sorted({(r[0], r[1] or "", r[2]) for r in text.join(F.broadcast(some), "__id").select("__id", "__text", "__label").toLocalIterator()})
    return fit([r[1] for r in rows], [r[2] for r in rows])


def score_column(model: Model, text: Column) -> Column:
    """The score of each text, 0 to 1; of null and empty texts that of a text without windows. An empty table gives no scores."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(score, "double")(text)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) per row of docs.

    Every whole text is scored, null and empty ones too; equal texts have equal scores. Null ids are
    not held out. Repeated rows give a row each. Only the id and text are read. An empty table gives
    no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([scorer.score(t) for t in part.column(1).to_pylist()], pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double")
    return rows.select(
        F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores 0.5 or more; columns as they are."""
    return docs.withColumn("__toxicity", score_column(model, F.col(text_col))).where(F.col("__toxicity") < 0.5).drop("__toxicity")
