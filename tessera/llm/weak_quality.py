"""Quality by weak labels.

Heuristic labellers vote good (1), bad (0) or abstain (-1) on each whole text. Their votes' patterns are
counted over all texts; there are at most 3 ** labellers of them, so the counts fit the driver whatever
the corpus holds. Expectation-maximisation over the counts estimates each labeller's accuracy on good and
on bad texts and the share of good texts; a pattern's posterior is its texts' weak label. A linear scorer over hashed byte
trigrams is then trained on the posteriors of a bounded sample and scores every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import text_buffer
from .tables import cut, discard

BUCKETS = 4096
#: Texts that the scorer is trained on at most: those with the smallest hashes of their ids; longer texts aren't.
FIT_ROWS = 4_000
FIT_CHARS = 100_000
ROUNDS = 200
PRIOR_GOOD = 0.8
ABSTAIN = -1

_CLASS = np.zeros(256, np.int64)
for _k, _set in enumerate((range(97, 123), range(65, 91), range(48, 58), (32, 9, 11, 12, 13), (10,), b".,;:'\"-()?!", range(128, 256)), 1):
    _CLASS[list(_set)] = _k
LOWER, UPPER, DIGIT, SPACE, LINE, STOPS, WIDE = range(1, 8)

LABELLERS = ("symbols", "shouting", "word_length", "distinct_words", "repeated_lines", "table_marks", "digits", "sentence_ends", "odd_marks", "stutter")


def measures(raw: np.ndarray, text: bytes) -> dict[str, float]:
    """What the labellers look at, of a text's UTF-8 bytes."""
    n = np.bincount(_CLASS[raw], minlength=8)
    bytes_ = np.bincount(raw, minlength=256)
    words = text.lower().split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = int(n[LOWER] + n[UPPER] + n[WIDE])
    return {
        "words": len(words),
        "symbols": n[0] / max(len(raw), 1),
        "upper": n[UPPER] / max(int(n[LOWER] + n[UPPER]), 1),
        "length": letters / max(len(words), 1),
        "distinct": len(set(words)) / max(len(words), 1) * min(1.0, max(len(words), 1) / 200) ** 0.25,
        "lines": len(set(lines)) / max(len(lines), 1),
        "n_lines": len(lines),
        "marks": (bytes_[ord("|")] + bytes_[ord("<")] + bytes_[ord("{")]) / max(len(words), 1),
        "bangs": bytes_[ord("!")] / max(len(words), 1),
        "odd": (n[0] + bytes_[ord("!")]) / max(len(words), 1),
        "stutter": sum(map(eq, words, words[1:])) / max(len(words), 1),
        "digits": n[DIGIT] / max(len(raw), 1),
        "ends": (bytes_[ord(".")] + bytes_[ord("?")]) / max(len(words), 1),
    }


def votes(m: dict[str, float]) -> tuple[int, ...]:
    """The labellers' votes, in the order of LABELLERS; a text without words gets bad votes from those that need words."""
    vote = lambda bad, good: 0 if bad else 1 if good else ABSTAIN
    some = m["words"] > 0
    return (
        vote(m["symbols"] > 0.1, m["symbols"] < 0.05 and some),
        vote(m["upper"] > 0.4 or m["bangs"] > 0.3, m["upper"] < 0.1 and m["bangs"] < 0.02 and some),
        vote(not some or m["length"] > 14 or m["length"] < 2, 3 < m["length"] < 10),
        vote(not some or m["distinct"] < 0.2, m["distinct"] > 0.35),
        vote(m["n_lines"] > 3 and m["lines"] < 0.5, m["n_lines"] > 0 and m["lines"] > 0.9),
        vote(m["marks"] > 0.3, m["marks"] < 0.02 and some),
        vote(m["digits"] > 0.2, m["digits"] < 0.05 and some),
        vote(not some, 0.02 < m["ends"] < 0.4),
        vote(m["odd"] > 0.35, m["odd"] < 0.15 and some),
        vote(m["stutter"] > 0.2, m["stutter"] < 0.05 and some),
    )


@dataclass
class Labelling:
    """Share of good texts, and of the votes that labeller k casts on class c (0 bad, 1 good) the share rates[c, k, v] of vote v."""

    good: float
    rates: np.ndarray

    def accuracy(self) -> np.ndarray:
        """Of each labeller, the share of right votes on bad and on good texts."""
        return np.stack([self.rates[0, :, 0], self.rates[1, :, 1]], axis=1)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good of each row of votes."""
        # an abstention says nothing
        log = np.concatenate([np.log(self.rates), np.zeros((2, self.rates.shape[1], 1))], axis=2)
        k = np.arange(patterns.shape[1])
        down, up = (log[c, k, patterns].sum(axis=1) for c in (0, 1))
        gap = down + np.log(1 - self.good) - up - np.log(self.good)
        return 1 / (1 + np.exp(np.clip(gap, -500, 500)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> Labelling:
    """Expectation-maximisation over vote patterns.

    Labellers look for different faults, so a bad text needs one bad vote: the first posteriors are
    0.05 with a bad vote and 0.95 without, and each labeller's rates are estimated per class, with a
    vote of each kind added to either class.
    """
    n, weight = patterns.shape[1], counts.astype(float)
    p = np.where((patterns == 0).any(axis=1), 0.05, 0.95)
    fit = Labelling(PRIOR_GOOD, np.full((2, n, 2), 0.5))
    for _ in range(rounds):
        share = np.stack([weight * (1 - p), weight * p])
        rates = np.stack([share @ (patterns == v) for v in (0, 1)], axis=2) + 1.0
        good = (share[1].sum() + 10 * PRIOR_GOOD) / (weight.sum() + 10)
        fit = Labelling(float(good), rates / rates.sum(axis=2, keepdims=True))
        new = fit.posterior(patterns)
        moved = np.abs(new - p).max(initial=0)
        p = new
        if moved < 1e-9:
            break
    return fit


def trigram_counts(raw: np.ndarray) -> np.ndarray:
    """Square roots of the shares of a text's hashed byte trigrams (A-Z kept)."""
    if len(raw) < 3:
        return np.zeros(BUCKETS, np.float32)
    x = raw.astype(np.uint32)
    h = ((x[:-2] * np.uint32(65536) + x[1:-1] * np.uint32(256) + x[2:]) * np.uint32(2654435761)) >> np.uint32(20)
    return np.sqrt(np.bincount(h, minlength=BUCKETS) / len(h)).astype(np.float32)


def train_scorer(x: np.ndarray, y: np.ndarray, steps: int = 300, ridge: float = 1e-4) -> np.ndarray:
    """Weights (the last one a constant's) of a logistic model of soft labels, by accelerated gradient steps."""
    if not len(x):
        return np.zeros(BUCKETS + 1)
    x1 = np.column_stack([x, np.ones(len(x), np.float32)])
    # rows of x have norm 1, so the loss's curvature is at most a half
    y, w = y.astype(np.float32), np.zeros(x1.shape[1], np.float32)
    look, t, decay = w.copy(), 1.0, ridge * np.append(np.ones(BUCKETS, np.float32), np.float32(0))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ look, -30, 30)))
        new = (look - 1.9 * (x1.T @ (p - y) / np.float32(len(x)) + decay * look)).astype(np.float32)
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = (new + (t - 1) / nxt * (new - w)).astype(np.float32), new, nxt
    return w


def _rows(column: pa.Array) -> Iterator[tuple[np.ndarray, bytes]]:
    data, at = text_buffer(column)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield data[a:b], data[a:b].tobytes()


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sum((v + 1) * 3**k for k, v in enumerate(votes(measures(raw, text)))) for raw, text in _rows(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int32())], ["id", "pattern"])


def unpack(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**k % 3 - 1 for k in range(len(LABELLERS))], axis=1)


@dataclass
class Model:
    labelling: Labelling
    weights: np.ndarray

    def scores(self, column: pa.Array) -> np.ndarray:
        out = np.empty(len(column))
        w, b = self.weights[:-1].astype(np.float32), self.weights[-1]
        for k, (raw, _) in enumerate(_rows(column)):
            out[k] = 1 / (1 + np.exp(-np.clip(float(trigram_counts(raw) @ w) + b, -30, 30)))
        return out


def fit(voted: DataFrame, source: DataFrame) -> Model:
    """Accuracies from all votes of voted (id, pattern); weights from a bounded sample of source (id, text)."""
    table = voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    codes = np.array([r["pattern"] for r in table], np.int64)
    labelling = estimate(unpack(codes), np.array([r["n"] for r in table], np.int64))
    posterior = dict(zip(codes.tolist(), labelling.posterior(unpack(codes)).tolist(), strict=True))
    chosen = voted.where("id is not null").orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [trigram_counts(raw).astype(np.float16).tobytes() for raw, _ in _rows(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), batch.column(2)], ["id", "x", "pattern"])

    some = source.where(F.length("text") <= FIT_CHARS).join(F.broadcast(chosen), "id").select("id", "text", "pattern")
    rows = sorted({(r["id"], bytes(r["x"]), r["pattern"]) for r in some.mapInArrow(features, "id long, x binary, pattern int").toLocalIterator()})
    x = np.frombuffer(b"".join(r[1] for r in rows), np.float16).reshape(-1, BUCKETS).astype(np.float32)
    return Model(labelling, train_scorer(x, np.array([posterior[r[2]] for r in rows])))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_from: float = 0.5) -> DataFrame:
    """(id, votes, posterior, score, kept) per row of docs.

    votes has a letter per labeller (g, b, -); posterior is the weak label, score the linear scorer's
    probability of good text; kept: their mean is keep_from or more. A null text counts as empty; an empty text gets
    the bad votes of the labellers that need words. Null and repeated ids pass through, a row each; the
    scorer isn't trained on null ids. Only the id and text are read. An empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    narrow = cut(source.mapInArrow(_vote, "id long, pattern int"), "votes")
    model = fit(narrow, source)
    discard(narrow)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cast = np.array([votes(measures(raw, text)) for raw, text in _rows(batch.column(1))], np.int64).reshape(-1, len(LABELLERS))
            names = ["".join("-bg"[v + 1] for v in row) for row in cast.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(model.labelling.posterior(cast)), pa.array(model.scores(batch.column(1)))], ["id", "votes", "posterior", "score"]
            )

    out = source.mapInArrow(score, "id long, votes string, posterior double, score double")
    return out.select(F.col("id").alias(id_col), "votes", "posterior", "score", ((F.col("posterior") + F.col("score")) / 2 >= keep_from).alias("kept"))
