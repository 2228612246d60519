"""SentencePiece encoding and decoding with a shared-prefix forward pass.

A text is normalised to marked words (the mark stands for a space). The distinct words of a block of
texts are sorted, which is the depth-first order of their trie, and a word keeps the forward states of
the prefix that it shares with the word before it. A state is reached over every piece that ends there:

* unigram models: the best score of the prefix, as in Viterbi's algorithm;
* BPE models, whose encoding is not the best-scored one: the last piece of the prefix's encoding. A
  sequence of pieces is an encoding exactly if each two neighbours, merged on their own, stay as they
  are, so of the pieces that end at a position one alone agrees with the state where it starts.

Words in which pieces of equal score meet (runs of marks) are merged directly. Pieces never cross from
a word's end into the next mark, so words are independent; models for which that fails are refused.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: The model whose path is the default of the queries; it is never copied.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: Characters of text whose words are encoded together, and words kept for the next blocks.
BLOCK = 2_000_000
KEEP = 200_000
PAIRS = 500_000

UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BARRIER = -1


def _wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        size = {0: 0, 1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        if size is None:
            size = varint()
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """A SentencePiece model file's pieces, scores, types and settings."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.dummy_prefix, self.trim, self.escape, self.rules, self.suffix = UNIGRAM, True, True, True, b"", False
        self.fallback = False
        for field, value in _wire(data):
            if field == 1:
                piece, score, kind = "", 0.0, NORMAL
                for f, v in _wire(value):
                    if f == 1:
                        piece = v.decode()
                    elif f == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif f == 3:
                        kind = v
                self.pieces.append(piece)
                self.scores.append(score)
                self.types.append(kind)
            elif field == 2:
                spec = dict(_wire(value))
                self.kind, self.suffix, self.fallback = spec.get(3, UNIGRAM), bool(spec.get(24, 0)), bool(spec.get(35, 0))
            elif field == 3:
                spec = dict(_wire(value))
                self.rules, self.dummy_prefix = spec.get(2, b""), bool(spec.get(3, 1))
                self.trim, self.escape = bool(spec.get(4, 1)), bool(spec.get(5, 1))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models are encoded")
        if self.rules or self.suffix or not self.escape:
            raise ValueError("models with normalisation rules, suffix marks or bare spaces are not supported")
        if any(t == USER for t in self.types) or any(MARK in p.lstrip(MARK) for p, t in zip(self.pieces, self.types, strict=True) if t == NORMAL):
            raise ValueError("models with user-defined pieces, or pieces with a mark after another character, are not supported")


class Encoder:
    """Encodes and decodes texts; instances live in a task and hold bounded caches."""

    def __init__(self, model: Model):
        self.m = model
        self.ids = {p: k for k, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == NORMAL}
        self.tails = {p[k:] for p in self.ids for k in range(len(p))}
        self.bytes = {int(p[1:-1], 16): k for k, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t == BYTE}
        self.unknown = next((k for k, t in enumerate(model.types) if t == UNKNOWN), 0)
        self.floor = min((model.scores[k] for k in self.ids.values()), default=0.0) - 10.0
        scores = [model.scores[k] for k in self.ids.values()]
        tied = self._tied(scores)
        tied_pieces = {p for p, k in self.ids.items() if model.scores[k] in tied and len(p) > 1}
        self.direct = model.kind == BPE and any(p.strip(MARK) for p in tied_pieces)
        self.lines = not any("\n" in p for p in self.ids)
        self.words: dict[str, bytes] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.out = [self._bytes_of(k) for k in range(len(model.pieces))]

    @staticmethod
    def _tied(scores: list[float]) -> set[float]:
        values, counts = np.unique(np.array(scores), return_counts=True)
        return set(values[counts > 1].tolist())

    # --- words -------------------------------------------------------------------------------

    def merged(self, word: str) -> list[int]:
        """BPE by merging the best-scored neighbours, the leftmost of equals, until none is left; BARRIER for a character that no piece has."""
        part: list[str | None] = list(word)
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (k := self.ids.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (-self.m.scores[k], i, j, part[i] + part[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, piece = heapq.heappop(heap)
            if part[i] is None or after[i] != j or j >= n or part[j] is None or part[i] + part[j] != piece:
                continue
            part[i], part[j] = piece, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [self.ids.get(p, BARRIER) for p in part if p is not None]

    def agree(self, a: int, b: int) -> bool:
        """Whether pieces a and b stay as they are when merged on their own; a BARRIER never merges."""
        if a == BARRIER:
            if b not in self.whole:
                self.whole[b] = self.merged(self.m.pieces[b]) == [b]
            return self.whole[b]
        key = (a, b)
        if key not in self.fits:
            if len(self.fits) > PAIRS:
                self.fits.clear()
            self.fits[key] = self.merged(self.m.pieces[a] + self.m.pieces[b]) == [a, b]
        return self.fits[key]

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each distinct word with its pieces, in the order of the words' trie."""
        bpe = self.m.kind == BPE
        ids, tails, fits, scores = self.ids, self.tails, self.fits, self.m.scores
        last, piece, start, best = "", [BARRIER], [0], [0.0]
        for word in sorted(words):
            if bpe and (self.direct or word.startswith(MARK + MARK)):
                yield word, self._spelled(self.merged(word), word)
                continue
            n, same, most = len(word), 0, min(len(word), len(last))
            while same < most and word[same] == last[same]:
                same += 1
            del piece[same + 1 :], start[same + 1 :], best[same + 1 :]
            for end in range(same + 1, n + 1):
                at, tail = end - 1, word[end - 1]
                found, begin, score = BARRIER, at, best[at] + self.floor
                while tail in tails:
                    k = ids.get(tail)
                    if k is not None:
                        if not bpe:
                            if found == BARRIER or best[at] + scores[k] > score:
                                found, begin, score = k, at, best[at] + scores[k]
                        elif (f := fits.get((piece[at], k))) or f is None and self.agree(piece[at], k):
                            found, begin = k, at
                    if not at:
                        break
                    at -= 1
                    tail = word[at] + tail
                piece.append(found)
                start.append(begin)
                best.append(score)
            last = word
            path, end = [], n
            while end:
                path.append(piece[end])
                end = start[end]
            path.reverse()
            yield word, self._spelled(path, word)

    def _spelled(self, path: list[int], word: str) -> list[int]:
        """path with byte pieces (or one unknown piece a run) for its BARRIERs."""
        if BARRIER not in path:
            return path
        out, at, lost = [], 0, False
        for k in path:
            if k != BARRIER:
                out.append(k)
                at += len(self.m.pieces[k])
            else:
                if self.m.fallback:
                    out += [self.bytes[b] for b in word[at].encode("utf-8", "surrogatepass")]
                elif not lost:
                    out.append(self.unknown)
                at += 1
            lost = k == BARRIER
        return out

    # --- texts -------------------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """The marked words of a text, in order; an empty text has none."""
        if self.m.trim:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        marked = (MARK if self.m.dummy_prefix else "") + text.replace(" ", MARK)
        pattern = f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+" if self.lines else f"{MARK}+[^{MARK}]*|[^{MARK}]+"
        return re.findall(pattern, marked)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All pieces of the texts (null: empty) as one int32 array, and the texts' offsets in it."""
        parts, ends = [], [0]
        at = 0
        while at < len(texts):
            block, size = [], 0
            while at < len(texts) and (not block or size < BLOCK):
                block.append(self.split(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            if len(self.words) > KEEP:
                self.words.clear()
            new = {w for words in block for w in words}.difference(self.words)
            for word, pieces in self.encode_words(new):
                self.words[word] = np.array(pieces, np.int32).tobytes()
            for words in block:
                data = b"".join(map(self.words.__getitem__, words))
                parts.append(data)
                ends.append(ends[-1] + len(data) // 4)
        return np.frombuffer(b"".join(parts), np.int32), np.array(ends, np.int64)

    def _bytes_of(self, k: int) -> bytes:
        kind, piece = self.m.types[k], self.m.pieces[k]
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return " ⁇ ".encode()
        return bytes([int(piece[1:-1], 16)]) if kind == BYTE else piece.replace(MARK, " ").encode()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of pieces; bytes that are no UTF-8 become U+FFFD each. Ids outside the model raise IndexError."""
        ids = list(ids)
        if any(k < 0 for k in ids):
            raise IndexError("piece ids are not negative")
        data = b"".join(map(self.out.__getitem__, ids))
        if self.m.dummy_prefix and data.startswith(b" "):
            first = next((k for k in ids if self.m.types[k] != CONTROL), None)
            if first is not None and self.m.types[first] != UNKNOWN and self.m.types[first] != BYTE:
                data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return re.sub("[\udc80-\udcff]", "�", data.decode("utf-8", "surrogateescape"))


def load(path: str = MODEL) -> bytes:
    """The model file, read by the driver; its half a megabyte travels with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def _offsets(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))


def encode(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", check: bool = False) -> DataFrame:
    """(id, n_pieces, pieces) per row of docs, and with check whether decoding the pieces gives the text back (round_trip).

    A null or empty text has no pieces; of a null text round_trip is true. Null and repeated ids pass
    through. Only the id and text are read. An empty table gives no rows. Text that holds the mark
    itself decodes to a space there, so its round_trip is false.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(Model(model))
        for batch in batches:
            for rows in _small(batch):
                texts = rows.column(1).to_pylist()
                ids, ends = own.encode(texts)
                cols = [rows.column(0), pa.array(np.diff(ends).astype(np.int32)), _offsets(ids, ends)]
                if check:
                    cols.append(pa.array([own.decode(ids[a:b].tolist()) == (t or "") for t, a, b in zip(texts, ends[:-1], ends[1:], strict=True)]))
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_pieces", "pieces", "round_trip"][: len(cols)])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_pieces int, pieces array<int>" + ", round_trip boolean" * check).withColumnRenamed("id", id_col)


def _small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about BLOCK bytes of text, at least a row each."""
    ends = np.cumsum(pc.binary_length(batch.column(1).fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + BLOCK, "right")))
        yield batch.slice(at, to - at)
        at = to


def decode(pieces: DataFrame, model: bytes, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """(id, text) per row; null pieces give null, null elements are left out, no pieces give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(Model(model))
        for batch in batches:
            texts = [None if p is None else own.decode(k for k in p if k is not None) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = pieces.select(F.col(id_col).cast("long").alias("id"), F.col(pieces_col).cast("array<int>").alias("pieces"))
    return rows.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
