"""Words, five-word shingles and min-hashes of whole texts, with numpy over many texts at once.

Words are the runs of bytes other than 0x20 and 0x09-0x0D in the UTF-8 text with A-Z lower-cased.
A word's hash is a polynomial over its bytes modulo 2**64, mixed; a shingle's hash combines its
words' hashes in order. Equal shingles always have equal hashes; two different shingles of a corpus
meet with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WIDTH = 5
#: Bytes of text hashed together; a longer text is hashed in slices that end at white space.
SLICE = 1 << 20

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finisher)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def seeds(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed))


_VALUE = mix(np.arange(1, 257, dtype=U))
_ORDER = seeds(WIDTH + 1, 17) | U(1)
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 1)
        step = np.full(size, _BASE, dtype=U)
        back = np.full(size, pow(_BASE, -1, 1 << 64), dtype=U)
        step[0] = back[0] = 1
        _powers[:] = [np.multiply.accumulate(step), np.multiply.accumulate(back)]
    return _powers[0], _powers[1]


def _words(data: np.ndarray, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words in data; heads: offsets at which a text begins."""
    n = len(data)
    if not n:
        return np.empty(0, U), np.empty(0, np.int64)
    text = ~_SPACE[data]
    first = np.empty(n, bool)
    first[0] = True
    first[1:] = ~text[:-1]
    first[heads[heads < n]] = True
    start = np.flatnonzero(text & first)
    last = np.empty(n, bool)
    last[-1] = True
    last[:-1] = first[1:] | ~text[1:]
    end = np.flatnonzero(text & last)
    up, down = _power(n)
    total = np.cumsum(_VALUE[_LOWER[data]] * up[:n])
    h = total[end]
    h[start > 0] -= total[start[start > 0] - 1]
    return mix(h * down[start]), start


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), offsets


def word_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For ranges of rows in order: first row, row after the last, hashes of all words, and each row's first word (one offset more than rows)."""
    data, offsets = text_buffer(column)
    i, rows = 0, len(offsets) - 1
    while i < rows:
        j = int(np.searchsorted(offsets, offsets[i] + SLICE, "right")) - 1
        if j <= i:
            parts, at, stop = [], offsets[i], offsets[i + 1]
            while at < stop:
                to = min(at + SLICE, stop)
                while to < stop and not _SPACE[data[to]]:
                    to += 1
                parts.append(_words(data[at:to], np.zeros(0, np.int64))[0])
                at = to
            h = np.concatenate(parts) if parts else np.empty(0, U)
            yield i, i + 1, h, np.array([0, len(h)])
            i += 1
            continue
        base = offsets[i]
        h, start = _words(data[base : offsets[j]], offsets[i:j] - base)
        yield i, j, h, np.searchsorted(start, offsets[i : j + 1] - base, "left")
        i = j


def shingle_rows(column: pa.Array, distinct: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As word_hashes(), with shingles for words: sorted and distinct in each row, or in text order.

    A row of 1 to WIDTH-1 words has one shingle, the whole sequence; a row without words has none.
    """
    for i, j, h, at in word_hashes(column):
        full = np.zeros(len(h), U)
        n = len(h) - WIDTH + 1
        if n > 0:
            for k in range(WIDTH):
                full[:n] += h[k : k + n] * _ORDER[k]
        full = mix(full)
        parts = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= WIDTH:
                s = full[a : b - WIDTH + 1]
                if distinct:
                    s = np.sort(s)
                    keep = np.empty(len(s), bool)
                    keep[0] = True
                    np.not_equal(s[1:], s[:-1], out=keep[1:])
                    s = s[keep]
            elif b > a:
                own = np.append(h[a:b], U(b - a)) * np.append(_ORDER[: b - a], _ORDER[WIDTH])
                s = mix(own.sum(keepdims=True))
            else:
                s = full[:0]
            parts.append(s)
        ends = np.zeros(j - i + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=ends[1:])
        yield i, j, np.concatenate(parts) if parts else np.empty(0, U), ends
