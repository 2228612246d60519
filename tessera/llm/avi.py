"""Media columns of AVI motion-JPEG: write, index, decode, and cut into shots.

write_avi() stores bytes as 8-bit gray samples of lossless frames. read_avi() parses the RIFF index
(and, where that is missing or wrong, walks the chunks), decodes each intra frame and yields timed
clips: a shot ends where the difference of two frames' histograms exceeds what its neighbourhood lets expect.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jpeg import BadFrame, decode, encode_lossless

WIDTH, HEIGHT, RATE = 64, 16, 25
#: Frames coded at once.
BLOCK = 256
BINS = 16
#: A cut: a histogram difference (0 to 1) over LEAST and over mean + SPREAD deviations of the NEAR differences before it.
NEAR, SPREAD, LEAST = 12, 3.0, 0.18


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes, used: int) -> bytes:
    """An AVI whose frames' samples are payload, a multiple of WIDTH bytes; rows that fill the last frame are 0.

    used, the bytes of payload that count, and payload's length are kept in the INFO list's comment.
    """
    size = WIDTH * HEIGHT
    n = -(-len(payload) // size)
    frames: list[bytes] = []
    for at in range(0, n, BLOCK):
        part = payload[at * size : (at + BLOCK) * size]
        part += b"\0" * (-len(part) % size)
        frames += encode_lossless(np.frombuffer(part, np.uint8).reshape(-1, HEIGHT, WIDTH))
    most = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, n, 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, RATE, 0, n, most, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", size, 0, 0, 0, 0)
    header = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    info = b"INFO" + _chunk(b"ICMT", b"%d %d" % (used, len(payload)))
    index, at = [], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += 8 + len(f) + (len(f) & 1)
    movi = b"movi" + b"".join(_chunk(b"00dc", f) for f in frames)
    return _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", header) + _chunk(b"LIST", info) + _chunk(b"LIST", movi) + _chunk(b"idx1", b"".join(index)))


class BadMedia(ValueError):
    pass


@dataclass
class Avi:
    rate: float
    frames: list[bytes]
    comment: str
    indexed: bool


def _chunks(data: bytes, at: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the chunks of data[at:stop]; one that runs over the end is cut there."""
    while at + 8 <= stop:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        yield name, at + 8, min(at + 8 + size, stop)
        at += 8 + size + (size & 1)


def parse_avi(data: bytes) -> Avi:
    """Frame rate, the video stream's frames in order and the comment of an AVI file of one or more RIFF parts."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise BadMedia("not an AVI file")
    rate, comment, lists, index = float(RATE), "", [], b""
    for name, a, b in _chunks(data, 0, len(data)):
        if name != b"RIFF":
            continue
        for kind, p, q in _chunks(data, a + 4, b):
            form = data[p : p + 4] if kind == b"LIST" else b""
            if kind == b"idx1":
                index = index or data[p:q]
            elif form == b"movi":
                lists.append((p, q))
            elif form == b"hdrl":
                for k, x, y in _chunks(data, p + 4, q):
                    if k == b"LIST" and data[x : x + 4] == b"strl":
                        for k2, x2, _ in _chunks(data, x + 4, y):
                            if k2 == b"strh" and data[x2 : x2 + 4] == b"vids":
                                scale, per = struct.unpack_from("<II", data, x2 + 20)
                                rate = per / scale if scale and per else rate
            elif form == b"INFO":
                comment = next((data[x:y].decode("utf-8", "replace") for k, x, y in _chunks(data, p + 4, q) if k == b"ICMT"), "")
    if not lists:
        raise BadMedia("no frames")
    frames = _indexed(data, index, *lists[0]) if len(lists) == 1 else None
    if frames is not None:
        return Avi(rate, frames, comment, True)
    return Avi(rate, [x for p, q in lists for x in _walked(data, p + 4, q)], comment, False)


def _is_video(name: bytes) -> bool:
    return name[:2].isdigit() and name[2:] in (b"dc", b"db")


def _indexed(data: bytes, index: bytes, p: int, q: int) -> list[bytes] | None:
    """The frames that the index lists, whose offsets count from the movi list or from the file's start; None if they aren't there."""
    entries = [e for e in struct.iter_unpack("<4sIII", index[: len(index) // 16 * 16]) if _is_video(e[0])]
    if not entries:
        return None
    for base in (p, 0):
        frames = []
        for name, _, at, size in entries:
            at += base
            if at < p or at + 8 + size > q or data[at : at + 4] != name or int.from_bytes(data[at + 4 : at + 8], "little") != size:
                break
            frames.append(data[at + 8 : at + 8 + size])
        else:
            return frames
    return None


def _walked(data: bytes, at: int, stop: int) -> Iterator[bytes]:
    for name, a, b in _chunks(data, at, stop):
        if name == b"LIST" and data[a : a + 4] == b"rec ":
            yield from _walked(data, a + 4, b)
        elif _is_video(name) and b > a:
            yield data[a:b]


def histogram_steps(frames: list[np.ndarray]) -> np.ndarray:
    """Histogram difference (0 to 1) of each frame's first component to the frame before."""
    counts = np.array([np.bincount(f[:, :, 0].ravel() >> 4, minlength=BINS) / f[:, :, 0].size for f in frames]).reshape(-1, BINS)
    return np.abs(np.diff(counts, axis=0)).sum(axis=1) / 2


def cuts(steps: np.ndarray) -> list[int]:
    """Numbers of the frames that begin a shot, the first frame left out."""
    found, since = [], 0
    for k, step in enumerate(steps.tolist()):
        near = steps[max(since, k - NEAR) : k]
        if step > LEAST and (not len(near) or step > near.mean() + SPREAD * near.std()):
            found.append(k + 1)
            since = k + 1
    return found


@dataclass
class Media:
    samples: bytes
    used: int
    rate: float
    n_frames: int
    shots: list[int]
    steps: np.ndarray
    indexed: bool


def read_avi(data: bytes) -> Media:
    """Decode every frame; samples are those of the first components in order, cut to the length in the comment if there is one."""
    avi = parse_avi(data)
    frames = [decode(f) for f in avi.frames]
    steps = histogram_steps(frames)
    samples = b"".join(f[:, :, 0].tobytes() for f in frames)
    used, _, whole = avi.comment.partition(" ")
    if used.isdigit() and whole.strip("\0").isdigit():
        samples, used = samples[: int(whole.strip("\0"))], int(used)
    else:
        used = len(samples)
    return Media(samples, used, avi.rate, len(frames), [0, *cuts(steps)] if frames else [], steps, avi.indexed)


def pad(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % 64 or 64 * (not text))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, column = batch.columns
        for at in range(0, batch.num_rows, 256):
            media = [write_avi(pad(t), len(t)) for t in ((x or "").encode() for x in column[at : at + 256].to_pylist())]
            yield pa.RecordBatch.from_arrays([ids[at : at + 256], pa.array(media, pa.binary())], ["id", "media"])


_CLIPS = pa.list_(pa.struct([("clip", pa.int64()), ("first_frame", pa.int64()), ("end_frame", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())]))
_FEATURES = pa.schema(
    [("id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
     ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int64()), ("n_shots", pa.int64()), ("clips", _CLIPS), ("error", pa.string())]
)
#: What reading a file that is no AVI, or one with a bad frame, raises.
_UNREADABLE = (BadMedia, BadFrame, struct.error, IndexError, KeyError)


def _timed(m: Media) -> list[dict]:
    return [
        {"clip": n, "first_frame": a, "end_frame": b, "start_s": a / m.rate, "end_s": b / m.rate}
        for n, (a, b) in enumerate(zip(m.shots, [*m.shots[1:], m.n_frames][: len(m.shots)], strict=True))
    ]


def _feature_row(media: bytes | None) -> dict:
    if media is None:
        return {"error": "no file"}
    out = {"media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest()}
    try:
        m = read_avi(media)
    except _UNREADABLE as e:
        return out | {"error": f"{type(e).__name__}: {e}"}
    top = int(round(1000 * float(m.steps.max()))) if len(m.steps) else 0
    feature = f"{m.n_frames} frames, shots at {' '.join(f'{s / m.rate:.2f}' for s in m.shots)} s, largest step {top}"
    return out | {
        "n_bytes": m.used, "payload_bytes": len(m.samples), "payload_sha256": hashlib.sha256(m.samples).hexdigest(), "tail_crc32": zlib.crc32(m.samples[-64:]),
        "feature": feature, "n_frames": m.n_frames, "n_shots": len(m.shots), "clips": _timed(m),
    }


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_feature_row(media.as_buffer().to_pybytes() if media.is_valid else None) for media in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r.get(f.name) for r in rows], f.type) for f in list(_FEATURES)[1:])], schema=_FEATURES)


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each row's whole text (null: empty) in UTF-8, filled with bytes 0 to a positive multiple of 64, as an AVI file."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_store, "id long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """The digest and timed clips of each file (id, media), from the bytes and frames read back: one row per row, null ids included.

    A null file, one that is no AVI, or one with a frame that can't be decoded has an error and nulls for
    what wasn't read. Other columns aren't read; an empty table gives no rows.
    """
    out = (
        "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, n_shots long, "
        "clips array<struct<clip:long,first_frame:long,end_frame:long,start_s:double,end_s:double>>, error string"
    )
    return media.select(F.col("id").cast("long").alias("id"), "media").mapInArrow(_features, out)


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for k, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                found = _timed(read_avi(media.as_buffer().to_pybytes() if media.is_valid else b""))
                rows += [(k, *c.values(), None) for c in found] or [(k, None, None, None, None, None, "no frames")]
            except _UNREADABLE as e:
                rows.append((k, None, None, None, None, None, f"{type(e).__name__}: {e}"))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
        names = ["id", "clip", "first_frame", "end_frame", "start_s", "end_s", "error"]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names)


def clips(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """A row per shot of each file: (id, clip, first_frame, end_frame, start_s, end_s, error).

    A file that is null, empty, no AVI, or has a frame that can't be decoded gives one row with the
    error alone. Other columns aren't read; an empty table gives no rows.
    """
    rows = media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(_clips, "id long, clip long, first_frame long, end_frame long, start_s double, end_s double, error string")
