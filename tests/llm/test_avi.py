import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tessera.llm import avi, jpeg


def payloads():
    rng = random.Random(1)
    return [b"\0" * 64, bytes(range(256)) * 4, bytes([255] * 1024), bytes(rng.randrange(256) for _ in range(64 * 100)), b"text " * 1000 + b"\0" * 56]


@pytest.mark.parametrize("k", range(5))
def test_lossless_round_trip(k):
    p = payloads()[k]
    m = avi.read_avi(avi.write_avi(p, len(p) - 3))
    assert m.samples == p and m.used == len(p) - 3 and m.indexed and m.n_frames == -(-len(p) // 1024)


def test_array_path_equals_symbols():
    """The decoder's two ways agree, so frames are plain lossless JPEG."""
    x = np.frombuffer(payloads()[3], np.uint8)[:1024].reshape(1, 16, 64)
    f = jpeg.Frame(jpeg.encode_lossless(x)[0])
    table, bits = f.table(False, 0), jpeg.Bits(f.segments[0])
    d = np.array([bits.signed(bits.symbol(table)) for _ in range(1024)]).reshape(16, 64)
    d[0, 0] += 128
    d[:, 0] = np.cumsum(d[:, 0])
    assert (np.cumsum(d, axis=1) % 256 == x[0]).all()


def baseline(blocks, width, height, tables=True):
    """A gray baseline JPEG of quantized coefficient blocks, coded with the standard tables."""
    quant = bytes([2] * 64)
    codes = lambda counts, symbols: {s: (c, n) for (n, c), s in jpeg.Huffman(counts, symbols).codes.items()}
    dc, ac = codes(*jpeg.STD_DC[0]), codes(jpeg.STD_AC[0][0], jpeg._hex(jpeg.STD_AC[0][1]))
    bits = ""
    put = lambda code: format(code[0], f"0{code[1]}b")
    low = lambda v, n: format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""
    last = 0
    for b in blocks:
        size = abs(int(b[0]) - last).bit_length()
        bits += put(dc[size]) + low(int(b[0]) - last, size)
        last, run = int(b[0]), 0
        for v in map(int, b[1:]):
            if not v:
                run += 1
                continue
            while run > 15:
                bits += put(ac[0xF0])
                run -= 16
            size = abs(v).bit_length()
            bits += put(ac[run * 16 + size]) + low(v, size)
            run = 0
        if run:
            bits += put(ac[0])
    bits += "1" * (-len(bits) % 8)
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    dht = b""
    if tables:
        for kind, (counts, symbols) in ((0, jpeg.STD_DC[0]), (16, (jpeg.STD_AC[0][0], jpeg._hex(jpeg.STD_AC[0][1])))):
            body = bytes([kind]) + bytes(counts + [0] * (16 - len(counts))) + bytes(symbols)
            dht += b"\xff\xc4" + (2 + len(body)).to_bytes(2, "big") + body
    return b"\xff\xd8\xff\xdb\0\x43\0" + quant + dht + b"\xff\xc0\0\x0b\x08" + struct.pack(">HH", height, width) + b"\x01\x01\x11\0\xff\xda\0\x08\x01\x01\0\0\x3f\0" + scan + b"\xff\xd9"


@pytest.mark.parametrize("tables", [True, False])
def test_baseline_frames(tables):
    rng = np.random.default_rng(1)
    coefs = np.zeros((6, 64), int)
    coefs[:, 0] = rng.integers(-200, 200, 6)
    coefs[:, 1:12] = rng.integers(-20, 20, (6, 11))
    coefs[2, 63] = 3
    got = jpeg.decode(baseline(coefs, 20, 15, tables))[:, :, 0]
    want = np.zeros((16, 24))
    for k in range(6):
        f = np.zeros((8, 8))
        for z, v in enumerate(coefs[k]):
            f[divmod(int(jpeg.ZIGZAG[z]), 8)] = 2 * v
        for y in range(8):
            for x in range(8):
                s = sum(f[v, u] * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if v == 0 else 1) * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for v in range(8) for u in range(8)) / 4
                want[k // 3 * 8 + y, k % 3 * 8 + x] = s + 128
    assert np.abs(got - np.clip(np.round(want), 0, 255)[:15, :20]).max() <= 1


def test_zigzag():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-3:].tolist() == [55, 62, 63]


def test_index_lost_or_wrong():
    p = payloads()[3]
    data = avi.write_avi(p, 5)
    at = data.rfind(b"idx1")
    wrong = bytearray(data)
    wrong[at + 16 : at + 20] = b"\xff\xff\xff\x00"
    for damaged in (data[:at], bytes(wrong)):
        m = avi.read_avi(damaged)
        assert m.samples == p and not m.indexed


def test_shots():
    rng = np.random.default_rng(2)
    scene = lambda lo, hi, n: [np.clip(rng.integers(lo, hi, (16, 64, 1)), 0, 255).astype(np.uint8) for _ in range(n)]
    frames = scene(0, 80, 20) + scene(150, 255, 15) + scene(60, 140, 10)
    assert avi.cuts(avi.histogram_steps(frames)) == [20, 35]
    assert avi.cuts(avi.histogram_steps(scene(0, 255, 40))) == [] and avi.cuts(avi.histogram_steps([])) == []


def test_table(spark):
    texts = [(1, None), (2, ""), (3, "x" * 64), (4, "é" * 1000), (4, "é" * 1000), (None, "abc"), (5, "long text " * 30_000)]
    docs = spark.createDataFrame([(i, t, b"") for i, t in texts], "doc_id long, text string, media binary")
    got = avi.media_features(avi.with_media(docs)).collect()
    want = []
    for i, t in texts:
        raw = (t or "").encode()
        p = avi.pad(raw)
        assert len(p) % 64 == 0 and len(p) > 0
        want.append((str(i), len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted((str(r.id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    files = {r.id: bytes(r.media) for r in avi.with_media(docs).collect()}
    assert all(hashlib.sha256(files[r.id]).hexdigest() == r.media_sha256 and len(files[r.id]) == r.media_bytes for r in got)
    assert avi.media_features(avi.with_media(docs.limit(0))).collect() == []


def test_clips(spark):
    good = avi.write_avi(bytes(1024 * 10) + bytes([200] * 1024 * 5), 1)
    rows = [(1, good), (2, None), (3, b""), (4, b"RIFF\0\0\0\0AVI "), (5, good[:300]), (6, good[: len(good) // 2])]
    got = {}
    for r in avi.clips(spark.createDataFrame(rows, "id long, media binary")).collect():
        got.setdefault(r.id, []).append(r)
    assert [(r.first_frame, r.end_frame, r.start_s, r.end_s) for r in got[1]] == [(0, 10, 0.0, 0.4), (10, 15, 0.4, 0.6)]
    assert all(got[k][0].error for k in (2, 3, 4)) and set(got) == {1, 2, 3, 4, 5, 6}


def test_features_of_null_and_bad_files(spark):
    good = avi.write_avi(avi.pad(b"some text"), 9)
    rows = [(1, None, "x"), (2, b"", "x"), (3, b"RIFFjunk", "x"), (None, good, "x"), (4, good[:-30], "x")]
    got = {r.id: r for r in avi.media_features(spark.createDataFrame(rows, "id long, media binary, feature string")).collect()}
    assert len(got) == 5 and got[None].error is None and got[None].clips[0].start_s == 0 and got[None].clips[-1].end_frame == got[None].n_frames
    assert all(got[k].error and got[k].feature is None and got[k].clips is None for k in (1, 2, 3))
    assert avi.media_features(spark.createDataFrame([], "id long, media binary")).collect() == []


def test_bits_are_read_in_linear_time():
    from tessera.llm.jpeg import Bits

    data = bytes(range(256)) * 40
    bits, whole = Bits(data), int.from_bytes(data, "big")
    assert [bits.take(n) for n in (3, 8, 1, 16, 0, 12)] == [0, 0, 0, (whole >> (8 * len(data) - 28)) & 0xFFFF, 0, (whole >> (8 * len(data) - 40)) & 0xFFF]
