"""JPEG frames as motion-JPEG has them: a decoder for baseline and lossless frames, an encoder for lossless ones.

The encoder's Huffman table gives a sample whose difference needs k bits a code of 9 - k bits, so every
sample takes nine bits and whole frames are coded and decoded as arrays. The decoder sees that from the
table; other streams are decoded symbol by symbol.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the JPEG standard: the tables that a motion-JPEG frame without tables uses.
STD_DC = {0: ([0, 1, 5, 1, 1, 1, 1, 1, 1], range(12)), 1: ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1], range(12))}
STD_AC = {
    0: (
        [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125],
        "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 29 2a 34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 f9 fa",
    ),
    1: (
        [0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119],
        "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a 26 27 28 29 2a 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 82 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 f9 fa",
    ),
}

#: Zig-zag order: the anti-diagonals of an 8 x 8 block, every other one reversed.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_k = np.arange(8)
_DCT = np.where(_k[:, None] == 0, np.sqrt(0.125), 0.5) * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)


class BadFrame(ValueError):
    pass


class Huffman:
    def __init__(self, counts, symbols):
        self.codes: dict[tuple[int, int], int] = {}
        code, symbols = 0, iter(symbols)
        self.lengths = {}
        for n, count in enumerate(counts, 1):
            for _ in range(count):
                s = next(symbols)
                self.codes[n, code] = s
                self.lengths[s] = n
                code += 1
            code <<= 1

    def constant(self) -> int | None:
        """The bits that every symbol with its extra bits takes, if that is one number and the symbols are sizes."""
        total = {n + s for s, n in self.lengths.items()}
        return total.pop() if len(total) == 1 and max(self.lengths) <= 15 else None


def _hex(text: str) -> list[int]:
    return [int(x, 16) for x in text.split()]


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.stop = data, 0, 8 * len(data)

    def take(self, n: int) -> int:
        """The next n bits (32 at most), from the few bytes that hold them."""
        first, self.at = self.at, self.at + n
        if self.at > self.stop:
            raise BadFrame("the scan ends too early")
        end = (self.at + 7) >> 3
        return (int.from_bytes(self.data[first >> 3 : end], "big") >> (8 * end - self.at)) & ((1 << n) - 1)

    def symbol(self, table: Huffman) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table.codes:
                return table.codes[n, code]
        raise BadFrame("no such code")

    def signed(self, n: int) -> int:
        if not n:
            return 0
        v = self.take(n)
        return v if v >> (n - 1) else v - (1 << n) + 1


_SIZES = [8, 7, 6, 5, 4, 3, 2, 1, 0]
_DHT = b"\xff\xc4" + (2 + 1 + 16 + 9).to_bytes(2, "big") + b"\x00" + bytes([1] * 9 + [0] * 7) + bytes(_SIZES)


def _nine() -> np.ndarray:
    """The nine bits of each difference from -255 to 255."""
    out = np.zeros(511, np.uint16)
    codes = {s: (n, c) for (n, c), s in Huffman([1] * 9, _SIZES).codes.items()}
    for d in range(-255, 256):
        size = abs(d).bit_length()
        out[d + 255] = codes[size][1] << size | (d if d > 0 else d + (1 << size) - 1)
    return out


_NINE = _nine()
_BACK = np.full(512, -1000, np.int16)
_BACK[_NINE] = np.arange(-255, 256)
_SHIFT = np.arange(8, -1, -1, dtype=np.uint16)


def encode_lossless(frames: np.ndarray) -> list[bytes]:
    """One lossless (predictor 1) gray JPEG per frame of uint8 (frames, height, width)."""
    n, h, w = frames.shape
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    bits = ((_NINE[d.reshape(n, -1) + 255][:, :, None] >> _SHIFT) & 1).astype(np.uint8).reshape(n, -1)
    pad = -bits.shape[1] % 8
    if pad:
        bits = np.concatenate([bits, np.ones((n, pad), np.uint8)], axis=1)
    scans = np.packbits(bits, axis=1)
    head = (
        b"\xff\xd8" + _DHT + b"\xff\xc3\x00\x0b\x08" + h.to_bytes(2, "big") + w.to_bytes(2, "big") + b"\x01\x01\x11\x00"
        + b"\xff\xda\x00\x08\x01\x01\x00\x01\x00\x00"
    )
    return [head + s.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for s in scans]


class Frame:
    """A parsed frame: its tables and headers, and the scan's entropy-coded segments."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise BadFrame("no start of image")
        self.quant, self.dc, self.ac, self.restart, self.kind, self.parts = {}, {}, {}, 0, None, []
        at = 2
        while True:
            while data[at : at + 2] == b"\xff\xff":
                at += 1
            if at + 4 > len(data) or data[at] != 0xFF:
                raise BadFrame("no marker where one should be")
            mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            if len(body) != size - 2:
                raise BadFrame("the frame ends too early")
            at += 2 + size
            if mark == 0xDB:
                self._quant(body)
            elif mark == 0xC4:
                self._huffman(body)
            elif mark == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif mark in (0xC0, 0xC1, 0xC3):
                self.kind, self.depth = mark, body[0]
                self.height, self.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
                self.parts = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * body[5], 3)]
            elif 0xC5 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC or mark == 0xC2:
                raise BadFrame(f"a frame of kind {mark:x} is not decoded")
            elif mark == 0xDA:
                self.tables = {body[k]: (body[k + 1] >> 4, body[k + 1] & 15) for k in range(1, 1 + 2 * body[0], 2)}
                self.predictor, self.shift = body[1 + 2 * body[0]], body[-1] & 15
                break
        if self.kind is None:
            raise BadFrame("a scan without a frame header")
        stop = data.rfind(b"\xff\xd9")
        if stop < at:
            raise BadFrame("no end of image")
        scan = data[at:stop]
        self.segments = [scan] if not self.restart else _restarts(scan)
        self.segments = [s.replace(b"\xff\x00", b"\xff") for s in self.segments]

    def _quant(self, body: bytes) -> None:
        while body:
            wide = body[0] >> 4
            self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float64)
            body = body[65 + 64 * wide :]

    def _huffman(self, body: bytes) -> None:
        while body:
            n = sum(body[1:17])
            (self.ac if body[0] >> 4 else self.dc)[body[0] & 15] = Huffman(body[1:17], body[17 : 17 + n])
            body = body[17 + n :]

    def table(self, ac: bool, k: int) -> Huffman:
        own, std = (self.ac, STD_AC) if ac else (self.dc, STD_DC)
        if k not in own:
            counts, symbols = std[k & 1]
            own[k] = Huffman(counts, _hex(symbols) if ac else symbols)
        return own[k]


def _restarts(scan: bytes) -> list[bytes]:
    out, at, last = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0 and at + 1 < len(scan):
        if 0xD0 <= scan[at + 1] <= 0xD7:
            out.append(scan[last:at])
            last = at + 2
        at += 2
    return [*out, scan[last:]]


def decode(data: bytes) -> np.ndarray:
    """Samples of a frame, uint8 (height, width, components); colour frames stay in YCbCr order."""
    f = Frame(data)
    return _lossless(f) if f.kind == 0xC3 else _baseline(f)


def _lossless(f: Frame) -> np.ndarray:
    if f.depth != 8 or f.predictor != 1 or f.shift or len(f.parts) != 1 or f.restart:
        raise BadFrame("of lossless frames only 8-bit gray ones with predictor 1 are decoded")
    table, n = f.table(False, f.tables[f.parts[0][0]][0]), f.height * f.width
    if table.lengths == {s: 9 - s for s in range(9)}:
        bits = np.unpackbits(np.frombuffer(f.segments[0], np.uint8))
        if len(bits) < 9 * n:
            raise BadFrame("the scan ends too early")
        bits = bits[: 9 * n].reshape(n, 9)
        words = np.zeros(n, np.uint16)
        for k in range(9):
            words = words << 1 | bits[:, k]
        d = _BACK[words].astype(np.int64)
        if (d == -1000).any():
            raise BadFrame("no such code")
    else:
        bits = Bits(f.segments[0])
        d = np.array([bits.signed(bits.symbol(table)) for _ in range(n)], np.int64)
    d = d.reshape(f.height, f.width)
    d[0, 0] += 128
    d[:, 0] = np.cumsum(d[:, 0])
    return (np.cumsum(d, axis=1) & 255).astype(np.uint8)[:, :, None]


def _baseline(f: Frame) -> np.ndarray:
    if f.depth != 8 or not f.parts:
        raise BadFrame("of baseline frames only 8-bit ones are decoded")
    hm, vm = max(p[1] for p in f.parts), max(p[2] for p in f.parts)
    if len(f.parts) == 1:
        f.parts = [(f.parts[0][0], 1, 1, f.parts[0][3])]
        hm = vm = 1
    across, down = -(-f.width // (8 * hm)), -(-f.height // (8 * vm))
    planes = {p[0]: np.zeros((down * p[2], across * p[1], 64)) for p in f.parts}
    per, unit = f.restart or across * down, 0
    for segment in f.segments:
        bits, last = Bits(segment), dict.fromkeys(planes, 0)
        for unit in range(unit, min(unit + per, across * down)):  # noqa: B020, PLR1704
            my, mx = divmod(unit, across)
            for key, h, v, q in f.parts:
                dc, ac = f.table(False, f.tables[key][0]), f.table(True, f.tables[key][1])
                for y in range(v):
                    for x in range(h):
                        block = planes[key][my * v + y, mx * h + x]
                        last[key] += bits.signed(bits.symbol(dc))
                        block[0], k = last[key], 1
                        while k < 64:
                            run, size = divmod(bits.symbol(ac), 16)
                            if not size and run != 15:
                                break
                            k += run
                            if size:
                                if k > 63:
                                    raise BadFrame("a run beyond its block")
                                block[k] = bits.signed(size)
                            k += 1
        unit += 1
    out = np.zeros((f.height, f.width, len(f.parts)), np.uint8)
    for c, (key, h, v, q) in enumerate(f.parts):
        if q not in f.quant:
            raise BadFrame("no quantization table")
        coefs = np.zeros_like(planes[key])
        coefs[..., ZIGZAG] = planes[key] * f.quant[q]
        blocks = _DCT.T @ coefs.reshape(*coefs.shape[:2], 8, 8) @ _DCT
        plane = blocks.transpose(0, 2, 1, 3).reshape(coefs.shape[0] * 8, -1)
        plane = plane.repeat(vm // v, axis=0).repeat(hm // h, axis=1)[: f.height, : f.width]
        out[:, :, c] = np.clip(np.round(plane + 128), 0, 255)
    return out
