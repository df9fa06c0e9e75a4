"""Baseline JPEG frames (ITU-T T.81, sequential DCT, Huffman coding, 8 bits) of one or three components.

Motion-JPEG streams leave out Huffman tables and mean the standard ones then. Coefficients are read
in scan order; dequantisation, the inverse transform, upsampling and colour conversion are done for
all blocks of a frame at once.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

# The Huffman tables of T.81 annex K (numbers of codes by length, then symbols).
DC_LUMA = (bytes.fromhex("00010501010101010100000000000000"), bytes.fromhex("000102030405060708090a0b"))
DC_CHROMA = (bytes.fromhex("00030101010101010101010000000000"), bytes.fromhex("000102030405060708090a0b"))
AC_LUMA = (
    bytes.fromhex("0002010303020403050504040000017d"),
    bytes.fromhex(
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
        "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
    ),
)
AC_CHROMA = (
    bytes.fromhex("00020102040403040705040400010277"),
    bytes.fromhex(
        "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
        "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
    ),
)
STANDARD = {(0, 0): DC_LUMA, (0, 1): DC_CHROMA, (1, 0): AC_LUMA, (1, 1): AC_CHROMA}

#: Places of a block in zigzag order: by diagonals, in turn up and down.
ZIGZAG = np.array([u * 8 + v for u, v in sorted(((u, v) for u in range(8) for v in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else -p[0]))])
#: The rows of the orthonormal cosine transform.
COSINES = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * x + 1) * k * np.pi / 16) for x in range(8)] for k in range(8)])


@lru_cache(64)
def lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int]]:
    """(symbol, length) by the next 16 bits; length 0 where no code stands."""
    out = [(0, 0)] * (1 << 16)
    code = at = 0
    for n, count in enumerate(counts, 1):
        for _ in range(count):
            span = 1 << (16 - n)
            out[code * span : (code + 1) * span] = [(symbols[at], n)] * span
            code, at = code + 1, at + 1
        code <<= 1
    return out


class Frame:
    """The header of a frame: what its scan means."""

    def __init__(self, data: bytes):
        self.quantisation: dict[int, np.ndarray] = {}
        self.huffman = dict(STANDARD)
        self.components: list[tuple[int, int, int, int]] = []  # id, horizontal, vertical, quantisation table
        self.restart, self.scan, at = 0, [], 2
        self.width = self.height = 0
        while True:
            if at + 4 > len(data):
                raise ValueError("a frame without a scan")
            if data[at] != 0xFF:
                raise ValueError("a marker is missing")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            size = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self._quantisation(body)
            elif marker == 0xC4:
                self._huffman(body)
            elif marker in (0xC0, 0xC1):
                precision, self.height, self.width, n = struct.unpack_from(">BHHB", body)
                if precision != 8 or n not in (1, 3):
                    raise ValueError("frames have one or three components of 8 bits")
                self.components = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
                raise ValueError("only baseline frames are read here")
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xDA:
                tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                if len(tables) != len(self.components):
                    raise ValueError("components in scans of their own aren't read")
                self.scan, self.start = [tables[c[0]] for c in self.components], at
                return

    def _quantisation(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            wide, name = body[at] >> 4, body[at] & 15
            self.quantisation[name] = np.frombuffer(body, ">u2" if wide else "u1", 64, at + 1).astype(np.float64)
            at += 65 + 64 * bool(wide)

    def _huffman(self, body: bytes) -> None:
        at = 0
        while at < len(body):
            counts = body[at + 1 : at + 17]
            self.huffman[body[at] >> 4, body[at] & 15] = (counts, body[at + 17 : at + 17 + sum(counts)])
            at += 17 + sum(counts)


class Bits:
    """The bits of one restart interval, stuffed zeros taken out."""

    def __init__(self, data: bytes):
        self.data, self.held, self.n, self.at = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def peek(self, n: int) -> int:
        while self.n < n:
            part = self.data[self.at : self.at + 8].ljust(8, b"\xff")  # padded with ones, as encoders do
            self.at += 8
            self.held = ((self.held & ((1 << self.n) - 1)) << 64) | int.from_bytes(part, "big")
            self.n += 64
        return (self.held >> (self.n - n)) & ((1 << n) - 1)

    def symbol(self, table: list[tuple[int, int]]) -> int:
        value, used = table[self.peek(16)]
        if not used:
            raise ValueError("no such code")
        self.n -= used
        return value

    def signed(self, n: int) -> int:
        if not n:
            return 0
        value = self.peek(n)
        self.n -= n
        return value if value >> (n - 1) else value - (1 << n) + 1


def _intervals(data: bytes) -> list[bytes]:
    """The entropy-coded data of a scan, cut at restart markers."""
    out, first, at = [], 0, 0
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*out, data[first:]]
        marker = data[at + 1]
        if 0xD0 <= marker <= 0xD7:
            out.append(data[first:at])
            first = at + 2
        elif marker not in (0, 0xFF):
            return [*out, data[first:at]]
        at += 2 if marker != 0xFF else 1


def decode(data: bytes) -> np.ndarray:
    """The samples of a frame: height x width, or height x width x 3 (red, green, blue)."""
    f = Frame(data)
    if not f.width or not f.height or not f.components:
        raise ValueError("a frame without a size")
    if len(f.components) == 1:  # one component is never interleaved, whatever its factors
        f.components = [(f.components[0][0], 1, 1, f.components[0][3])]
    across, down = max(c[1] for c in f.components), max(c[2] for c in f.components)
    columns, lines = -(-f.width // (8 * across)), -(-f.height // (8 * down))
    planes = [np.zeros((lines * c[2], columns * c[1], 64)) for c in f.components]
    tables = [(lookup(*f.huffman[0, d]), lookup(*f.huffman[1, a])) for d, a in f.scan]
    intervals = iter(_intervals(data[f.start :]))
    unit, n_units = 0, columns * lines
    while unit < n_units:
        bits = Bits(next(intervals, b""))
        last = [0] * len(planes)
        for unit in range(unit, min(n_units, unit + (f.restart or n_units))):
            line, column = divmod(unit, columns)
            for k, (_, h, v, _) in enumerate(f.components):
                dc, ac = tables[k]
                for y in range(v):
                    for x in range(h):
                        block = planes[k][line * v + y, column * h + x]
                        last[k] += bits.signed(bits.symbol(dc))
                        block[0] = last[k]
                        at = 1
                        while at < 64:
                            code = bits.symbol(ac)
                            run, size = code >> 4, code & 15
                            if not size:
                                if run < 15:
                                    break
                                at += 16
                                continue
                            at += run
                            if at > 63:
                                raise ValueError("too many coefficients")
                            block[at] = bits.signed(size)
                            at += 1
        unit += 1
    samples = []
    for (_, h, v, q), plane in zip(f.components, planes):
        natural = np.empty_like(plane)
        natural[..., ZIGZAG] = plane * f.quantisation[q]
        blocks = COSINES.T @ natural.reshape(*plane.shape[:2], 8, 8) @ COSINES + 128
        full = blocks.swapaxes(1, 2).reshape(plane.shape[0] * 8, plane.shape[1] * 8)
        full = full.repeat(down // v, axis=0).repeat(across // h, axis=1)
        samples.append(full[: f.height, : f.width])
    if len(samples) == 1:
        return np.clip(np.rint(samples[0]), 0, 255).astype(np.uint8)
    y, cb, cr = samples[0], samples[1] - 128, samples[2] - 128
    rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)
