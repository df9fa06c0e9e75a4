"""Vectorised helpers over Arrow text columns: bytes, words, hashes and winnowed anchors.

Everything here runs inside a Spark task on one Arrow batch. Texts are handled as one
concatenated UTF-8 byte array plus document offsets, so no Python string is built.
A null text counts as an empty one. A word is a maximal run of bytes other than
0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_powers = {"pow": np.ones(1, U64), "inv": np.ones(1, U64)}
CHUNK = 1 << 18


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes (uint8) and its n + 1 offsets (int64)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes unchanged."""
    return _LOWER[data]


def doc_slices(off: np.ndarray, limit: int = 1 << 20):
    """Ranges [i, j) of documents that hold about `limit` bytes each (one document at least)."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and for each document the index of its first word (n + 1 long)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    space = _SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.ones(n, bool)
    before[1:] = space[:-1]
    after = np.ones(n, bool)
    after[:-1] = space[1:]
    starts = np.flatnonzero(~space & (before | edge[:-1]))
    ends = np.flatnonzero(~space & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["pow"]) < n:
        size = max(n, CHUNK * 4)
        for name, base in (("pow", _BASE), ("inv", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["pow"], _powers["inv"]


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, whatever stands around it. Spans are in order of start."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + 4 * CHUNK)))
        lo, hi = int(starts[i]), int(ends[i:j].max())
        power, inverse = _power(hi - lo)
        total = np.zeros(hi - lo + 1, U64)
        np.cumsum(_BYTE_CODE[data[lo:hi]] * power[: hi - lo], out=total[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64))
        i = j
    return out


def gram_hash(codes: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k codes: len(codes) - k + 1 values. The caller masks runs that cross documents."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    base, width, level, done, out = U64(_BASE), 1, codes, 0, None
    power_of = {1: base}
    with np.errstate(over="ignore"):
        while width <= k:
            if k & width:
                piece = level[done : done + n] if len(level) >= done + n else level[done:]
                out = piece.copy() if out is None else out * power_of[width] + piece
                done += width
            if width * 2 <= k:
                level = level[:-width] * power_of[width] + level[width:]
                power_of[width * 2] = power_of[width] * power_of[width]
            width *= 2
    return mix(out[:n])


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    width = 1
    while width * 2 <= w:
        a = np.minimum(a[:-width], a[width:])
        width *= 2
    return np.minimum(a[: len(a) - (w - width)], a[w - width :]) if width < w else a


def anchors(codes, off: np.ndarray, k: int, window: int):
    """Winnowing (robust: leftmost minimum). For each window of `window` units that lies in one
    document, the k-gram of least hash is its anchor, which depends on the window's content alone;
    so equal windows have equal anchors at equal places.

    `codes` is a uint64 array of unit codes or a uint8 array of bytes. Returns for each anchor its
    k-gram hash, its position and the first and last start of the windows that it owns. Every
    window belongs to exactly one anchor.
    """
    w, n = window - k + 1, int(off[-1])
    out: list[tuple] = []
    for c0 in range(0, max(0, n - window + 1), CHUNK):
        c1 = min(c0 + CHUNK, n - window + 1)
        unit = codes[c0 : c1 + window - 1]
        g = gram_hash(_BYTE_CODE[unit] if unit.dtype == np.uint8 else unit, k)
        key = (g & U64(~np.uint64(0xFFFFF))) | np.arange(len(g), dtype=U64)
        i, j = np.searchsorted(off, c0, side="right") - 1, np.searchsorted(off, c1, side="left")
        own = np.diff(np.clip(off[i : j + 1], c0, c1))  # units of the chunk by document
        start = np.flatnonzero(np.arange(c0, c1) <= np.repeat(off[i + 1 : j + 1] - window, own))
        if not len(start):
            continue
        at = (_sliding_min(key, w)[start] & U64(0xFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1])]))
        last = np.concatenate([first[1:] - 1, [len(at) - 1]])
        out.append((g[at[first]], at[first] + c0, start[first] + c0, start[last] + c0))
    if not out:
        return np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3))
    g, a, lo, hi = (np.concatenate(x) for x in zip(*out))
    keep = np.concatenate([[True], a[1:] != a[:-1]])
    first = np.flatnonzero(keep)
    last = np.concatenate([first[1:] - 1, [len(a) - 1]])
    return g[first], a[first], lo[first], hi[last]


def expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... counts[0] of them, then those of starts[1], and so on."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    shift = np.repeat(np.asarray(starts, np.int64) - (np.cumsum(counts) - counts), counts)
    return np.arange(total, dtype=np.int64) + shift


def covered(n: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A mask of n units, true for those in any [lo, hi)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    return np.cumsum(step[:n]) > 0
