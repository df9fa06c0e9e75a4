"""Candidates for repeated windows, shared by the two substring operators.

Every window of `window` units (bytes or words) has one anchor, the winnowed k-gram that its
content picks, so equal windows have equal anchors. The windows that an anchor owns make up its
passage. Passages whose k-gram occurs once in the corpus are dropped; the others meet in the range
of their k-gram's hash, which finds the windows that repeat and gives back spans of units.

A k-gram of over `hot` occurrences isn't gathered: its passages are cut into windows, which
meet by their own hashes, pre-aggregated by block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.llm import text as T

HOT = 50_000


@dataclass
class Units:
    """A block's texts as units: codes (uint8 bytes or uint64 words), offsets by document."""

    codes: np.ndarray
    off: np.ndarray
    data: np.ndarray
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None


def as_bytes(table: pa.Table) -> Units:
    data, off = T.text_bytes(table.column("text"))
    return Units(data, off, data)


def as_words(table: pa.Table) -> Units:
    data, off = T.text_bytes(table.column("text"))
    starts, ends, first = [], [], [np.zeros(1, np.int64)]
    n = 0
    for i, j in T.doc_slices(off):
        s, e, f = T.words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        starts.append(s + off[i])
        ends.append(e + off[i])
        first.append(f[1:] + n)
        n += len(s)
    none = np.zeros(0, np.int64)
    starts, ends = np.concatenate([none, *starts]), np.concatenate([none, *ends])
    return Units(T.span_hash(data, starts, ends), np.concatenate(first), data, starts, ends)


@dataclass
class Anchors:
    """Anchors of a block by position: k-gram hash, position, first and last owned start, document."""

    gram: np.ndarray
    at: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    doc: np.ndarray

    def take(self, rows) -> Anchors:
        return Anchors(self.gram[rows], self.at[rows], self.lo[rows], self.hi[rows], self.doc[rows])


def find_anchors(units: Units, k: int, window: int) -> Anchors:
    gram, at, lo, hi = T.anchors(units.codes, units.off, k, window)
    gram = T.mix(gram)  # the least hashes of their windows aren't spread evenly over the ranges
    return Anchors(gram, at, lo, hi, np.searchsorted(units.off, at, side="right") - 1)


def removed_spans(docs: DataFrame, n_blocks: int, read: Callable[[pa.Table], Units], k: int, window: int, ship: Callable, resolve: Callable, ordered: bool, hot: int = HOT, fan: int = B.FAN) -> DataFrame:
    """(block, data): for each block, spans of units to remove, as packed document, from, to.

    `ship(units, anchors, ids)` packs a block's passages for one range, `resolve(blobs)` finds the
    repeated windows among those of all blocks: for each blob, document, from and to. With
    `ordered`, the earliest occurrence of a repeated window stays.
    """
    n_parts = n_blocks

    def keys_of(table: pa.Table) -> list[B.Keys]:
        keys, counts = B.counted(find_anchors(read(table), k, window).gram)
        return [B.Keys(keys, [np.minimum(counts, 1 << 30).astype(np.uint32)])]

    # of each k-gram: 0 once in the corpus, 1 more often, 2 over `hot` times
    level_of = lambda _, sums: [(sums[0] > 1).astype(np.int64) + (sums[0] > hot)]
    levels = B.look_up(docs, n_blocks, keys_of, [1], [64], level_of, lambda _: [], fan=fan).select("block", "part", "data")

    def passages(table: pa.Table, replies: list[bytes]) -> pa.Table:
        block = table.column("block")[0].as_py()
        units = read(table)
        found = find_anchors(units, k, window)
        keys, inverse = np.unique(found.gram, return_inverse=True)
        level = np.concatenate([np.zeros(0, np.uint8), *(B.unpack(B.split_parts(x)[0]) for x in replies)])[inverse]
        ids = table.column("id").to_numpy()
        rank = _ranks(ids)
        out = []
        few = found.take(np.flatnonzero(level == 1))
        part = B.part_of(few.gram, n_parts)
        order = np.argsort(part, kind="stable")
        for p, i, j in B.runs(part[order]):
            out.append((p, b"p" + ship(units, few.take(order[i:j]), ids, rank)))
        many = found.take(np.flatnonzero(level == 2))
        if len(many.at):
            out += _ship_windows(units, many, ids, rank, window, n_parts, ordered, block)
        return B.ask_table(block, out)

    shipped = B.with_answers(docs, levels, passages, B.ASK)

    def settle(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        blocks, blobs = table.column("block").to_pylist(), table.column("data").to_pylist()
        out = []
        decided = lambda own: [tuple(map(B.unpack, B.split_parts(x))) for x in own]
        for kind, how in ((b"p", resolve), (b"w", lambda own: _resolve_windows(own, window, ordered)), (b"s", decided)):
            own = [i for i, x in enumerate(blobs) if x[:1] == kind]
            if own:
                for i, spans in zip(own, how([blobs[i][1:] for i in own])):
                    if len(spans[0]):
                        out.append((blocks[i], B.join_parts(*map(B.pack, _merge(*spans)))))
        B.release()
        return pa.table({"block": pa.array([b for b, _ in out], pa.int32()), "part": pa.array([0] * len(out), pa.int32()), "data": pa.array([d for _, d in out], pa.binary())})

    return shipped.groupBy("part").applyInArrow(settle, B.ASK)


def _ranks(ids: np.ndarray) -> np.ndarray:
    """Numbers rows of equal id, which are neighbours, from 0."""
    n = len(ids)
    new = np.ones(n, bool)
    new[1:] = ids[1:] != ids[:-1]
    first = np.flatnonzero(new)
    return np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))


def place(units: Units, at: np.ndarray, doc: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """An order of places among documents of one id: the row's number, then the position."""
    return (rank[doc] << 40) | (at - units.off[doc])


def _ship_windows(units: Units, a: Anchors, ids, rank, window: int, n_parts: int, ordered: bool, block: int) -> list[tuple[int, bytes]]:
    """The distinct windows of hot anchors by two hashes, each with its first place in the block and
    how often it occurs there. What the block's own repeats decide is sent as spans."""
    n = a.hi - a.lo + 1
    start, doc = T.expand(a.lo, n), np.repeat(a.doc, n)
    first, second = np.empty(len(start), T.U64), np.empty(len(start), T.U64)
    step = 1 << 18
    for c in range(0, len(units.codes), step):
        i, j = np.searchsorted(start, [c, c + step])
        if j > i:
            part = units.codes[c : c + step + window - 1]
            part = T._BYTE_CODE[part] if part.dtype == np.uint8 else part
            first[i:j] = T.gram_hash(part, window)[start[i:j] - c]
            second[i:j] = T.gram_hash(T.mix(part), window)[start[i:j] - c]
    order = np.lexsort((start, second, first))
    first, second, start, doc = first[order], second[order], start[order], doc[order]
    new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
    lead = np.flatnonzero(new)
    counts = np.diff(np.append(lead, len(new)))
    decided = ~new if ordered else np.repeat(counts > 1, counts)
    out = []
    if decided.any():
        d, s = doc[decided], start[decided] - units.off[doc[decided]]
        out.append((block % n_parts, b"s" + B.join_parts(*map(B.pack, _merge(d, s, s + window)))))
    first, second, start, doc = first[lead], second[lead], start[lead], doc[lead]
    for p, i, j in B.runs(B.part_of(first, n_parts)):
        d, s = doc[i:j], start[i:j]
        out.append((p, b"w" + B.join_parts(B.pack_keys(first[i:j]), B.pack(second[i:j]), B.pack(counts[i:j].astype(np.int32)), B.pack(d.astype(np.int32)), B.pack((s - units.off[d]).astype(np.int64)), B.pack(ids[d].astype(np.int64)), B.pack(place(units, s, d, rank)))))
    return out


def _resolve_windows(blobs: list[bytes], window: int, ordered: bool) -> list[tuple]:
    parts = [B.split_parts(b) for b in blobs]
    sizes = [len(B.unpack(p[2])) for p in parts]
    first, second = np.concatenate([B.unpack_keys(p[0]) for p in parts]), np.concatenate([B.unpack(p[1]) for p in parts])
    counts, doc, start, ids, where = (np.concatenate([B.unpack(p[i]) for p in parts]) for i in range(2, 7))
    source = np.repeat(np.arange(len(parts)), sizes)
    order = np.lexsort((where, ids, second, first))
    f, s = first[order], second[order]
    same = np.concatenate([[False], (f[1:] == f[:-1]) & (s[1:] == s[:-1])])
    repeated = same.copy()
    if not ordered:
        repeated[:-1] |= same[1:]
        repeated &= counts[order] == 1  # the others are decided in their block
    hit = order[repeated]
    return [(doc[x], start[x], start[x] + window) for x in (hit[source[hit] == b] for b in range(len(parts)))]


def _merge(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Joins spans of a document that overlap or touch."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order].astype(np.int64), lo[order].astype(np.int64), hi[order].astype(np.int64)
    far = doc << 40
    reach = np.maximum.accumulate(far + hi)
    new = np.concatenate([[True], (far + lo)[1:] > reach[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first].astype(np.int32), lo[first], reach[last] - far[first]


def spans_of(replies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All spans of a block, joined."""
    if not replies:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    parts = [[B.unpack(x) for x in B.split_parts(r)] for r in replies]
    return _merge(*(np.concatenate([p[i] for p in parts]) for i in range(3)))


def long_ids(df: DataFrame, id_col: str) -> DataFrame:
    """The id as a long; places are compared by it. A null id counts as the least one."""
    if dict(df.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} must be an integer column")
    return df.withColumn(id_col, F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))))
