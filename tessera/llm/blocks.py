"""Blocks of documents, and bulk look-ups between blocks and key ranges.

Documents are dealt by a hash of their id into blocks of bounded size, in a fixed order within a
block. A block asks for what it needs to know about its distinct keys with one compressed array
for each key range; a range answers all blocks that asked; the answers come back to the block.
Keys are pre-aggregated in their block, so a key that a third of all rows hold costs a range no
more than one entry a block.

Blocks and ranges keep their size whatever the input's, so their numbers grow with it. Up to `FAN`
of them speak to one another directly. Beyond that, questions go by way of groups: about sqrt(n)
blocks of one group send a wide range what they ask, the group asks for its merged keys once and
deals out the answers, so that n blocks send about n * sqrt(n) arrays instead of n * n.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as T

BLOCK_BYTES, FAN = 4 << 20, 8192
ASK = "block int, part int, data binary"
_libc = ctypes.CDLL(None)


def block_count(df: DataFrame, text_col: str, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks of about block_bytes."""
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(1, -(-total // block_bytes))


def deal(df: DataFrame, id_col: str, text_col: str, n_blocks: int, *others: Column) -> DataFrame:
    """(block, id, text, others) of `df`; a null text is an empty one."""
    return df.select(F.pmod(F.xxhash64(id_col), F.lit(n_blocks)).cast("int").alias("block"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *others)


def folded(df: DataFrame, without: str | None = None) -> Column:
    """All columns of `df` but `without` as one struct of numbered fields, so that no name clashes with one in use here."""
    return F.struct(F.lit(None).cast("int").alias("none"), *(df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(df.columns) if c != without))


def unfolded(df: DataFrame, names: list[str], row: str, **changed: Column) -> DataFrame:
    """The columns behind `row`, made by `folded`; those in `changed` get new values."""
    return df.select(*(changed[c].alias(c) if c in changed else F.col(row)[f"c{i}"].alias(c) for i, c in enumerate(names)))


def in_order(table: pa.Table) -> pa.Table:
    """A block's rows by id, then text: the same whenever and wherever the block is computed."""
    return table.sort_by([("id", "ascending"), ("text", "ascending")]) if table.num_rows > 1 else table


def pack(a: np.ndarray) -> bytes:
    """A compressed integer array."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return len(a).to_bytes(8, "little") + a.dtype.str[1:].encode().ljust(4) + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def unpack(b: bytes) -> np.ndarray:
    n, kind = int.from_bytes(b[:8], "little"), np.dtype(b[8:12].decode().strip())
    if not n:
        return np.zeros(0, kind)
    raw = pa.decompress(b[12:], n * kind.itemsize, "zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).ravel()


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys, as differences."""
    return pack(np.diff(keys, prepend=T.U64(0)))


def unpack_keys(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=T.U64)


def join_parts(*parts: bytes) -> bytes:
    return len(parts).to_bytes(4, "little") + b"".join(len(p).to_bytes(8, "little") for p in parts) + b"".join(parts)


def split_parts(b: bytes) -> list[bytes]:
    n = int.from_bytes(b[:4], "little")
    at, out = 4 + 8 * n, []
    for i in range(n):
        size = int.from_bytes(b[4 + 8 * i : 12 + 8 * i], "little")
        out.append(b[at : at + size])
        at += size
    return out


def part_of(keys: np.ndarray, n_parts: int) -> np.ndarray:
    """The number of the range, of n_parts equal ones, that each 64-bit key lies in."""
    return ((keys >> T.U64(32)) * T.U64(n_parts) >> T.U64(32)).astype(np.int64)


def runs(values: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values."""
    edge = np.flatnonzero(values[1:] != values[:-1]) + 1
    return list(zip(values[np.concatenate([[0], edge])].tolist(), [0, *edge.tolist()], [*edge.tolist(), len(values)])) if len(values) else []


@dataclass
class Keys:
    """Ascending distinct keys of `bits` bits, with columns of counts beside them."""

    keys: np.ndarray
    counts: list[np.ndarray]
    bits: int = 64

    def pieces(self, n_parts: int) -> dict[int, list[bytes]]:
        wide = self.keys << T.U64(64 - self.bits) if self.bits < 64 else self.keys
        return {p: [pack_keys(self.keys[a:b]), *(pack(c[a:b]) for c in self.counts)] for p, a, b in runs(part_of(wide, n_parts))}


def _send(spaces: list[Keys], n_parts: int) -> list[tuple[int, bytes]]:
    pieces = [x.pieces(n_parts) for x in spaces]
    empty = [[pack_keys(np.zeros(0, T.U64)), *(pack(c[:0]) for c in x.counts)] for x in spaces]
    found = sorted(set().union(*pieces))
    return [(p, join_parts(*(b for x, e in zip(pieces, empty) for b in x.get(p, e)))) for p in found]


def _receive(blobs: list[bytes], widths: list[int]) -> list[tuple[list[np.ndarray], np.ndarray, np.ndarray, list[np.ndarray]]]:
    """For each space: the keys of each blob, the distinct keys, each key's place in them, and sums of the counts."""
    parts = [split_parts(x) for x in blobs]
    out, at = [], 0
    for width in widths:
        keys = [unpack_keys(p[at]) for p in parts]
        distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        sums = [np.bincount(inverse, weights=np.concatenate([unpack(p[at + 1 + c]) for p in parts]), minlength=len(distinct)).astype(np.int64) for c in range(width)]
        out.append((keys, distinct, inverse, sums))
        at += 1 + width
    return out


def _narrow(counts: np.ndarray) -> np.ndarray:
    top = int(counts.max(initial=0))
    return counts.astype(np.uint8 if top < 256 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)


def look_up(blocks: DataFrame, n_blocks: int, keys_of: Callable[[pa.Table], list[Keys]], widths: list[int], bits: list[int], reply: Callable[[int, list[np.ndarray]], list[np.ndarray]], sums: Callable[[list], list[int]], wants: Callable[[int], list[bool]] | None = None, fan: int = FAN) -> DataFrame:
    """(block, part, data, sums): what is known about each block's keys, ordered by part.

    `keys_of` gives a block's keys of each space, with `widths` columns of counts and `bits` bits. A
    range adds the counts up, and `reply(space, sums by column)` makes columns of answers from them,
    of which a block gets those that `wants(block)` names. `sums(spaces)` are totals over a range's
    (distinct keys, sums); each stands in one row of the result.
    """
    n_parts, n_groups = n_blocks, 0
    if n_blocks > fan:
        n_groups = math.isqrt(n_blocks - 1) + 1
        fine = -(-n_blocks // n_groups)
        n_parts = n_groups

    def ask(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        found = _send(keys_of(in_order(table)), n_parts)
        release()
        return ask_table(block, found)

    def deal_out(spaces, answers: list[list[np.ndarray]], names: list[int], keep) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in names]
        for (keys, _, inverse, _), columns in zip(spaces, answers):
            cuts = np.cumsum([len(k) for k in keys])[:-1]
            for n, column in enumerate(columns):
                for x, own in enumerate(np.split(column[inverse], cuts)):
                    out[x].append(pack(_narrow(own)) if keep is None or keep(names[x])[n] else b"")
        return [join_parts(*x) for x in out]

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        names = table.column("block").to_pylist()
        spaces = _receive(table.column("data").to_pylist(), widths)
        data = deal_out(spaces, [reply(k, x[3]) for k, x in enumerate(spaces)], names, None if n_groups else wants)
        total = sums([(x[1], x[3]) for x in spaces])
        release()
        return pa.table({"block": table.column("block"), "part": table.column("part"), "data": pa.array(data, pa.binary()), "sums": pa.array([total, *[[0] * len(total)] * (len(names) - 1)], pa.list_(pa.int64()))})

    known = ASK + ", sums array<long>"
    asked = blocks.groupBy("block").applyInArrow(ask, ASK)
    if not n_groups:
        return asked.groupBy("part").applyInArrow(answer, known)

    def merge(table: pa.Table) -> pa.Table:
        group, part = table.column("block")[0].as_py() % n_groups, table.column("part")[0].as_py()
        spaces = [Keys(x[1], [_narrow(c) for c in x[3]], b) for x, b in zip(_receive(table.column("data").to_pylist(), widths), bits)]
        found = _send(spaces, n_groups * fine)
        release()
        return pa.table({**{c: v for c, v in zip(("block", "part", "data"), ask_table(group, found).columns)}, "wide": pa.array([part] * len(found), pa.int32())})

    def hand_out(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({})
        table, answers = table.sort_by("block"), answers.sort_by("part")
        names = table.column("block").to_pylist()
        spaces = _receive(table.column("data").to_pylist(), widths)
        parts = [split_parts(x) for x in answers.column("data").to_pylist()]
        columns, at = [], 0
        for k in range(len(widths)):
            n = len(reply(k, [np.zeros(0, np.int64)] * widths[k]))
            columns.append([np.concatenate([unpack(p[at + c]).astype(np.int64) for p in parts]) for c in range(n)])
            at += n
        data = deal_out(spaces, columns, names, wants)
        total = np.array(answers.column("sums").to_pylist(), np.int64).sum(0).tolist()
        release()
        return pa.table({"block": table.column("block"), "part": table.column("part"), "data": pa.array(data, pa.binary()), "sums": pa.array([total, *[[0] * len(total)] * (len(names) - 1)], pa.list_(pa.int64()))})

    group = F.pmod("block", F.lit(n_groups)).alias("group")
    merged = asked.groupBy("part", group).applyInArrow(merge, ASK + ", wide int")
    answers = merged.groupBy("part").applyInArrow(answer, known)
    back = answers.withColumn("wide", F.floor(F.col("part") / fine).cast("int"))
    return asked.groupBy("part", group).cogroup(back.groupBy("wide", "block")).applyInArrow(hand_out, known)


def ask_table(block: int, found: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"block": pa.array([block] * len(found), pa.int32()), "part": pa.array([p for p, _ in found], pa.int32()), "data": pa.array([d for _, d in found], pa.binary())})


def with_answers(blocks: DataFrame, answers: DataFrame, run: Callable[[pa.Table, list[bytes]], pa.Table], schema: str) -> DataFrame:
    """Runs `run(documents in order, answers by range)` on each block."""

    def both(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({})
        out = run(in_order(docs), replies.sort_by("part").column("data").to_pylist() if replies.num_rows else [])
        release()
        return out

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(both, schema)


def release() -> None:
    """Gives freed memory back to the system: a Python worker outlives its task, and the memory that it
    keeps is missing elsewhere on the executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)
