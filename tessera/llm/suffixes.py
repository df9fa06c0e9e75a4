"""Removal of repeated byte strings by a distributed merge sort of suffixes.

Suffixes start at anchors (see `passages`), the only places where a repeated window can show
itself, and reach as far as the anchor's windows do, with what stands left of the anchor behind.
A block sorts its suffixes into a run and sends each range its part of the run, front-coded: the
length of the prefix shared with the suffix before, and the rest. A range merges the runs with a
loser tree that carries these lengths along, so that no known prefix is compared again. In the
merged order equal passages and passages of one k-gram are neighbours; windows that only part of
a passage's neighbours share are found by 64-bit fingerprints and compared byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.llm import passages as P
from tessera.llm import text as T

GRAM = 32
FAMILIES_AT_ONCE = 20_000


def front_code(keys: list[bytes]) -> tuple[np.ndarray, bytes]:
    """For sorted keys, the length of the prefix shared with the one before, and the rests."""
    size = np.array([len(k) for k in keys], np.int64)
    width = int(size.max(initial=0))
    grid = np.frombuffer(b"".join([k.ljust(width, b"\0") for k in keys]), np.uint8).reshape(len(keys), width)
    same = np.ones((len(keys) - 1, width + 1), bool)
    np.equal(grid[1:], grid[:-1], out=same[:, :-1])
    same[:, -1] = False
    shared = np.concatenate([[0], np.minimum(same.argmin(1), np.minimum(size[1:], size[:-1]))])
    return shared, b"".join([k[s:] for k, s in zip(keys, shared.tolist())])


def front_decode(size: np.ndarray, shared: np.ndarray, rest: bytes) -> list[bytes]:
    out, at, key = [], 0, b""
    for n, s in zip(size.tolist(), shared.tolist()):
        end = at + n - s
        key = key[:s] + rest[at:end]
        out.append(key)
        at = end
    return out


def shared_prefix(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which `known` bytes are known."""
    n = min(len(a), len(b))
    end = min(known + 4, n)
    while known < end:
        if a[known] != b[known]:
            return known
        known += 1
    if a[known:n] == b[known:n]:
        return n
    step = 8
    while a[known : known + step] == b[known : known + step]:
        known += step
        step *= 2
    while step > 1:  # a difference lies within the next `step` bytes
        step = (step + 1) // 2
        if a[known : known + step] == b[known : known + step]:
            known += step
    return known


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Merges sorted runs with their shared-prefix lengths: the run and place of each key in the
    merged order, and the length of the prefix shared with the key before.

    Each loser in the tree holds the length of the prefix that it shares with the key that beat it.
    Of two keys compared with the same last winner the one sharing more is the lesser; only on a
    tie are bytes compared, from the shared length on.
    """
    n = len(runs)
    if n == 1:
        return [0] * len(runs[0][0]), list(range(len(runs[0][0]))), list(runs[0][1])
    leaves = 1 << (n - 1).bit_length()
    heads: list[bytes | None] = [runs[r][0][0] if r < n and runs[r][0] else None for r in range(leaves)]
    share = [0] * leaves
    at = [0] * leaves
    loser = [0] * leaves

    def beats(a: int, b: int) -> bool:
        """Whether the head of run a comes before that of run b; the loser's length is set."""
        x, y = heads[a], heads[b]
        if y is None:
            return True
        if x is None:
            return False
        if share[a] != share[b]:
            return share[a] > share[b]
        h = shared_prefix(x, y, share[a])
        first = x[h:] <= y[h:]
        share[b if first else a] = h
        return first

    winners = list(range(leaves))
    level = leaves
    while level > 1:
        up = []
        for i in range(0, level, 2):
            a, b = winners[i], winners[i + 1]
            won, lost = (a, b) if beats(a, b) else (b, a)
            loser[(level + i) // 2] = lost
            up.append(won)
        winners, level = up, level // 2
    best = winners[0]
    out_run, out_at, out_share = [], [], []
    while heads[best] is not None:
        out_run.append(best)
        out_at.append(at[best])
        out_share.append(share[best])
        at[best] += 1
        keys, shared = runs[best]
        if at[best] < len(keys):
            heads[best], share[best] = keys[at[best]], shared[at[best]]
        else:
            heads[best], share[best] = None, -1
        node = (leaves + best) // 2
        while node:
            other = loser[node]
            if not beats(best, other):
                loser[node], best = best, other
            node //= 2
    return out_run, out_at, out_share


def _ship(window: int):
    def ship(units: P.Units, a: P.Anchors, ids: np.ndarray, rank: np.ndarray) -> bytes:
        raw = units.data
        keys = []
        for g, at, lo, hi in zip(a.gram.byteswap(), a.at.tolist(), a.lo.tolist(), (a.hi + window).tolist()):
            keys.append(g.tobytes() + raw[at:hi].tobytes() + raw[lo:at].tobytes() + (at - lo).to_bytes(4, "big"))
        order = sorted(range(len(keys)), key=keys.__getitem__)  # stable: places stay in order
        keys = [keys[i] for i in order]
        new = np.array([True, *(x != y for x, y in zip(keys, keys[1:]))])
        first = np.flatnonzero(new)
        distinct = [keys[i] for i in first.tolist()]
        shared, rest = front_code(distinct)
        order = np.array(order)
        doc, at = a.doc[order], a.at[order]
        where = P.place(units, at, doc, rank)
        counts = np.diff(np.append(first, len(keys)))
        return B.join_parts(
            B.pack(np.array([len(k) for k in distinct], np.uint32)),
            B.pack(shared.astype(np.uint32)),
            len(rest).to_bytes(8, "little") + pa.compress(rest, "zstd", asbytes=True),
            B.pack(counts.astype(np.int32)),
            B.pack(ids[doc[first]].astype(np.int64)),
            B.pack(where[first]),
            B.pack(doc.astype(np.int32)),
            B.pack((at - units.off[doc]).astype(np.int64)),
        )

    return ship


def _lefts(keys: list[bytes]) -> np.ndarray:
    """How many bytes of each passage stand left of its anchor: the last four bytes of its key."""
    return np.frombuffer(b"".join([x[-4:] for x in keys]), ">u4").astype(np.int64)


def _resolve(window: int, k: int):
    def resolve(blobs: list[bytes]) -> list[tuple]:
        runs, entries = [], []
        for blob in blobs:
            size, shared, rest, *beside = B.split_parts(blob)
            size, shared = B.unpack(size), B.unpack(shared)
            rest = pa.decompress(rest[8:], int.from_bytes(rest[:8], "little"), "zstd", asbytes=True)
            runs.append((front_decode(size, shared, rest), shared.tolist()))
            entries.append([B.unpack(x) for x in beside])
        run, at, shared = map(np.array, merge_runs(runs))
        base = np.cumsum([0, *(len(r[0]) for r in runs)])
        entry = base[run] + at  # entries of all blobs, numbered through
        keys = [key for r in runs for key in r[0]]
        size = np.array([len(x) for x in keys])[entry]
        counts, ids, where = (np.concatenate([e[i] for e in entries]) for i in range(3))
        same = np.concatenate([[False], (shared[1:] == size[1:]) & (size[1:] == size[:-1])])
        passage = np.cumsum(~same) - 1
        family = np.cumsum(shared < 8 + k)  # of one k-gram
        # the earliest of equal passages
        order = np.lexsort((where[entry], ids[entry], passage))
        lead = order[np.concatenate([[True], passage[order][1:] != passage[order][:-1]])]
        n_family = np.bincount(family[lead])
        some = lead[n_family[family[lead]] > 1]
        left, right = _repeats_within([keys[i] for i in entry[some].tolist()], family[some], ids[entry[some]], where[entry[some]], window)
        # spans of every occurrence, relative to the anchor: all of the passage but for the earliest
        o = _lefts(keys)
        reach = np.array([len(x) for x in keys], np.int64) - 12 - o
        first = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(counts)), counts)
        lo, hi = -o[owner], reach[owner]
        lead_at = first[entry[lead]]
        lo[lead_at] = hi[lead_at] = 0
        lo[first[entry[some]]], hi[first[entry[some]]] = left, right
        doc = np.concatenate([e[3] for e in entries])
        pos = np.concatenate([e[4] for e in entries])
        source = np.searchsorted(base, owner, side="right") - 1
        out = []
        for b in range(len(blobs)):
            x = np.flatnonzero((source == b) & (hi > lo))
            out.append((doc[x], pos[x] + lo[x], pos[x] + hi[x]))
        return out

    return resolve


def _repeats_within(keys: list[bytes], family, ids, where, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct passages, ordered by family (k-gram), the union of their windows that stand at
    the same place of an earlier passage of the family, relative to the anchor; (0, 0) if none do."""
    n = len(keys)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    edge = np.append(np.flatnonzero(np.concatenate([[True], family[1:] != family[:-1]])), n) if n else []
    first = 0
    for last, stop in zip(edge[1:], [*edge[2:], 0]):  # whole families, some thousands of passages at a time
        if stop - first > FAMILIES_AT_ONCE or not stop:
            part = slice(first, last)
            left[part], right[part] = _family_repeats(keys[part], family[part], ids[part], where[part], window)
            first = last
    return left, right


def _equal_windows(raw: np.ndarray, a: np.ndarray, b: np.ndarray, window: int, at_once: int = 1 << 15) -> np.ndarray:
    """Whether the windows at a and b have the same bytes."""
    reach = np.arange(window)
    return np.concatenate([np.zeros(0, bool), *((raw[a[i : i + at_once, None] + reach] == raw[b[i : i + at_once, None] + reach]).all(1) for i in range(0, len(a), at_once))])


def _family_repeats(keys, family, ids, where, window: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(keys)
    left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
    o = _lefts(keys)
    raw = np.frombuffer(b"".join([x[-4 - n : -4] + x[8 : -4 - n] for x, n in zip(keys, o.tolist())]), np.uint8)
    size = np.array([len(x) for x in keys], np.int64) - 12
    begin = np.cumsum(size) - size
    n_windows = size - window + 1
    owner = np.repeat(np.arange(n), n_windows)
    start = T.expand(begin, n_windows)
    h = np.empty(len(start), T.U64)
    step = 1 << 18
    for c in range(0, len(raw), step):
        a, b = np.searchsorted(start, [c, c + step])
        if b > a:
            h[a:b] = T.gram_hash(T._BYTE_CODE[raw[c : c + step + window - 1]], window)[start[a:b] - c]
    shift = start - begin[owner] - o[owner]  # of the window's start against the anchor
    h = T.mix(h + T.mix(family[owner].astype(T.U64) << T.U64(8)) + shift.astype(T.U64))
    rank = np.empty(n, np.int64)
    rank[np.lexsort((where, ids))] = np.arange(n)
    order = np.lexsort((rank[owner], h))
    same = np.flatnonzero(h[order][1:] == h[order][:-1])
    repeated = order[1:][same]
    repeated = repeated[_equal_windows(raw, start[repeated], start[order[:-1][same]], window)]
    low, high = np.full(n, 1 << 40), np.full(n, -(1 << 40))
    np.minimum.at(low, owner[repeated], shift[repeated])
    np.maximum.at(high, owner[repeated], shift[repeated])
    hit = high >= low
    left[hit], right[hit] = low[hit], high[hit] + window
    return left, right


def remove_repeats(df: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, gram: int = GRAM, hot: int = P.HOT, block_bytes: int = B.BLOCK_BYTES, fan: int = B.FAN) -> DataFrame:
    """Removes each byte that a `window`-byte string covers which also starts earlier: in a text of
    a smaller id, or further left in the same text. Strings are judged on the input; they never
    cross texts; overlapping occurrences count.

    Returns (id, n_bytes, n_removed, n_spans, kept) with kept the remaining bytes (binary), or with
    `digests` kept_sha256 in its place. One row for each row of `df`: rows of one id count as texts
    in the order of their texts. A null text is empty; a null id counts as the least long. Other
    columns are left out.
    """
    n_blocks = B.block_count(df, text_col, block_bytes)
    docs = B.deal(P.long_ids(df.select(id_col, text_col), id_col), id_col, text_col, n_blocks)
    gram = min(gram, window)
    spans = P.removed_spans(docs, n_blocks, P.as_bytes, gram, window, _ship(window), _resolve(window, gram), True, hot, fan)

    def apply(table: pa.Table, replies: list[bytes]) -> pa.Table:
        data, off = T.text_bytes(table.column("text"))
        doc, lo, hi = P.spans_of(replies)
        kept = np.ones(len(data), bool)
        kept[T.expand(off[doc] + lo, hi - lo)] = False
        removed = np.bincount(doc, weights=hi - lo, minlength=len(off) - 1).astype(np.int64)
        rest = data[kept].tobytes()
        ends = np.cumsum(np.diff(off) - removed)
        texts = [rest[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        last = pa.array([hashlib.sha256(x).hexdigest() for x in texts]) if digests else pa.array(texts, pa.binary())
        return pa.table({"id": table.column("id"), "n_bytes": pa.array(np.diff(off)), "n_removed": pa.array(removed), "n_spans": pa.array(np.bincount(doc, minlength=len(off) - 1)), "kept": last})

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept " + ("string" if digests else "binary")
    out = B.with_answers(docs, spans, apply, schema).withColumnsRenamed({"id": id_col, **({"kept": "kept_sha256"} if digests else {})})
    return out.withColumn(id_col, F.when(F.col(id_col) > -(1 << 63), F.col(id_col)))
