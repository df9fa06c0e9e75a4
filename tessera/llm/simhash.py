"""Near-duplicates: SimHash by multi-index hashing, by Hamming distance or by exact Jaccard similarity.

A fingerprint is cut into segments. Two fingerprints that differ in r bits differ in few bits of
some segment (pigeonhole), so each looks into a small Hamming ball around every segment's value,
fetches the table's matches there, and verifies the whole distance.

Values that differ in one bit agree in one half of the segment, so while the table is small
enough, rows are dealt by halves: a row meets its whole ball in one bucket, and no probe is
shipped. For larger tables every value of the ball is a probe.
A bucket gives back a spanning forest of its links, never all pairs; an overfull bucket is cut
into chunks, and every pair of chunks is a bucket of its own.

Texts of a Jaccard similarity differ in too many bits for the pigeonhole principle; there as many
segments are taken as the wanted recall needs, and what fingerprints link is measured exactly.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.blocks import release
from tessera.llm.graph import checkpoint, components, join_aggregate

#: For each byte, its bits as eight byte lanes of a word (bit 0 in the lowest lane).
_LANES = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], T.U64)
#: The part of pairs of just the wanted similarity that share a segment, whatever the table's size.
RECALL = 0.9999
#: Bits of a segment of similar texts, at most; rows of a bucket that its width aims at.
WIDEST, FILL = 24, 2048
#: Words of a fingerprint that are compared, and by how many standard deviations similar texts may differ in more bits than on average.
COMPARED, DEVIATIONS = 4, 5
#: How many shingle hashes of one loose component a task takes at once.
SET_HASHES = 2_000_000
BUCKET = 20_000
#: How many rows of whole buckets a task takes at once.
ROWS_AT_ONCE = 500_000
#: About how many rows of buckets of similar texts a task is dealt.
ROWS_A_TASK = 200_000


def shingle_hashes(column, k: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each text's k-word shingles, and offsets by text.

    Words are lower-cased (A-Z) and joined by one space; a text of fewer words is one shingle,
    and one without words has none.
    """
    data, off = T.text_bytes(column)
    hashes, counts = [], np.zeros(len(off) - 1, np.int64)
    for i, j in T.doc_slices(off):
        part = T.lower(data[off[i] : off[j]])
        starts, ends, first = T.words(part, off[i : j + 1] - off[i])
        n_words = np.diff(first)
        counts[i:j] = np.where(n_words == 0, 0, np.maximum(n_words - k + 1, 1))
        # words joined by one space, so that a shingle is a slice
        lengths = ends - starts
        at = np.concatenate([[0], np.cumsum(lengths + 1)])
        joined = np.full(int(at[-1]), 0x20, np.uint8)
        joined[T.expand(at[:-1], lengths)] = part[T.expand(starts, lengths)]
        a = T.expand(first[:-1], counts[i:j])
        b = np.minimum(a + k, np.repeat(first[1:], counts[i:j]))
        raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
        hashes.append(np.array([digest(raw[x:y], 42) for x, y in zip(at[a].tolist(), (at[b] - 1).tolist())], T.U64))
    return (np.concatenate(hashes) if hashes else np.zeros(0, T.U64)), np.concatenate([[0], np.cumsum(counts)])


def majority(hashes: np.ndarray, off: np.ndarray, n_words: int = 1) -> np.ndarray:
    """Texts x n_words 64-bit words: a bit is 1 if set in over half of the text's hashes.

    Words after the first take the bits of the hashes re-mixed with the word's number.
    """
    counts = np.diff(off)
    out = np.zeros((len(counts), n_words), T.U64)
    if not len(hashes):
        return out
    # blocks of at most 255 hashes of one text, so that a byte lane can't overflow
    n_blocks = -(-counts // 255)
    block_text = np.repeat(np.arange(len(counts)), n_blocks)
    inside = np.arange(len(block_text)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    block_start = off[:-1][block_text] + inside * 255
    text_block = (np.cumsum(n_blocks) - n_blocks)[counts > 0]
    for w in range(n_words):
        h = hashes if w == 0 else T.mix(hashes + T.U64((w * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        octets = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            lanes = np.add.reduceat(_LANES[octets[:, byte]], block_start)
            per_block = lanes.view(np.uint8).reshape(-1, 8)
            total = np.add.reduceat(per_block, text_block, axis=0, dtype=np.int64)
            bits = total * 2 > counts[counts > 0][:, None]
            value = (bits.astype(T.U64) << np.arange(8, dtype=T.U64)).sum(1, dtype=T.U64)
            out[counts > 0, w] |= value << T.U64(8 * byte)
    return out


def fingerprints(df: DataFrame, k: int, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): each whole text's fingerprint, big-endian 64-bit words. A null text has no words and gets zero."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                fp = majority(*shingle_hashes(part.column("text"), k), bits // 64)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([x.tobytes() for x in fp.astype(">u8")], pa.binary())], ["id", "fp"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp binary").withColumnRenamed("id", id_col)


def plan(n: int, bits: int, radius: int, bucket: int = BUCKET) -> list[tuple[int, int, int, int]]:
    """Tables for n fingerprints: (first bit, width, ball radius, how rows are dealt).

    A segment is wide enough that a value is rarely shared by chance. The balls' radii sum to
    radius - segments + 1, which by the pigeonhole principle misses no link. Rows are dealt by the
    segment's low or high half (0, 1) where the ball has one bit and such buckets are small; by its
    value (2) where the ball has none; and else by every value of a ball of half the radius (3), in
    which any two rows within the whole radius meet.
    """
    want = min(32, max(8, math.ceil(math.log2(max(n, 2))) + 1))
    m = min(max(1, bits // want), radius + 1)
    spare = radius - m + 1
    edges = [bits * i // m for i in range(m + 1)]
    tables = []
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        ball = spare // m + (i < spare % m)
        halves = ball == 1 and n >> ((b - a) // 2) <= bucket
        tables += [(a, b - a, ball, how) for how in ((0, 1) if halves else (3,) if ball else (2,))]
    return tables


def _ball(width: int, radius: int) -> np.ndarray:
    """The masks of up to `radius` of `width` bits."""
    return np.array([sum(1 << x for x in some) for r in range(radius + 1) for some in itertools.combinations(range(width), r)], T.U64)


def _segment(fp: np.ndarray, first: int, width: int) -> np.ndarray:
    """Bits [first, first + width) of fingerprints (rows of 64-bit words), at most 64 of them."""
    word, shift = first // 64, first % 64
    value = fp[:, word] >> T.U64(shift)
    if shift + width > 64:
        value = value | (fp[:, word + 1] << T.U64(64 - shift))
    return value & T.U64((1 << width) - 1)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class Forest:
    """Union-find over positions; keeps one link for each union."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        p = self.parent
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def join(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
            self.links.append((a, b))


def _bucket_links(fp: np.ndarray, group: np.ndarray, value: np.ndarray, masks: np.ndarray, width: int, radius: int, forest: Forest, at: np.ndarray) -> None:
    """Links among rows of equal group whose value (of `width` bits) differs by one of `masks` at most."""
    key = (group << width) | value
    order = np.argsort(key, kind="stable")
    fp, key, at = fp[order], key[order], at[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size, runs = np.diff(np.append(first, len(key))), key[first]
    left, right = [np.flatnonzero(size > 1)], [np.flatnonzero(size > 1)]
    for m in masks.tolist():
        other = runs ^ m
        place = np.minimum(np.searchsorted(runs, other), len(runs) - 1)
        hit = np.flatnonzero((runs[place] == other) & (other > runs))
        left.append(hit)
        right.append(place[hit])
    left, right = np.concatenate(left), np.concatenate(right)
    n = size[left] * size[right]
    small = n <= 1024
    few = np.flatnonzero(small)
    for i in range(0, len(few), 4096):
        r, s = left[few[i : i + 4096]], right[few[i : i + 4096]]
        k = size[r] * size[s]
        inner = T.expand(np.zeros(len(r), np.int64), k)
        x = np.repeat(first[r], k) + inner // np.repeat(size[s], k)
        y = np.repeat(first[s], k) + inner % np.repeat(size[s], k)
        near = np.flatnonzero(x < y)
        near = near[_distance(fp[x[near]], fp[y[near]]) <= radius]
        for u, v in zip(at[x[near]].tolist(), at[y[near]].tolist()):
            forest.join(u, v)
    for r, s in zip(left[~small].tolist(), right[~small].tolist()):
        _spread(fp, at, np.unique(np.concatenate([np.arange(first[r], first[r] + size[r]), np.arange(first[s], first[s] + size[s])])), radius, forest)


def _spread(fp: np.ndarray, at: np.ndarray, rows: np.ndarray, radius: int, forest: Forest) -> None:
    """Breadth-first search: each row is compared with those that no search has reached yet."""
    left = rows
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = _distance(fp[left], fp[x]) <= radius
            for y in left[near].tolist():
                forest.join(int(at[x]), int(at[y]))
                frontier.append(y)
            left = left[~near]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole groups of equal keys, of about `rows` rows or one group each."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        same = np.ones(n, bool)
        for k in keys:
            column = table.column(k).to_numpy()
            same &= column == column[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
            held, n = table.slice(cut).to_batches(), n - cut
    if n:
        yield pa.Table.from_batches(held)


def links(fps: DataFrame, bits: int, radius: int, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links whose components are those of all pairs of `fps.fp` within `radius` bits.

    `fps` has distinct fingerprints. A bucket of over `bucket` rows is cut into chunks, and each
    pair of chunks is searched apart.
    """
    tables = plan(fps.count(), bits, radius, bucket)
    n_bytes = bits // 8

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("fp").to_pylist()), ">u8").reshape(-1, bits // 64).astype(T.U64)
            for t, (first, width, ball, how) in enumerate(tables):
                value = _segment(raw, first, width)
                if how < 2:
                    low = width // 2
                    value = value & T.U64((1 << low) - 1) if how == 0 else value >> T.U64(low)
                for mask in _ball(width, (ball + 1) // 2) if how == 3 else (T.U64(0),):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(raw), t, np.int32)), pa.array((value ^ mask).astype(np.int64)), batch.column("fp")], ["t", "key", "fp"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["t", "key", "chunk"], ROWS_AT_ONCE):
            yield found_in(table)

    def found_in(table: pa.Table) -> pa.RecordBatch:
        raw = b"".join(table.column("fp").to_pylist())
        fp = np.frombuffer(raw, ">u8").reshape(-1, bits // 64).astype(T.U64)
        t, key, chunk = (table.column(c).to_numpy() for c in ("t", "key", "chunk"))
        _, at, same = np.unique(fp, axis=0, return_index=True, return_inverse=True)
        same = same.ravel()
        forest = Forest(len(at))
        for i, (first, width, _, how) in enumerate(tables):
            own = np.flatnonzero(t == i)
            if not len(own):
                continue
            span = range(width // 2, width) if how == 0 else range(width // 2) if how == 1 else ()
            value = _segment(fp[own], first, width).astype(np.int64) if how < 3 else np.zeros(len(own), np.int64)
            _, group = np.unique(np.stack([key[own], chunk[own]]), axis=1, return_inverse=True)
            _bucket_links(fp[own], group.ravel(), value, np.array([1 << x for x in span], np.int64), width if how < 3 else 0, radius, forest, same[own])
        pairs = np.array(forest.links, np.int64).reshape(-1, 2)
        cut = lambda x: raw[at[x] * n_bytes : (at[x] + 1) * n_bytes]
        return pa.RecordBatch.from_arrays([pa.array([cut(a) for a in pairs[:, 0]], pa.binary()), pa.array([cut(b) for b in pairs[:, 1]], pa.binary())], ["u", "v"])

    placed = fps.mapInArrow(place, "t int, key long, fp binary")
    sizes = placed.groupBy("t", "key").count().where(F.col("count") > bucket)
    sizes = sizes.select("t", "key", F.ceil(F.col("count") / bucket).cast("int").alias("chunks"))
    if sizes.isEmpty():
        dealt = placed.withColumn("chunk", F.lit(0).cast("long"))
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
        hot = placed.join(sizes, ["t", "key"]).withColumn("own", own).select("t", "key", "fp", F.explode(_chunk_pairs()).alias("chunk"))
        dealt = placed.join(sizes, ["t", "key"], "left_anti").withColumn("chunk", F.lit(0).cast("long")).unionByName(hot)
    return dealt.select("t", "key", "chunk", "fp").repartition("t", "key", "chunk").sortWithinPartitions("t", "key", "chunk").mapInArrow(search, "u binary, v binary").distinct()


def near_duplicates(df: DataFrame, k: int = 5, radius: int = 4, bits: int = 64, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """(id, fp, component_id): texts linked by fingerprints at most `radius` bits apart.

    component_id is the least id that links lead to. Texts without words have fingerprint zero
    and are linked like any other. Ids may repeat; null ids are left out of the least. Equal
    fingerprints are one node, so copies cost nothing more. Only `id_col` and `text_col` are read.
    All links are found.
    """
    prints = checkpoint(fingerprints(df, k, bits, id_col, text_col))
    nodes = checkpoint(prints.groupBy("fp").agg(F.min(id_col).alias("first")))
    return _by_component(prints, nodes, components(links(nodes.select("fp"), bits, radius, bucket)), id_col)


def _by_component(prints: DataFrame, nodes: DataFrame, roots: DataFrame, id_col: str) -> DataFrame:
    """(id, fp, component_id) of all `prints`, given each fingerprint's first id and the root of those with links."""
    linked = nodes.join(roots, nodes["fp"] == roots["node"]).select("fp", "first", "root")
    least = linked.groupBy("root").agg(F.min("first").alias("least"))
    joined = join_aggregate(linked, least, "root").select("fp", F.col("least").alias("component_id"))
    alone = nodes.join(joined.select("fp"), "fp", "left_anti").select("fp", F.col("first").alias("component_id"))
    return prints.join(joined.unionByName(alone), "fp").select(id_col, "fp", "component_id")


def differing(similarity: float) -> float:
    """The part of SimHash bits in which sets of one size and of a Jaccard similarity differ on average: their angle by pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def segments(width: int, similarity: float) -> int:
    """How many segments of `width` bits make one of them equal with a probability of RECALL."""
    return math.ceil(math.log(1 - RECALL) / math.log1p(-((1 - differing(similarity)) ** width)))


def recall(similarity: float, width: int = WIDEST, aim: float = 0.8) -> float:
    """The probability that sets of a Jaccard similarity share a segment, where these aim at pairs of `aim`."""
    return 1 - (1 - (1 - differing(similarity)) ** width) ** segments(width, aim)


def width_for(n: int, fill: int = FILL) -> int:
    """Bits of a segment for n texts, so that texts that have nothing in common fill a bucket with `fill` or fewer."""
    return min(WIDEST, max(4, math.ceil(math.log2(max(n, 1) / fill))))


def radius_for(similarity: float, bits: int = 64 * COMPARED) -> int:
    """Of `bits`, how many sets of a Jaccard similarity may differ in."""
    p = differing(similarity)
    return math.ceil(bits * p + DEVIATIONS * math.sqrt(bits * p * (1 - p)))


def bands(hashes: np.ndarray, off: np.ndarray, width: int = WIDEST, similarity: float = 0.8, prints: np.ndarray | None = None) -> np.ndarray:
    """Texts x segments: a key for each segment of each text's fingerprint (`prints`, if made already)."""
    n = segments(width, similarity)
    if prints is None:
        prints = majority(hashes, off, -(-n * width // 64))
    out = np.empty((len(prints), n), T.U64)
    for i in range(n):
        out[:, i] = T.mix((_segment(prints, i * width, width) | T.U64((i + 1) << 32)) * T.U64(0x9E3779B97F4A7C15))
    return out


def near_prints(fp: np.ndarray, radius: int, first: int) -> np.ndarray:
    """Links (rows of two positions) whose components are those of all pairs of rows within `radius` bits,
    `first` of them at most in the first word.

    Strips of rows are compared with all later rows. In each round, every component hooks onto one of
    lesser number, so that a large group of near copies gives one link a row.
    """
    n = len(fp)
    label, found, start = np.arange(n), [], 0
    strip = max(1, 2_000_000 // max(n, 1))
    for start in range(0, n, strip):
        i, j = np.nonzero(np.bitwise_count(fp[start : start + strip, None, 0] ^ fp[None, start:, 0]) <= first)
        i, j = i + start, j + start
        some = (i < j) & (label[i] != label[j])
        i, j = i[some], j[some]
        for at in range(0, len(i), 1_000_000):
            x, y = i[at : at + 1_000_000], j[at : at + 1_000_000]
            near = _distance(fp[x], fp[y]) <= radius
            x, y = x[near], y[near]
            while len(x):
                a, b = label[x], label[y]
                apart = a != b
                x, y, a, b = x[apart], y[apart], a[apart], b[apart]
                high, pick = np.unique(np.maximum(a, b), return_index=True)
                found.append(np.stack([x[pick], y[pick]], 1))
                parent = np.arange(n)
                parent[high] = np.minimum(a, b)[pick]
                while not np.array_equal(parent, parent[parent]):
                    parent = parent[parent]
                label = parent[label]
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def similar_prints(nodes: DataFrame, similarity: float, n_rows: int, bucket: int = BUCKET) -> DataFrame:
    """(u, v): links of `nodes` (node, prints, keys) that share a key and whose prints are within radius_for(similarity).

    Rows of one key meet in a bucket; one of over `bucket` rows is cut into chunks, and each pair of chunks meets apart.
    """
    radius, first = radius_for(similarity), radius_for(similarity, 64)
    words = [f"p{i}" for i in range(COMPARED)]
    placed = nodes.select("node", *[F.col("prints")[i].alias(w) for i, w in enumerate(words)], F.explode("keys").alias("key"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "chunk"], ROWS_AT_ONCE):
            key, chunk, node = (table.column(c).to_numpy() for c in ("key", "chunk", "node"))
            fp = np.stack([table.column(w).to_numpy() for w in words], 1).view(T.U64)
            edges = np.flatnonzero((key[1:] != key[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            pairs = [near_prints(fp[a:b], radius, first) + a for a, b in itertools.pairwise([0, *edges.tolist(), len(key)]) if b - a > 1]
            pairs = np.unique(np.sort(node[np.concatenate(pairs)], axis=1), axis=0) if pairs else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["u", "v"])

    sizes = checkpoint(placed.groupBy("key").count().where(F.col("count") > bucket).select("key", F.ceil(F.col("count") / bucket).cast("int").alias("chunks")))
    if sizes.isEmpty():
        dealt = placed.withColumn("chunk", F.lit(0).cast("long"))
    else:
        hot = placed.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks"))).select(*placed.columns, F.explode(_chunk_pairs()).alias("chunk"))
        dealt = placed.join(sizes, "key", "left_anti").withColumn("chunk", F.lit(0).cast("long")).unionByName(hot)
    return dealt.repartition(max(8, min(8192, n_rows // ROWS_A_TASK)), "key", "chunk").sortWithinPartitions("key", "chunk").mapInArrow(search, "u long, v long").distinct()


def _chunk_pairs() -> Column:
    """The numbers of the pairs of `chunks` chunks in which the chunk `own` takes part."""
    return F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.least(c.cast("long"), F.col("own")) * F.col("chunks") + F.greatest(c.cast("long"), F.col("own")))


def _sets(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in order, and offsets by text."""
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    order = np.lexsort((hashes, text))
    h, text = hashes[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(off) - 1))])


def _digests(hashes: np.ndarray, off: np.ndarray) -> list[bytes]:
    return [xxhash.xxh3_128_digest(hashes[x:y].tobytes()) for x, y in itertools.pairwise(off.tolist())]


def similar_links(hashes: np.ndarray, off: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links whose components are those of all pairs of sets with a Jaccard similarity of `similarity` or more.

    Breadth-first: a set is compared with those that no search has reached. One that is similar
    enough holds one of any |x| - ceil(similarity |x|) + 1 elements of x; the rarest are looked up.
    """
    n, sizes = len(off) - 1, np.diff(off)
    _, codes, n_holders = np.unique(hashes, return_inverse=True, return_counts=True)
    holder = np.repeat(np.arange(n), sizes)
    codes = codes[np.lexsort((codes, n_holders[codes], holder))]  # each set's rarest first
    left, mark, found = np.ones(n, bool), np.zeros(len(n_holders), bool), []
    n_left, n_indexed = n, 2 * n + 1
    index = holders = np.zeros(0, np.int64)
    for start in range(n):
        if not left[start]:
            continue
        left[start], n_left, frontier = False, n_left - 1, [start]
        while frontier and n_left:
            x = frontier.pop()
            if n_left * 2 < n_indexed:
                rows = np.flatnonzero(left[holder])
                rows = rows[np.argsort(codes[rows], kind="stable")]
                index, holders, n_indexed = codes[rows], holder[rows], n_left
            own = codes[off[x] : off[x + 1]]
            probe = own[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]
            lo, hi = np.searchsorted(index, probe), np.searchsorted(index, probe, side="right")
            y = np.unique(holders[T.expand(lo, hi - lo)])
            y = y[left[y] & (np.minimum(sizes[y], len(own)) >= similarity * np.maximum(sizes[y], len(own)) - 1e-9)]
            if not len(y):
                continue
            mark[own] = True
            shared = np.add.reduceat(mark[codes[T.expand(off[y], sizes[y])]], np.cumsum(sizes[y]) - sizes[y], dtype=np.int64)
            mark[own] = False
            y = y[shared / (sizes[y] + len(own) - shared) >= similarity]
            left[y], n_left = False, n_left - len(y)
            found += [(start, z) for z in y.tolist()]
            frontier += y.tolist()
    return found


def similar_groups(df: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text", limit: int = SET_HASHES, fill: int = FILL, bucket: int = BUCKET) -> DataFrame:
    """(id, fp, component_id) like `near_duplicates`, linked by a Jaccard similarity of sets of k-word shingles.

    Each set gets a SimHash fingerprint. Those that are equal in one of many segments and close in whole
    are joined loosely; each loose component's sets meet in one task, which measures them exactly (on
    64-bit shingle hashes). Components of over `limit` hashes are cut into chunks, and each pair of chunks
    meets apart. `fp` is a digest of the set; equal sets are one node. Texts without words have the empty
    set and are one group. Segments get wider with the table, so that buckets don't grow, and more in
    number, so that a link at `similarity` is missed with 1 - RECALL at any size (small sets differ in more
    bits than `differing` says: 4 of 5 shingles in 0.19 instead of 0.15 of them).
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", F.xxhash64("id", "text"))
    n_docs = docs.count()
    width = width_for(n_docs, fill)
    n_segments = segments(width, similarity)
    n_words = max(COMPARED, -(-n_segments * width // 64))
    least = max(1, math.ceil(similarity / (1 - similarity) - 1e-9)) if similarity < 1 else math.inf  # smaller sets are similar to equal ones only

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                hashes, off = _sets(*shingle_hashes(part.column("text"), k))
                fp = _digests(hashes, off)
                prints = majority(hashes, off, n_words)
                lists = [pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), np.ascontiguousarray(x).ravel().view(np.int64)) for x in (prints[:, :COMPARED], bands(hashes, off, width, similarity, prints))]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("row"), pa.array(fp, pa.binary()), pa.array(np.diff(off)), *lists], ["id", "row", "fp", "n", "prints", "keys"])
            release()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                here = pa.Table.from_batches([batch])
                held = here if held is None else pa.concat_tables([held, here])
            if held is None:
                return
            parts = held.column("part").to_numpy()
            cut = held.num_rows if batch is None else int(np.searchsorted(parts, parts[-1]))
            if cut == 0 or (batch is not None and int(held.column("n").to_numpy()[:cut].sum()) < limit):
                continue
            now, held = held.slice(0, cut), held.slice(cut)
            hashes, off = _sets(*shingle_hashes(now.column("text"), k))
            fp, pairs = _digests(hashes, off), similar_links(hashes, off, similarity)
            del hashes, off, now
            release()
            yield pa.RecordBatch.from_arrays([pa.array([fp[a] for a, _ in pairs], pa.binary()), pa.array([fp[b] for _, b in pairs], pa.binary())], ["u", "v"])

    kind = docs.schema["id"].dataType.simpleString()
    signed = checkpoint(docs.mapInArrow(sign, f"id {kind}, row long, fp binary, n long, prints array<long>, keys array<long>"))
    nodes = signed.groupBy("fp").agg(F.min("id").alias("first"), F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("n", "prints", "keys")])
    nodes = checkpoint(nodes.withColumn("node", F.xxhash64("fp")))
    loose = components(similar_prints(nodes.where(F.col("n") >= least), similarity, n_docs * n_segments, bucket))
    # what a loose component holds, and the pairs of its chunks
    candidates = nodes.select("node", "row", "fp", "n").join(loose, "node")
    weights = candidates.groupBy("root").agg(F.ceil(F.sum("n") / limit).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    candidates = join_aggregate(candidates, weights, "root").withColumn("own", own).select("row", "n", F.transform(_chunk_pairs(), lambda c: F.xxhash64("root", c)).alias("parts"))
    dealt = docs.join(candidates, "row").select("n", "text", F.explode("parts").alias("part"))
    found = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(search, "u binary, v binary").distinct()
    return _by_component(signed.select(F.col("id").alias(id_col), "fp"), nodes.select("fp", "first"), components(found), id_col)


def keep_first(df: DataFrame, groups: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` whose id is their group's least; rows of equal id and text become one.
    Rows without an id stay if their whole group has none."""
    first = checkpoint(groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).groupBy(id_col).agg(F.count(F.lit(1)).alias("__n")))
    kept = df.join(first.select(F.col(id_col).alias("__first")), F.col(id_col).eqNullSafe(F.col("__first")), "left_semi")
    return kept if first.where("__n > 1").isEmpty() else kept.dropDuplicates([id_col, text_col])
