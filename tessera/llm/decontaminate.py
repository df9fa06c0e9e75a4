"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are word sequences. A document that shares a seed (a run of
`seed` words) with an item is tiled with it: the longest matches between words that no tile holds
yet are marked, found by running Karp-Rabin hashes of falling length, down to `seed` words. An
item is leaked if tiles cover enough of it, in whatever order its parts stand.

Seeds of documents meet those of items in a join. A sieve of bits, of bounded size whatever the
benchmark's, first leaves out seeds that no item has; it may let others through, never the reverse.
Equal texts are tiled once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import text as T
from tessera.llm.graph import checkpoint

SEED, COVERAGE = 5, 0.5
#: The sieve has 2^SIEVE bits at most (16 MB), and 2^SPARE for each seed up to that.
SIEVE, SPARE = 27, 14


def word_codes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit code of each word, A-Z lower-cased, and offsets of words by text."""
    data = T.lower(data)
    starts, ends, first = T.words(data, off)
    return T.span_hash(data, starts, ends), first


def _seeds(codes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word runs that lie within one text, and the text of each."""
    grams = T.gram_hash(codes, k)
    counts = np.maximum(np.diff(first) - k + 1, 0)
    return grams[T.expand(first[:-1], counts)], np.repeat(np.arange(len(counts)), counts)


def tile(doc: np.ndarray, item: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: tiles (start in doc, start in item, length), each word in one at most.

    Rounds go from the longest match of free words downwards. A round of length s hashes all
    windows of s free words of both sides (running Karp-Rabin) and marks equal ones, from left to
    right in the document and each at its first free place in the item; the longest s that has any
    is found by bisection. A place once taken is never looked at again, so repeated words cost no more
    than others.
    """
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    length = min(len(doc), len(item))
    while length >= shortest:
        length = _longest(doc, item, free_d, free_i, shortest, length)
        if not length or not _mark(doc, item, free_d, free_i, length, tiles):
            break
    return tiles


def _longest(doc, item, free_d, free_i, low: int, high: int) -> int:
    """The length of the longest match of free words in [low, high], or 0."""

    def any_of(s: int) -> bool:
        return np.isin(_windows(item, free_i, s)[1], _windows(doc, free_d, s)[1]).any()

    if not any_of(low):
        return 0
    while low < high:
        middle = (low + high + 1) // 2
        if any_of(middle):
            low = middle
        else:
            high = middle - 1
    return low


def _windows(codes: np.ndarray, free: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[s:] == taken[:-s]) if len(codes) >= s else np.zeros(0, np.int64)
    return at, T.gram_hash(codes, s)[at] if len(at) else np.zeros(0, T.U64)


def _mark(doc, item, free_d, free_i, s: int, tiles: list) -> bool:
    """Marks the equal windows of s free words, verified word by word; whether there were any."""
    d_at, d_hash = _windows(doc, free_d, s)
    i_at, i_hash = _windows(item, free_i, s)
    hit = np.isin(d_hash, i_hash)
    places: dict[int, list[int]] = {}
    for h, b in zip(i_hash[::-1].tolist(), i_at[::-1].tolist()):
        places.setdefault(h, []).append(b)  # the first place last
    end, n = 0, len(tiles)
    for a, h in zip(d_at[hit].tolist(), d_hash[hit].tolist()):
        if a < end:
            continue
        left = places[h]
        while left and not free_i[left[-1] : left[-1] + s].all():
            left.pop()
        if left and (doc[a : a + s] == item[left[-1] : left[-1] + s]).all():
            b, end = left.pop(), a + s
            free_d[a:end] = free_i[b : b + s] = False
            tiles.append((a, b, s))
    return len(tiles) > n


def _seeds_of(rows: DataFrame, k: int) -> DataFrame:
    """(h, seeds): each text's distinct seeds, as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = T.text_bytes(batch.column("text"))
            for i, j in T.doc_slices(off):
                codes, first = word_codes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                grams, text = _seeds(codes, first, k)
                yield pa.RecordBatch.from_arrays([batch.column("h").slice(i, j - i), _lists(grams, text, j - i)], ["h", "seeds"])

    return rows.select("h", "text").mapInArrow(run, "h struct<a:long,b:int>, seeds array<long>")


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32), values.view(np.int64))


def sieve(seeds: DataFrame) -> np.ndarray:
    """A table of bits, of 2^SIEVE at most: set where a seed of column `seed` has its first bits."""
    bits = int(min(SIEVE, max(16, np.ceil(np.log2(seeds.count() + 1)) + SPARE)))
    at = seeds.select(F.shiftrightunsigned("seed", 64 - bits).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
    found = words.toArrow()  # 2^(SIEVE - 6) rows at most
    out = np.zeros(1 << (bits - 6), T.U64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(T.U64)
    return out


def leaks(df: DataFrame, items: DataFrame, seed: int = SEED, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, covered, n_tiles, longest) for each document and item that it leaks.

    covered is the share of the item's words that tiles hold, at least `coverage`. Items of fewer
    than `seed` words have no seed and never match; nor do null or empty texts. Equal rows give equal
    rows. Every seed and document counts; nothing is sampled. Only the columns named are read.
    """
    hashed = F.struct(F.xxhash64("text").alias("a"), F.hash("text").alias("b")).alias("h")
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    known = items.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("text is not null").select("item", "text", hashed)
    item_texts = known.groupBy("h").agg(F.first("text").alias("item_text"))
    seeds = _seeds_of(item_texts.select("h", F.col("item_text").alias("text")), seed)
    seeds = seeds.select(F.col("h").alias("item_h"), (F.size("seeds") + seed - 1).alias("n_words"), F.explode("seeds").alias("seed"))
    item_seeds = checkpoint(seeds.groupBy("item_h", "n_words", "seed").agg(F.count(F.lit(1)).alias("times")))
    shared = df.sparkSession.sparkContext.broadcast(sieve(item_seeds))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        shift = T.U64(64 - int(len(table)).bit_length() + 1 - 6)
        for batch in batches:
            data, off = T.text_bytes(batch.column("text"))
            for i, j in T.doc_slices(off):
                codes, first = word_codes(data[off[i] : off[j]], off[i : j + 1] - off[i])
                grams, text = _seeds(codes, first, seed)
                at = grams >> shift
                hit = (table[(at >> T.U64(6)).astype(np.int64)] >> (at & T.U64(63))) & T.U64(1) > 0
                if hit.any():
                    own, place = np.unique(text[hit], return_inverse=True)
                    part = batch.take(pa.array(own + i))
                    yield pa.RecordBatch.from_arrays([part.column("id"), part.column("text"), _lists(grams[hit], place, len(own))], ["id", "text", "seeds"])

    hits = checkpoint(rows.mapInArrow(find, f"id {rows.schema['id'].dataType.simpleString()}, text string, seeds array<long>").select("id", "text", "seeds", hashed))
    texts = hits.groupBy("h").agg(F.first("text").alias("text"), F.first("seeds").alias("seeds"))
    # tiles of `seed` words or more that cover enough of an item begin at so many of its seeds at least
    pairs = texts.select("h", F.explode(F.array_distinct("seeds")).alias("seed")).join(item_seeds, "seed").groupBy("h", "item_h", "n_words").agg(F.sum("times").alias("places"))
    pairs = pairs.where(F.col("places") * seed >= coverage * F.col("n_words") - 1e-6).select("h", "item_h")
    cases = texts.select("h", "text").join(pairs, "h").join(item_texts.withColumnRenamed("h", "item_h"), "item_h")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, values = [], []
            both = [word_codes(*T.text_bytes(batch.column(c))) for c in ("text", "item_text")]
            for n in range(batch.num_rows):
                doc, item = (codes[first[n] : first[n + 1]] for codes, first in both)
                tiles = tile(doc, item, seed)
                share = sum(t[2] for t in tiles) / max(len(item), 1)
                if tiles and share >= coverage:
                    keep.append(n)
                    values.append((share, len(tiles), max(t[2] for t in tiles)))
            if keep:
                part = batch.take(pa.array(keep))
                share, n, longest = zip(*values)
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("item_h"), pa.array(share), pa.array(n, pa.int32()), pa.array(longest, pa.int32())], ["h", "item_h", "covered", "n_tiles", "longest"])

    found = cases.select("h", "item_h", "text", "item_text").mapInArrow(measure, "h struct<a:long,b:int>, item_h struct<a:long,b:int>, covered double, n_tiles int, longest int")
    out = hits.select("id", "h").join(found, "h").join(known.select("item", F.col("h").alias("item_h")), "item_h")
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "covered", "n_tiles", "longest")


def judge(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", **options) -> DataFrame:
    """(id, contaminated, n_items, covered, item) for each distinct id: whether any of its rows leaks
    an item, how many, the largest covered share, and the least of the items that have it."""
    found = leaks(df, items, id_col=id_col, text_col=text_col, item_col=item_col, **options)
    worst = found.groupBy(id_col).agg(F.countDistinct(item_col).alias("n_items"), F.max("covered").alias("covered"), F.min(F.struct(-F.col("covered"), F.col(item_col)))[item_col].alias(item_col))
    ids = df.select(id_col).distinct()
    out = ids.join(worst, ids[id_col].eqNullSafe(worst[id_col]), "left").select(ids[id_col], F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("covered", F.lit(0.0)).alias("covered"), worst[item_col])
    return out
