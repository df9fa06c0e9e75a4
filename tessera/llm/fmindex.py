"""Removal of word sequences that occur more than once, by compressed FM-indexes.

The corpus is indexed in shards by content: a shard holds the passages (see `passages`) whose
anchors fall into its range, each distinct passage once with its number of occurrences, so that
all occurrences of a window are in one shard. A shard's index is the wavelet matrix of the
Burrows-Wheeler transform of its passages. Passages are then streamed through backward search, word
by word from their end; from their matching statistics follow the intervals of `window` words or more
that repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm import blocks as B
from tessera.llm import passages as P
from tessera.llm import text as T

GRAM = 16


class WaveletMatrix:
    """Rank of symbols in a sequence, in one bit a symbol and level plus a directory."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels, self.zeros = [], []
        seq = symbols.astype(np.int64)
        n = len(seq)
        self.depth = max(1, int(n_symbols - 1).bit_length())
        for b in range(self.depth - 1, -1, -1):
            bit = (seq >> b) & 1
            padded = np.zeros((n // 64 + 1) * 64, np.uint8)
            padded[:n] = bit
            words = np.packbits(padded, bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]]).astype(np.int32)
            self.levels.append((words, before))
            self.zeros.append(n - int(bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        self.begin = self.descend(np.zeros(n_symbols, np.int64), np.arange(n_symbols))

    def descend(self, i: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Place on the last level of the symbol's occurrences before i."""
        for (words, before), zeros, b in zip(self.levels, self.zeros, range(self.depth - 1, -1, -1)):
            at = i >> 6
            mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[at] + np.bitwise_count(words[at] & mask)
            i = np.where((symbol >> b) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.descend(i, symbol) - self.begin[symbol]


class FMIndex:
    """Backward search over sequences of symbols 1, 2, ...; 0 stands between sequences.

    `weight` gives the number of occurrences that each position stands for. Suffixes are ordered
    by their first `reach` symbols at least, which is enough for patterns of that length.
    """

    def __init__(self, text: np.ndarray, weight: np.ndarray, n_symbols: int, reach: int):
        self.text = text.astype(np.int32)
        n = len(text)
        rank, span = text.astype(np.int64), 1
        while span < reach:
            ahead = np.zeros(n, np.int64)
            ahead[:-span] = rank[span:] + 1
            _, rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)
            span *= 2
        suffixes = np.argsort(rank, kind="stable")
        self.total = np.concatenate([[0], np.cumsum(weight[suffixes])])
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])[:-1]
        self.matrix = WaveletMatrix(text[suffixes - 1], n_symbols)  # text[-1] is a separator

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the pattern with a symbol put before it."""
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        return self.less[symbol] + both[: len(lo)], self.less[symbol] + both[len(lo) :]

    def count(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return self.total[hi] - self.total[lo]

    def matching_statistics(self, end: np.ndarray, stop: np.ndarray, least: int = 2) -> np.ndarray:
        """The leftmost start, at `stop` or after, of a match that ends before each `end` and
        occurs `least` times; `end` itself where not even its last symbol does."""
        out, live = end.copy(), np.flatnonzero(end > stop)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), len(self.text), np.int64)
        while len(live):
            symbol = self.text[out[live] - 1].astype(np.int64)
            lo, hi = self.extend(lo, hi, symbol)
            keep = np.flatnonzero((symbol > 0) & (self.count(lo, hi) >= least))  # no match holds a separator
            live, lo, hi = live[keep], lo[keep], hi[keep]
            out[live] -= 1
            go = np.flatnonzero(out[live] > stop[live])
            live, lo, hi = live[go], lo[go], hi[go]
        return out


def repeated_intervals(index: FMIndex, begin: np.ndarray, end: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For sequences [begin, end) of the index's text, whose windows all share a word, the union of
    their repeated windows; an empty interval where none repeats."""
    lo, hi = end.copy(), end.copy()
    todo, right = np.arange(len(begin)), end.copy()
    while len(todo):  # the last repeated window
        start = index.matching_statistics(right[todo], begin[todo])
        hit = right[todo] - start >= window
        lo[todo[hit]], hi[todo[hit]] = start[hit], right[todo[hit]]
        right[todo] -= 1
        todo = todo[~hit & (right[todo] - begin[todo] >= window)]
    none = lo == end
    hi[none] = lo[none]
    todo = np.flatnonzero(~none & (lo > begin))
    left = lo - 1
    while len(todo):  # repeated windows that begin further left
        start = index.matching_statistics(left[todo] + window, begin[todo])
        hit = start <= left[todo]
        lo[todo[hit]] = start[hit]
        left[todo] = np.where(hit, start, left[todo]) - 1
        todo = todo[left[todo] >= begin[todo]]
    return lo, hi


def _ship(window: int):
    def ship(units: P.Units, a: P.Anchors, ids: np.ndarray, rank: np.ndarray) -> bytes:
        # an anchor's passage as its words joined by one space, and where the anchor stands in it
        i, j = a.lo, a.hi + window
        n = j - i
        member = T.expand(i, n)
        length = units.ends[member] - units.starts[member]
        at = np.cumsum(length + 1) - length - 1
        joined = np.full(int(at[-1] + length[-1] + 1), 0x20, np.uint8)
        joined[T.expand(at, length)] = units.data[T.expand(units.starts[member], length)]
        cut = at[np.cumsum(n) - n].tolist()
        raw = joined.tobytes()
        texts = [raw[x : y - 1] for x, y in zip(cut, [*cut[1:], len(raw)])]
        number: dict[bytes, int] = {}
        entry = np.array([number.setdefault(t, len(number)) for t in texts])
        order = np.argsort(entry, kind="stable")
        entry, doc, pos = entry[order], a.doc[order], a.at[order]
        first = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]]))
        blob = b"\n".join(number)
        return B.join_parts(
            len(blob).to_bytes(8, "little") + pa.compress(blob, "zstd", asbytes=True),
            B.pack((a.at - a.lo)[order[first]].astype(np.int32)),
            B.pack(np.diff(np.append(first, len(entry))).astype(np.int32)),
            B.pack(doc.astype(np.int32)),
            B.pack((pos - units.off[doc]).astype(np.int64)),
        )

    return ship


def _resolve(window: int):
    def resolve(blobs: list[bytes]) -> list[tuple]:
        number: dict[bytes, int] = {}
        passage, parts = [], []
        for blob in blobs:
            texts, *rest = B.split_parts(blob)
            texts = pa.decompress(texts[8:], int.from_bytes(texts[:8], "little"), "zstd", asbytes=True)
            passage.append(np.array([number.setdefault(t, len(number)) for t in texts.split(b"\n")]))
            parts.append([B.unpack(x) for x in rest])
        weight = np.zeros(len(number), np.int64)
        for p, (_, counts, _, _) in zip(passage, parts):
            np.add.at(weight, p, counts)
        data = np.frombuffer(b"\n".join([*number, b""]), np.uint8)
        off = np.cumsum([0, *(len(t) + 1 for t in number)])
        starts, ends, first = T.words(data, off)
        codes = T.span_hash(data, starts, ends)
        n_words = np.diff(first)
        _, symbol, seen = np.unique(codes, return_inverse=True, return_counts=True)
        total = np.bincount(symbol, weights=np.repeat(weight, n_words))
        # words that occur once can't be part of a repeat: each gets the separator's symbol
        alive = np.cumsum(total > 1) * (total > 1)
        n = len(number)
        text = np.zeros(len(codes) + n, np.int64)
        begin = first[:-1] + np.arange(n)
        text[T.expand(begin, n_words)] = alive[symbol]
        owner = np.repeat(np.arange(n), n_words + 1)
        index = FMIndex(text, weight[owner], int(alive.max(initial=0)) + 1, int(n_words.max(initial=1)))
        lo, hi = repeated_intervals(index, begin, begin + n_words, window)
        lo, hi = lo - begin, hi - begin
        out = []
        for p, (shift, counts, doc, pos) in zip(passage, parts):
            own = np.repeat(p, counts)
            base = pos - np.repeat(shift, counts)
            keep = hi[own] > lo[own]
            out.append((doc[keep], (base + lo[own])[keep], (base + hi[own])[keep]))
        return out

    return resolve


def _spans(docs: DataFrame, n_blocks: int, window: int, gram: int, hot: int, fan: int) -> DataFrame:
    return P.removed_spans(docs, n_blocks, P.as_words, min(gram, window), window, _ship(window), _resolve(window), False, hot, fan)


def remove_repeats(df: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, gram: int = GRAM, hot: int = P.HOT, block_bytes: int = B.BLOCK_BYTES, fan: int = B.FAN) -> DataFrame:
    """Removes each word that a sequence of `window` words covers which also starts anywhere else,
    in the same text or another. Sequences are judged on the input and never cross texts.

    Returns (id, n_words, n_removed, kept) with kept the remaining words joined by one space, or
    with `digests` kept_sha256 in its place. One row for each row of `df`; rows of equal text and id
    are texts of their own. A null text has no words; a null id stays null. Other columns are left
    out.
    """
    n_blocks = B.block_count(df, text_col, block_bytes)
    docs = B.deal(P.long_ids(df.select(id_col, text_col), id_col), id_col, text_col, n_blocks)

    def apply(table: pa.Table, replies: list[bytes]) -> pa.Table:
        units = P.as_words(table)
        doc, lo, hi = P.spans_of(replies)
        kept = np.ones(len(units.codes), bool)
        kept[T.expand(units.off[doc] + lo, hi - lo)] = False
        n_words = np.diff(units.off)
        removed = np.bincount(doc, weights=hi - lo, minlength=len(n_words)).astype(np.int64)
        length = (units.ends - units.starts)[kept]
        at = np.cumsum(length + 1) - length - 1
        joined = np.full(int((length + 1).sum()), 0x20, np.uint8)
        joined[T.expand(at, length)] = units.data[T.expand(units.starts[kept], length)]
        raw, cut = joined.tobytes(), np.append(at, len(joined))[np.cumsum(np.append(0, n_words - removed))].tolist()
        texts = [raw[x : max(x, y - 1)] for x, y in zip(cut, cut[1:])]
        last = pa.array([hashlib.sha256(x).hexdigest() for x in texts]) if digests else pa.array([x.decode() for x in texts])
        return pa.table({"id": table.column("id"), "n_words": pa.array(n_words), "n_removed": pa.array(removed), "kept": last})

    out = B.with_answers(docs, _spans(docs, n_blocks, window, gram, hot, fan), apply, "id long, n_words long, n_removed long, kept string")
    out = out.withColumnsRenamed({"id": id_col, **({"kept": "kept_sha256"} if digests else {})})
    return out.withColumn(id_col, F.when(F.col(id_col) > -(1 << 63), F.col(id_col)))


def cut_bytes(units: P.Units, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes [from, to) of each removed run of words: of the white space on its two sides, the
    one with more line breaks stays (the one before, if both have as many)."""
    first, last = units.off[doc], units.off[doc + 1]
    a, b = first + lo, first + hi
    lines = np.concatenate([[0], np.cumsum(units.data == 0x0A)])
    start, end = units.starts[a], units.ends[b - 1]
    before = np.where(a > first, units.ends[np.maximum(a - 1, 0)], off[doc])
    after = np.where(b < last, units.starts[np.minimum(b, len(units.starts) - 1)], off[doc + 1])
    keep_after = (a > first) & ((b == last) | (lines[after] - lines[end] > lines[start] - lines[before]))
    whole = (a == first) & (b == last)
    return np.where(whole, off[doc], np.where(keep_after, before, start)), np.where(whole, off[doc + 1], np.where(keep_after, end, after))


def cut_repeats(df: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, hot: int = P.HOT, block_bytes: int = B.BLOCK_BYTES, fan: int = B.FAN, drop_emptied: bool = False) -> DataFrame:
    """The rows and columns of `df`, with the words that `remove_repeats` removes cut out of the
    texts. What is left keeps its bytes, line breaks and indentation included. A text of which
    nothing is left becomes an empty one, or goes with `drop_emptied`; others, null and empty ones too,
    stay as they are. Rows of repeated ids stay apart; a null id is the least.
    """
    n_blocks = B.block_count(df, text_col, block_bytes)
    long = P.long_ids(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), B.folded(df, text_col).alias("row")), "id")
    docs = B.deal(long.select("id", "text"), "id", "text", n_blocks)
    whole = B.deal(long, "id", "text", n_blocks, F.col("row"), F.col("text").isNull().alias("null"))

    def apply(table: pa.Table, replies: list[bytes]) -> pa.Table:
        units = P.as_words(table)
        _, off = T.text_bytes(table.column("text"))
        doc, lo, hi = P.spans_of(replies)
        kept = np.ones(len(units.data), bool)
        if len(doc):
            a, b = cut_bytes(units, doc, lo, hi, off)
            kept[T.expand(a, b - a)] = False
        raw, cut = units.data[kept].tobytes(), np.concatenate([[0], np.cumsum(kept)])[off].tolist()
        null = table.column("null").to_pylist()
        removed = np.bincount(doc, weights=hi - lo, minlength=len(off) - 1)
        gone = drop_emptied & (removed > 0) & (removed == np.diff(units.off))
        left = pa.table({"row": table.column("row"), "text": pa.array([None if x else raw[i:j].decode() for x, i, j in zip(null, cut, cut[1:])], pa.string())})
        return left.filter(pa.array(~gone)) if gone.any() else left

    schema = StructType([StructField("row", whole.schema["row"].dataType), StructField("text", StringType())])
    out = B.with_answers(whole, _spans(docs, n_blocks, window, gram, hot, fan), apply, schema)
    return B.unfolded(out, df.columns, "row", **{text_col: F.col("text")})

