"""Language-model scores by deleted interpolation (Jelinek and Mercer).

A token's probability mixes the maximum-likelihood estimates of its trigram, its bigram, its unigram,
a uniform choice of known tokens and the chance of an unknown one. The weights depend on how often
the context was seen (the two tokens before; where they weren't seen together, the one before;
buckets by powers of two) and are learned by expectation-maximisation on counts held out from those
that the estimates come from. An estimate whose context wasn't seen has no weight, so that each
context's probabilities sum to one. Scores then use the counts of all training texts.

Counts are bulk look-ups (see `blocks`): blocks ask for their distinct n-grams, pre-counted; ranges
add them up. What the driver sees is one row a range and a table of cells of fixed number.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import blocks as B
from tessera.llm import text as T
from tessera.llm.graph import checkpoint, forget_shuffles

BLOCK_BYTES = 8 << 20
LEAST_BLOCKS, FOLDS, HELD_FOLD = 16, 8, 3
END, START = T.U64(0x0123456789ABCDEF), T.U64(0xFEDCBA9876543210)
BUCKETS = 48
#: Sets of weights: by the count of the two tokens before, of the one before, and one for neither.
SETS = 2 * BUCKETS + 1
#: Which of (trigram, bigram, unigram, uniform, unknown) may have weight in a set.
ALLOWED = np.array([[1, 1, 1, 1, 1]] * BUCKETS + [[0, 1, 1, 1, 1]] * BUCKETS + [[0, 0, 1, 1, 1]], float)
#: Bits of a hash above log2(tokens): few bigrams share a count; a trigram's counts no more than its bigrams.
SPARE_2, SPARE_3 = 21, 9
ROUNDS = 60
_ODD = T.U64(0x9E3779B97F4A7C15)


def tokens(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all tokens (words, A-Z lower-cased, then one end a text), of each one's
    predecessor, and offsets by text."""
    data, off = T.text_bytes(table.column("text"))
    codes, counts = [np.zeros(0, T.U64)], np.zeros(len(off) - 1, np.int64)
    for i, j in T.doc_slices(off):
        part = T.lower(data[off[i] : off[j]])
        starts, ends, first = T.words(part, off[i : j + 1] - off[i])
        codes.append(T.span_hash(part, starts, ends))
        counts[i:j] = np.diff(first)
    at = np.concatenate([[0], np.cumsum(counts + 1)])
    token = np.full(int(at[-1]), END, T.U64)
    token[T.expand(at[:-1], counts)] = np.concatenate(codes)
    before = np.empty(len(token), T.U64)
    before[1:] = token[:-1]
    before[at[:-1]] = START
    return token, before, at


def _before(values: np.ndarray, at: np.ndarray, first: int) -> np.ndarray:
    """The value at the token before; `first` at the first token of a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[at[:-1]] = first
    return out


def grams(token: np.ndarray, before: np.ndarray, at: np.ndarray, bits: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each token's bigram and trigram."""
    pair = T.mix(before * _ODD + token)
    three = T.mix(_before(pair, at, 0) * _ODD + token)
    return pair >> T.U64(64 - bits[0]), three >> T.U64(64 - bits[1])


def _counted(keys: np.ndarray, trained: np.ndarray, held: bool, bits: int = 64) -> B.Keys:
    """Distinct keys, how often each occurs in training texts, and in those of held-out blocks."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    n = np.bincount(inverse[trained], minlength=len(distinct)).astype(np.uint32)
    return B.Keys(distinct, [n, n if held else np.zeros_like(n)], bits)


def _is_held(block: int) -> bool:
    return block % FOLDS == HELD_FOLD


def count_grams(docs: DataFrame, n_blocks: int, bits: tuple[int, int], fan: int) -> DataFrame:
    """Answers for every block: counts in all training texts and in the held-out blocks' of each
    of its distinct unigrams (the start of a text included), bigrams and trigrams."""

    def keys_of(table: pa.Table) -> list[B.Keys]:
        held = _is_held(table.column("block")[0].as_py())
        token, before, at = tokens(table)
        texts = table.column("train").to_numpy()
        train = np.repeat(texts, np.diff(at))
        starts = np.repeat(START, int(texts.sum()))
        one = _counted(np.concatenate([token, [START], starts]), np.concatenate([train, [False], np.ones(len(starts), bool)]), held)
        pair, three = grams(token, before, at, bits)
        return [one, _counted(pair, train, held, bits[0]), _counted(three, train, held, bits[1])]

    def totals(spaces: list) -> list[int]:
        distinct, (total, apart) = spaces[0]
        word = distinct != START
        return [int(total[word].sum()), int((total[word] > 0).sum()), int(apart[word].sum()), int((total[word] > apart[word]).sum())]

    # what held-out blocks have apart matters to them alone
    return B.look_up(docs, n_blocks, keys_of, [2, 2, 2], [64, *bits], lambda _, sums: sums, totals, lambda block: [True, _is_held(block)], fan)


class Lookup:
    """A block's tokens with the counts of their n-grams and contexts."""

    def __init__(self, table: pa.Table, replies: list[bytes], bits: tuple[int, int], without_held: bool):
        token, before, self.at = tokens(table)
        parts = [B.split_parts(r) for r in replies]

        def counts(k: int) -> np.ndarray:
            total = np.concatenate([B.unpack(p[2 * k]).astype(np.int64) for p in parts])
            return total - np.concatenate([B.unpack(p[2 * k + 1]).astype(np.int64) for p in parts]) if without_held else total

        one = np.unique(np.concatenate([token, [START]]))
        n_one = counts(0)
        self.c1 = n_one[np.searchsorted(one, token)]
        self.after1 = n_one[np.searchsorted(one, before)]
        pair, three = (np.unique(x, return_inverse=True)[1] for x in grams(token, before, self.at, bits))
        self.c2 = counts(1)[pair]
        self.after2 = _before(self.c2, self.at, 0)
        self.c3 = np.minimum(np.minimum(counts(2)[three], self.c2), self.after2)

    def estimates(self, n: int) -> np.ndarray:
        """p3, p2 and p1 of each token; zero after a context that wasn't seen."""
        return np.stack([self.c3 / np.maximum(self.after2, 1), self.c2 / np.maximum(self.after1, 1), self.c1 / max(n, 1)], axis=1)

    def sets(self) -> np.ndarray:
        return weight_set(self.after2, self.after1)


def weight_set(after2: np.ndarray, after1: np.ndarray) -> np.ndarray:
    """The set of weights for contexts of these counts."""
    bucket = lambda c: np.minimum(np.ceil(np.log2(c + 1.0)).astype(np.int64), BUCKETS) - 1
    return np.where(after2 > 0, bucket(after2), np.where(after1 > 0, BUCKETS + bucket(after1), SETS - 1))


def mix(weights: np.ndarray, sets: np.ndarray, p: np.ndarray, known: np.ndarray, v: int) -> np.ndarray:
    """The mixtures of estimates p (p3, p2, p1), a uniform one of v known tokens, and the unknown one."""
    w = weights[sets]
    return np.where(known, (w[:, :3] * p).sum(1) + w[:, 3] / max(v, 1), w[:, 4])


def _cells(docs: DataFrame, answers: DataFrame, bits: tuple[int, int], n_rest: int) -> DataFrame:
    """Held-out tokens by set of weights and factor of two of each estimate: (set, known, number, sums of p3, p2, p1)."""

    def run(table: pa.Table, replies: list[bytes]) -> pa.Table:
        x = Lookup(table, replies, bits, True)
        use = np.repeat(table.column("train").to_numpy(), np.diff(x.at))
        p, known = x.estimates(n_rest)[use], (x.c1 > 0)[use]
        q = np.where(p > 0, 63 + np.maximum(np.round(np.log2(np.maximum(p, 1e-18))), -62), 0).astype(np.int64)
        key = (((x.sets()[use] * 2 + known) * 64 + q[:, 0]) * 64 + q[:, 1]) * 64 + q[:, 2]
        cell, inverse = np.unique(key, return_inverse=True)
        sums = [np.bincount(inverse, weights=w, minlength=len(cell)).astype(np.float64) for w in (np.ones(len(p)), *p.T)]
        return pa.table({"cell": pa.array(cell), **{name: pa.array(s) for name, s in zip(("number", "p3", "p2", "p1"), sums)}})

    found = B.with_answers(docs, answers, run, "cell long, number double, p3 double, p2 double, p1 double").groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("number", "p3", "p2", "p1")))
    return found.select(F.shiftright("cell", 19).alias("set"), F.shiftright("cell", 18).bitwiseAND(1).alias("known"), "number", "p3", "p2", "p1")


def mixture_weights(cells: np.ndarray, v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of (trigram, bigram, unigram, uniform, unknown) for each set.

    `cells` has rows (set, known, number, sums of p3, p2, p1). Each set starts from the weights of all
    sets of its kind together, which also count as one token of it.
    """
    n, kind = cells[:, 2], ALLOWED[cells[:, 0].astype(int)]
    p = np.stack([*(cells[:, 3:].T / n), cells[:, 1] / max(v, 1), 1.0 - cells[:, 1]], axis=1) if len(cells) else np.zeros((0, 5))

    def fit(rows: np.ndarray, start: np.ndarray) -> np.ndarray:
        w = start
        for _ in range(rounds):
            share = w * p[rows]
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
            w = (share * n[rows, None]).sum(0) + start
            w = w / w.sum()
        return w

    out = np.zeros((SETS, 5))
    for first, last in ((0, BUCKETS), (BUCKETS, 2 * BUCKETS), (2 * BUCKETS, SETS)):
        start = np.array([0.3, 0.3, 0.2, 0.1, 0.1]) * ALLOWED[first]
        start /= start.sum()
        overall = fit(np.flatnonzero((kind == ALLOWED[first]).all(1)), start) if len(cells) else start
        for k in range(first, last):
            out[k] = fit(np.flatnonzero(cells[:, 0] == k), overall) if len(cells) else overall
    return out


def score(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, fan: int = B.FAN, weights: np.ndarray | None = None) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of each text.

    `train` picks the rows to learn from. n_known counts tokens seen in training, train_tokens all
    training tokens. base_score is the add-one unigram score, score the mixture's, both sums of
    log10 probabilities in which all unknown tokens are one type. A null text is an empty one, just
    an end. Rows stay apart, repeated ids included; other columns are left out. Where nothing is
    held out to learn from, weights stay at their start. `weights` (sets x 5) are used instead of
    learned ones.

    Bigrams are known by hashes of log2(tokens) + 21 bits, so that about one in two million shares
    its count with another; unigrams by 64 bits; trigrams by 12 bits less than bigrams, and counted no
    more often than either of their bigrams: an unseen one of two seen bigrams gets a count by chance
    with one in about 500.
    """
    n_blocks = max(LEAST_BLOCKS, B.block_count(df, text_col, block_bytes))
    size = math.ceil(math.log2((df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) / 4 + 2))
    bits = (min(64, size + SPARE_2), min(64, size + SPARE_3))
    docs = B.deal(df, id_col, text_col, n_blocks, F.coalesce(train, F.lit(False)).alias("train"))
    answers = checkpoint(count_grams(docs, n_blocks, bits, fan))
    n, v, n_held, v_rest = (x or 0 for x in answers.agg(*(F.sum(F.col("sums")[k]) for k in range(4))).first())
    answers = answers.select("block", "part", "data")
    forget_shuffles(docs)
    if weights is None:
        held = F.col("block") % FOLDS == HELD_FOLD
        cells = _cells(docs.where(held), answers.where(held), bits, n - n_held).collect()
        weights = mixture_weights(np.array(cells, np.float64).reshape(-1, 6), v_rest)
        forget_shuffles(docs)

    def run(table: pa.Table, replies: list[bytes]) -> pa.Table:
        x = Lookup(table, replies, bits, False)
        known = x.c1 > 0
        mixed = np.log10(mix(weights, x.sets(), x.estimates(n), known, v))
        base = np.log10((x.c1 + 1) / (n + 1 * (v + 1)))
        total = [np.add.reduceat(y, x.at[:-1]) for y in (known.astype(np.int64), base, mixed)]
        return pa.table({"id": table.column("id"), "n_tokens": pa.array(np.diff(x.at)), "n_known": pa.array(total[0]), "train_tokens": pa.array(np.full(len(total[0]), n, np.int64)), "base_score": pa.array(total[1]), "score": pa.array(total[2])})

    schema = f"id {docs.schema['id'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return B.with_answers(docs, answers, run, schema).withColumnRenamed("id", id_col)
