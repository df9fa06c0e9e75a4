"""Language identification by mixture inference.

A document is a mixture of languages: each of its words is drawn from one of them, with the
likelihood of its byte n-grams. Expectation-maximisation finds the proportions, and the set of
languages is the one of best penalised likelihood. The n-gram model is a hashed count table of
fixed size for each language, learned on Spark from a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.llm import blocks as B
from tessera.llm import text as T

ORDERS = (3, 4)
BUCKETS = 1 << 16
SAMPLE = 4000
UNDETERMINED = "und"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Model:
    """Languages in order, and log p(n-gram bucket | language), languages x (orders * buckets)."""

    languages: list[str]
    table: np.ndarray


def word_grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the byte n-grams within each word and one blank on either side.

    Returns the buckets, each one's word, and the document of each word and offsets of words by
    document. Words are runs of letters: A-Z, a-z and all non-ASCII bytes.
    """
    letter = _LETTER[data]
    doc_start = np.zeros(len(data) + 1, bool)
    doc_start[off] = True
    before = np.concatenate([[False], letter[:-1]]) & ~doc_start[:-1]
    starts = np.flatnonzero(letter & ~before)
    after = np.concatenate([letter[1:], [False]]) & ~doc_start[1:]
    ends = np.flatnonzero(letter & ~after) + 1
    first = np.searchsorted(starts, off)
    size = ends - starts + 2
    at = np.cumsum(size) - size
    padded = np.full(int(size.sum()), 0x20, np.uint32)
    padded[T.expand(at + 1, size - 2)] = T.lower(data[letter])
    buckets, owner = [], []
    for o, n in enumerate(ORDERS):
        count = np.maximum(size - n + 1, 0)
        i = T.expand(at, count)
        h = np.zeros(len(i), np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + padded[i + k]
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        buckets.append(((h >> np.uint32(16)) & np.uint32(BUCKETS - 1)).astype(np.int64) + o * BUCKETS)
        owner.append(np.repeat(np.arange(len(size)), count))
    return buckets, owner, first, len(starts)


def train(df: DataFrame, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, smoothing: float = 0.5) -> Model:
    """Learns from about `sample` whole texts of each language at most, chosen by a hash of the id.

    Rows without a language or text teach nothing. Without any labelled row the model has no
    languages and all predictions are `und`.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a label
    if not sizes:
        return Model([], np.zeros((0, len(ORDERS) * BUCKETS), np.float32))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample / n))])
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            data, off = T.text_bytes(batch.column("text"))
            for i, j in T.doc_slices(off):
                buckets, owner, first, _ = word_grams(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for lang in set(langs[i:j]):
                    own = np.repeat(langs[i:j] == lang, np.diff(first))
                    total = totals.setdefault(lang, np.zeros(len(ORDERS) * BUCKETS))
                    for b, w in zip(buckets, owner):
                        total += np.bincount(b[own[w]], minlength=len(total))
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals)), pa.array([v.tobytes() for v in totals.values()], pa.binary())], ["lang", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float64) for x in table.column("counts").to_pylist())
        return pa.table({"lang": table.column("lang").slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "lang string, counts binary"
    found = sorted((r["lang"], np.frombuffer(r["counts"], np.float64)) for r in rows.mapInArrow(count, schema).groupBy("lang").applyInArrow(add, schema).collect())
    logs = []
    for _, c in found:
        by_order = c.reshape(len(ORDERS), BUCKETS) + smoothing
        logs.append(np.log(by_order / by_order.sum(1, keepdims=True)).ravel())
    return Model([k for k, _ in found], np.array(logs, np.float32))


def mixtures(model: Model, data: np.ndarray, off: np.ndarray, rounds: int, penalty: float) -> np.ndarray:
    """Proportions of the languages in each document; zero for those not selected.

    Languages join a document's set in order of their share in the full mixture, as long as the
    log-likelihood rises by more than `penalty` times log(1 + words) for each.
    """
    n_docs, n_lang = len(off) - 1, len(model.languages)
    buckets, owner, first, n_words = word_grams(data, off)
    like = np.zeros((n_lang, n_words))
    for b, w in zip(buckets, owner):
        for k in range(n_lang):
            like[k] += np.bincount(w, weights=model.table[k][b], minlength=n_words)
    doc = np.repeat(np.arange(n_docs), np.diff(first))
    top = like.max(0) if n_words else np.zeros(0)
    p = np.exp(np.maximum(like - top, -700))
    single = np.stack([np.bincount(doc, weights=x, minlength=n_docs) for x in like]) if n_words else np.zeros((n_lang, n_docs))
    n = np.maximum(np.diff(first), 1)
    best = single.argmax(0)
    pi = np.zeros((n_lang, n_docs))
    pi[best, np.arange(n_docs)] = 1
    # log-likelihood is concave in the proportions, so it rises above that of one language alone by no
    # more than its slope towards another, and by no more than if each word had its best language; a
    # rise within the penalty changes nothing
    own = np.take_along_axis(p, best[doc][None], 0)[0] if n_words else np.zeros(0)
    slope = np.stack([np.bincount(doc, weights=x / np.maximum(own, 1e-300), minlength=n_docs) for x in p]) if n_words else single
    most_gain = np.minimum((slope - n).max(0, initial=0), np.bincount(doc, weights=top, minlength=n_docs) - single.max(0))
    mixed = np.flatnonzero(most_gain > penalty * np.log1p(n))
    if len(mixed):
        words = T.expand(first[mixed], np.diff(first)[mixed])
        pi[:, mixed] = _select(single[:, mixed], p[:, words].astype(np.float32), top[words], n[mixed], rounds, penalty)
    return pi


def _select(single, p, top, n, rounds: int, penalty: float) -> np.ndarray:
    """Proportions within the chosen set of languages of documents that may have several; n are their
    numbers of words, one at least."""
    n_lang, n_docs = single.shape
    starts = np.cumsum(n) - n

    def fit(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pi = mask / np.maximum(mask.sum(0), 1)
        for _ in range(rounds):
            joint = np.repeat(pi.astype(np.float32), n, axis=1)
            joint *= p
            joint /= np.maximum(joint.sum(0), np.float32(1e-30))
            pi = np.add.reduceat(joint, starts, axis=1, dtype=np.float64) / n
        mixed = (np.repeat(pi.astype(np.float32), n, axis=1) * p).sum(0, dtype=np.float64)
        return pi, np.add.reduceat(np.log(np.maximum(mixed, 1e-300)) + top, starts)

    share, _ = fit(np.ones((n_lang, n_docs), bool))
    order = np.argsort(-share, axis=0, kind="stable")
    chosen = np.zeros((n_lang, n_docs), bool)
    chosen[single.argmax(0), np.arange(n_docs)] = True
    pi, score = chosen.astype(float), single.max(0)
    growing = np.ones(n_docs, bool)
    for rank in range(n_lang):
        wider = chosen.copy()
        wider[order[rank], np.arange(n_docs)] = True
        if (same := (wider == chosen).all(0)).all():
            continue
        new_pi, new_score = fit(wider)
        better = growing & ~same & (new_score - score > penalty * np.log1p(n))
        growing &= better | same
        chosen[:, better], pi[:, better], score[better] = wider[:, better], new_pi[:, better], new_score[better]
        if not growing.any():
            break
    return pi


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", rounds: int = 8, penalty: float = 3.0) -> DataFrame:
    """Adds lang_pred, score and lang_mix to all columns of `df`.

    lang_pred is the language of the largest proportion, score that proportion, lang_mix the
    selected languages with their proportions. A text that is null or has no letter gets `und`
    and score 0. All languages compete within a document. Columns of the three names are replaced; repeated rows stay.
    """
    df = df.select(*(f"`{c}`" for c in df.columns if c not in ("lang_pred", "score", "lang_mix")))
    rows = df.select(df[f"`{text_col}`"].alias("text"), B.folded(df, text_col).alias("row"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x a fixed number of buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            data, off = T.text_bytes(batch.column("text"))
            for i, j in T.doc_slices(off):
                part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                pi = mixtures(model, part, o, rounds, penalty) if model.languages else np.zeros((1, j - i))
                plain = np.concatenate([[0], np.cumsum(_LETTER[part] & (part < 128))])
                letters = plain[o[1:]] > plain[o[:-1]]
                for d in np.flatnonzero(~letters & (np.diff(o) > 0)):
                    letters[d] = any(map(str.isalpha, part[o[d] : o[d + 1]].tobytes().decode(errors="replace")))
                known = letters & (len(model.languages) > 0)
                pred = np.where(known, pi.argmax(0), len(names) - 1)
                score = np.where(known, np.clip(pi.max(0), 0, 1), 0.0)
                mix = ["" if not k else ",".join(f"{names[x]}:{pi[x, d]:.3f}" for x in np.argsort(-pi[:, d], kind="stable") if pi[x, d] >= 0.0005) for d, k in enumerate(known)]
                yield pa.RecordBatch.from_arrays([batch.column("text").slice(i, j - i), batch.column("row").slice(i, j - i), pa.array(names[pred].tolist(), pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.string())], ["text", "row", "lang_pred", "score", "lang_mix"])
            B.release()

    added = StructType([StructField("text", rows.schema["text"].dataType), StructField("row", rows.schema["row"].dataType), *StructType.fromDDL("lang_pred string, score double, lang_mix string").fields])
    found = rows.mapInArrow(run, added)
    kept = (F.col("text") if c == text_col else F.col("row")[f"c{i}"] for i, c in enumerate(df.columns))
    return found.select(*(k.alias(c) for k, c in zip(kept, df.columns)), "lang_pred", "score", "lang_mix")
