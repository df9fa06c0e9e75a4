"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, tokenization.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next stage's documents. All but the last keep the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, fmindex, langid, simhash

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SIMILARITY = 0.8
WINDOW = 35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language: null texts and those without letters.

    The others keep their own `lang` where they have one and get the predicted one where not. Where
    no row has a `lang` to learn from, texts with a letter stay without one.
    """
    model = langid.train(docs)
    if not model.languages:
        return docs.where(docs["text"].rlike(r"\p{L}"))
    names = docs.columns  # numbered on the way, so that none clashes with those of the prediction
    plain = docs.select(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)))
    found = langid.predict(plain, model, text_col=f"c{names.index('text')}").where(F.col("lang_pred") != langid.UNDETERMINED)
    return found.select(*((F.coalesce(f"c{i}", "lang_pred") if c == "lang" else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-copies: SimHash over shingles of five words finds them, and an
    exact check keeps links of a similarity of 0.8 or more."""
    groups = simhash.similar_groups(docs, k=5, similarity=SIMILARITY)
    return simhash.keep_first(docs, groups, "doc_id")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts sequences of 35 words that occur more than once out of all texts, which keep their
    layout; a text of which nothing is left goes."""
    rows = fmindex.cut_repeats(docs, window=WINDOW, drop_emptied=True)
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that leak half of a benchmark item or more, in whatever order."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaked = decontaminate.leaks(docs, items).select("doc_id").distinct()
    return docs.join(leaked, docs["doc_id"].eqNullSafe(leaked["doc_id"]), "left_anti")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.encode(docs, TOKENIZER, digests=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("decontamination", decontaminate_benchmark),
    ("bpe", tokenize),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each checkpointed before the next."""
    from tessera.llm.graph import checkpoint

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
