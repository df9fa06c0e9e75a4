"""Queries of the numbered operators over the `documents`, `pages` and `benchmark` tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import oracles

N_SHARDS = 8


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 by jump consistent hashing of doc_id (law `key`)."""
    from tessera.llm.sharding import assign_shards

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = _read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law")
    )
    return assign_shards(rows, "doc_id", N_SHARDS).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` encoded with the 49k word BPE, and decoded again."""
    import public_tokenizers

    from tessera.llm.bpe import encode

    return encode(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` as a motion-JPEG AVI, read back into timed shots."""
    from tessera.llm.media import read_back, store

    return read_back(store(_read(spark, sf_dir, "documents")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles of `documents`, linked at 4 bits or fewer."""
    from tessera.llm.simhash import near_duplicates

    found = near_duplicates(_read(spark, sf_dir, "documents"), k=4, radius=4)
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of `documents`, learned from those that aren't held out."""
    from tessera.llm.langid import predict, train

    docs = _read(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = train(docs.where(~held_out))
    return predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents leak which share of an item of `benchmark`."""
    from tessera.llm.decontaminate import judge

    return judge(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page of `pages`."""
    from tessera.llm.html import extract

    return extract(_read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text")


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of `documents` without 100-byte strings that also start earlier."""
    from tessera.llm.suffixes import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"), window=100, digests=True)


def op5_fmindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of `documents` without sequences of 35 words that also start elsewhere."""
    from tessera.llm.fmindex import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"), window=35, digests=True)


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all texts of `documents`, learned from those that aren't held out."""
    from tessera.llm.lm import score

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = score(_read(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op3_lm": op3_lm, "op5_fmindex": op5_fmindex, "op2_suffixes": op2_suffixes, "op10_html": op10_html, "op8_decontaminate": op8_decontaminate, "op7_langid": op7_langid, "op4_simhash": op4_simhash, "op9_media": op9_media, "op6_bpe": op6_bpe, "op1_sharding": op1_sharding}
ORACLES = {"op1_sharding": oracles.SHARDING, "op2_suffixes": oracles.SUFFIXES, "op5_fmindex": oracles.FM_INDEX}
