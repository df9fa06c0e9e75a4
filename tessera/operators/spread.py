"""Joins of many rows with few rows for each key, where some keys may have a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.local import small_frame

FEW = 10_000  # keys whose rows are broadcast
SHARE = 0.001  # of all rows, from which on a key's rows don't meet in one task


def heavy_keys(rows: DataFrame, key: str) -> list:
    """The values that SHARE of all rows or more have, and perhaps some others; nulls left out."""
    found = rows.select(key).where(F.col(key).isNotNull()).freqItems([key], SHARE).first()[0]
    return list(found or [])


def joined(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """The inner or left join by `key`. The rows of the table whose key is a heavy one are broadcast (1 / SHARE
    keys at most), so that the heavy rows stay where they are."""
    heavy = heavy_keys(rows, key)
    if not heavy:
        return rows.join(table, key, how)
    often = lambda df: df.where(F.col(key).isin(heavy))
    seldom = lambda df: df.where(~F.coalesce(F.col(key).isin(heavy), F.lit(False)))
    return seldom(rows).join(seldom(table), key, how).unionByName(often(rows).join(F.broadcast(often(table)), key, how))


def met(table: DataFrame, rows: DataFrame, key: str) -> list[DataFrame]:
    """The left join of the table with the rows, in parts that share no key: what is grouped by the key and more needn't
    be shuffled again. Rows of heavy keys stay where they are; the table's are broadcast to them, and there once more alone."""
    heavy = heavy_keys(rows, key)
    if not heavy:
        return [table.join(rows, key, "left")]
    often = F.coalesce(F.col(key).isin(heavy), F.lit(False))
    few = table.where(often)
    return [table.where(~often).join(rows.where(~often), key, "left"), rows.where(often).join(F.broadcast(few), key).unionByName(few, allowMissingColumns=True)]


def looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The left join with a table that has one row for each key at most. Where the rows have FEW keys, the
    table is not shuffled."""
    keys = [r[0] for r in rows.select(key).where(F.col(key).isNotNull()).distinct().limit(FEW + 1).collect()]
    if len(keys) > FEW:
        return joined(rows, table, key, "left")
    asked = small_frame(rows.sparkSession, [(k,) for k in keys], f"{key} {table.schema[key].dataType.simpleString()}")
    return rows.join(F.broadcast(table.join(F.broadcast(asked), key, "left_semi")), key, "left")
