"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone; there is no ring table, and
one more shard takes 1/(n+1) of the rows, each into the new shard. Slots number the rows of a
shard from 0 without gaps, in key order (rows of a hot key after the rest of their range).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm import blocks as B

U64 = np.uint64
ROWS_PER_RANGE = 100_000
MOST_RANGES = 10_000


def jump_hash(keys: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard in [0, n_shards) of each 64-bit key (Lamping and Veach's jump consistent hash)."""
    key = np.array(keys, U64)
    shard = np.zeros(len(key), np.int64)
    ahead = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        shard[live] = ahead[live]
        key[live] = key[live] * U64(2862933555777941757) + U64(1)
        step = (shard[live] + 1) * (float(1 << 31) / ((key[live] >> U64(33)).astype(np.float64) + 1))
        ahead[live] = np.minimum(step, n_shards).astype(np.int64)
        live = live[ahead[live] < n_shards]
    return shard


def assign_shards(df: DataFrame, key: str, n_shards: int, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds `shard`, `grown_shard` (with one shard more) and `slot` to all columns of `df`.

    `key` is an integer column, or any other column, which is then hashed to 64 bits. A null key
    goes to the shard of key 0. Rows of equal keys share a shard and get slots in no
    stated order. An empty table gives an empty one. Columns of these three names are replaced.

    Slots need no task that holds a shard: the keys are cut into ranges at quantiles, (shard,
    range) groups are numbered apart, and each starts where the counts of those before end. A
    range holds about `rows_per_range` keys, so tasks stay alike at any size. Where one key has
    more rows than that, its rows are also cut by a hash of the other columns.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    names = [c for c in df.columns if c not in ("shard", "grown_shard", "slot")]
    integral = df.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    column = df[f"`{key}`"]
    number = F.coalesce(column.cast("long"), F.lit(0)) if integral else F.xxhash64(column)
    others = [df[f"`{c}`"] for c in names if not _has_map(df.schema[c].dataType)]
    rows = df.select(number.alias("key"), F.pmod(F.xxhash64(*others), F.lit(1 << 16)).alias("salt"), B.folded(df.select(*(f"`{c}`" for c in names))).alias("row"))
    n = rows.count()
    rows_per_range = max(rows_per_range, -(-n // MOST_RANGES))  # the cuts stay small enough for any task
    ranges = max(1, -(-n // rows_per_range))
    cuts: list[int] = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(rows.agg(F.percentile_approx("key", shares, 20 * ranges)).first()[0]))

    def place(keys: pd.Series) -> pd.DataFrame:
        k = keys.to_numpy(np.int64)
        at = np.searchsorted(np.array(cuts, np.int64), k, side="left") if cuts else np.zeros(len(k), np.int64)
        u = k.view(U64)
        return pd.DataFrame({"shard": jump_hash(u, n_shards), "grown": jump_hash(u, n_shards + 1), "range": at})

    placed = F.pandas_udf(place, "shard int, grown int, range int")("key")
    rows = rows.withColumn("place", placed)
    part = F.lit(0)
    hot = rows.groupBy("key").count().where(F.col("count") > rows_per_range)
    if not hot.isEmpty():  # rows of a hot key are dealt into parts of about rows_per_range
        hot = hot.select(F.col("key").alias("hot"), F.ceil(F.col("count") / rows_per_range).cast("int").alias("parts"))
        rows = rows.join(hot, F.col("key") == F.col("hot"), "left")
        part = F.when(F.col("parts").isNull(), 0).otherwise(1 + F.pmod(F.col("salt"), F.col("parts")))
    rows = rows.select("key", "salt", "row", F.col("place.shard").alias("shard"), F.col("place.grown").alias("grown"), F.col("place.range").alias("range"), part.cast("int").alias("part"))
    sizes = rows.groupBy("shard", "range", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("shard", "range", "part").orderBy("key", "salt")
    out = rows.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["shard", "range", "part"])
    return out.select(*(F.col("row")[f"c{i}"].alias(c) for i, c in enumerate(names)), "shard", F.col("grown").alias("grown_shard"), (F.col("start") + F.col("rank")).cast("long").alias("slot"))


def _has_map(kind) -> bool:
    return "map" in kind.simpleString()


def write_shards(df: DataFrame, path: str, key: str, n_shards: int, **options) -> None:
    """Writes one folder a shard (`shard=k`), each of files of about the same size."""
    placed = assign_shards(df, key, n_shards, **options)
    placed.repartition("shard", F.floor(F.col("slot") / ROWS_PER_RANGE)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
