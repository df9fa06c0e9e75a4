"""Connected components of a link table, as repeated joins."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.lineage import checkpoint

__all__ = ["checkpoint", "components", "forget_shuffles", "join_aggregate"]


def forget_shuffles(df: DataFrame) -> None:
    """Lets Spark remove the exchanges that only finished jobs have read: their files go once the
    driver's JVM has collected what refers to them, which can otherwise take as long as the run.
    Those of the last job stay until another one has run."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def components(links: DataFrame, least: str = "u", other: str = "v") -> DataFrame:
    """(node, root) for every node of a link, root being the least node that it reaches.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes; each
    is one aggregation and one join, whatever the shape of a component. Self-links and repeated
    links do no harm; an empty table gives an empty one.
    """
    edges = links.select(F.greatest(least, other).alias("a"), F.least(least, other).alias("b")).where("a <> b").distinct()
    edges = checkpoint(edges)
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = join_aggregate(both.where("b > a"), low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = join_aggregate(large, low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        edges = checkpoint(small)
        now = _state(edges)
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def join_aggregate(rows: DataFrame, aggregate: DataFrame, key: str) -> DataFrame:
    """Rows with what was aggregated by a key that may be very frequent, as the centre of a component
    is. The second key gives the join exchanges of its own, which adaptive execution can split; it
    can't split those that an aggregation shares."""
    hashed = lambda df: df.withColumn("__h", F.xxhash64(key))
    return hashed(rows).join(hashed(aggregate), ["__h", key]).drop("__h")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30)))).first())
