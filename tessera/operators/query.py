"""Comparison queries over arrays kept as (_pos, value): results are half-open ranges of positions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.position import POS

VALUE = "value"
_OPS = {"<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v}


@dataclass(frozen=True)
class Query:
    """A lazy predicate over one array; `&`, `|`, `^` and `~` combine queries of the same array."""

    data: DataFrame
    predicate: Column

    def __and__(self, other: Query) -> Query:
        return Query(self.data, self.predicate & other.predicate)

    def __or__(self, other: Query) -> Query:
        return Query(self.data, self.predicate | other.predicate)

    def __xor__(self, other: Query) -> Query:
        return Query(self.data, self.predicate != other.predicate)

    def __invert__(self) -> Query:
        return Query(self.data, ~self.predicate)

    def rows(self) -> DataFrame:
        return self.data.where(self.predicate)

    def ranges(self) -> DataFrame:
        """(start, stop): maximal runs of matching positions."""
        return islands(self.rows().select(POS))


def compare(data: DataFrame, op: str, value) -> Query:
    """A comparison with a value, a list of values (`==`, `!=`), or a pair (a, b): a <= v < b."""
    v = F.col(VALUE)
    if isinstance(value, tuple) and len(value) == 2:
        inside = (v >= value[0]) & (v < value[1])
        return Query(data, inside if op == "==" else ~inside)
    if isinstance(value, (list, set)):
        return Query(data, v.isin(list(value)) if op == "==" else ~v.isin(list(value)))
    return Query(data, _OPS[op](v, F.lit(value)))


def islands(positions: DataFrame, block: int = 1_000_000) -> DataFrame:
    """(start, stop) of maximal runs of positions: by blocks first, then across block edges."""
    inside = Window.partitionBy("_block").orderBy(POS)
    runs = positions.select(POS, F.floor(F.col(POS) / block).alias("_block")).withColumn("_run", F.col(POS) - F.row_number().over(inside))
    parts = runs.groupBy("_block", "_run").agg(F.min(POS).alias("start"), (F.max(POS) + 1).alias("stop"))
    # only runs that touch a block's edge can go on in the next block
    edge = (F.col("start") == F.col("_block") * block) | (F.col("stop") == (F.col("_block") + 1) * block)
    over = Window.orderBy("start")
    open_runs = parts.where(edge).withColumn("_new", (F.col("start") != F.lag("stop", 1, -1).over(over)).cast("int"))
    joined = open_runs.withColumn("_g", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0))).groupBy("_g").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return parts.where(~edge).select("start", "stop").unionByName(joined.select("start", "stop"))


def sorted_range(data: DataFrame, op: str, value) -> DataFrame:
    """For a sorted array, (start, stop) of the one range that a comparison picks; where it is empty,
    start = stop = the insertion point. Only the bounds are aggregated: the filter reaches the scan."""
    v = F.col(VALUE)
    below = lambda x, closed=False: F.count(F.when(v <= x if closed else v < x, 1))
    n = F.count(F.lit(1))
    if isinstance(value, tuple):
        a, b = value
        return data.agg(below(F.lit(a)).alias("start"), F.greatest(below(F.lit(a)), below(F.lit(b))).alias("stop"))
    x = F.lit(value)
    start, stop = {"<": (F.lit(0), below(x)), "<=": (F.lit(0), below(x, True)), ">": (below(x, True), n), ">=": (below(x), n), "==": (below(x), below(x, True))}[op]
    return data.agg(start.cast("long").alias("start"), stop.cast("long").alias("stop"))


@dataclass(frozen=True)
class LinSpace:
    """start, start + step, ... below stop, without storage: predicates become arithmetic on positions."""

    start: float
    stop: float
    step: float

    def __len__(self) -> int:
        return max(0, int((self.stop - self.start) / self.step))

    def find(self, value: float, after: bool = False) -> int:
        """The first position whose element is >= value (> with `after`), within [0, n]."""
        at = (value - self.start) / self.step
        at = math.floor(at) + 1 if after else math.ceil(at)
        return min(max(at, 0), len(self))

    def range_of(self, op: str, value) -> list[tuple[int, int]]:
        n = len(self)
        if isinstance(value, tuple):
            a = self.find(value[0])
            return [(a, max(a, self.find(value[1])))]
        lo, hi = self.find(value), self.find(value, True)
        return {"<": [(0, lo)], "<=": [(0, hi)], ">": [(hi, n)], ">=": [(lo, n)], "==": [(lo, hi)], "!=": [r for r in ((0, lo), (hi, n)) if r[0] < r[1]]}[op]

    def frame(self, spark: SparkSession, ranges: Sequence[tuple[int, int]] | None = None) -> DataFrame:
        parts = [spark.range(a, b) for a, b in (ranges if ranges is not None else [(0, len(self))])] or [spark.range(0)]
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.select(F.col("id").alias(POS), (F.lit(self.start) + F.lit(self.step) * F.col("id")).alias(VALUE))


def pick(data: DataFrame, key) -> DataFrame:
    """Elements by int, slice, Query, pair (start, stop) or a list that mixes these; `_ord` keeps the list's order."""
    if isinstance(key, Query):
        return data.where(key.predicate).withColumn("_ord", F.lit(0))
    if isinstance(key, int):
        return data.where(F.col(POS) == key).withColumn("_ord", F.lit(0))
    if isinstance(key, tuple) and len(key) == 2:
        key = slice(*key)
    if isinstance(key, slice):
        start, step = key.start or 0, key.step or 1
        rows = data.where((F.col(POS) >= start) & (F.pmod(F.col(POS) - start, F.lit(step)) == 0))
        return (rows.where(F.col(POS) < key.stop) if key.stop is not None else rows).withColumn("_ord", F.lit(0))
    parts = [pick(data, k).withColumn("_ord", F.lit(i)) for i, k in enumerate(key)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
