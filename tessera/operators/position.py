"""Row positions: every engine table carries `_pos`, 0 to n-1 without gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.lineage import checkpoint

POS = "_pos"
RANGES = 256
SMALL = 50_000  # rows that one range may hold
LARGE = 4_000_000  # rows that a range holds at most, whatever the table's size
MOST_SHARES = 8  # quantiles that one value may take up


def from_key(df: DataFrame, key: str) -> DataFrame:
    """Positions from a key that is already 0..n-1; costs nothing."""
    return df.select(F.col(key).cast("long").alias(POS), "*")


def number(df: DataFrame, *order: str | Column, name: str = POS, ranges: int = RANGES) -> DataFrame:
    """Numbers rows by `order` without putting them into one task.

    Rows are cut into ranges, numbered within their range, and each range starts where the counts of
    those before it end. A leading number is cut at its quantiles, which moves no data. Where it leads
    with something else, or one value holds much more than a range's share, rows are dealt by the whole
    order in a range exchange, whose outcome is checkpointed; so are tables of over LARGE rows a range,
    in as many ranges as that takes. Ties keep no stated order. Nulls come first.
    """
    keyed = df.withColumn("__lead", order[0] if isinstance(order[0], Column) else F.col(order[0]))
    rest = list(order[1:])
    n, bucket = _quantile_range(keyed, ranges)
    if bucket is None:
        ranges = max(ranges, -(-n // LARGE))
        ranged = keyed.repartitionByRange(ranges, "__lead", *rest).withColumn("__bucket", F.spark_partition_id())
        keyed = checkpoint(ranged)  # a partition's number must not change when it is computed again
    else:
        keyed = keyed.withColumn("__bucket", F.expr(bucket))
    starts = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = keyed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__n"))  # one row a range
    counts = counts.select(F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(starts), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__bucket").orderBy("__lead", *rest)
    ranked = keyed.withColumn("__rank", F.row_number().over(inside) - 1)
    out = ranked.join(counts, F.col("__bucket") == F.col("__b"))  # one row a range: broadcast by its size
    return out.select((F.col("__start") + F.col("__rank")).cast("long").alias(name), *df.columns)


def number_sparse(df: DataFrame, key: str, name: str = POS, block: int = 100_000, most: int | None = None) -> DataFrame:
    """Numbers rows by a unique whole number from 0 on that may have gaps, as positions of some rows of
    a table have. A block of `block` values holds no more rows than that, so no quantiles are sought.
    Where there are `most` rows at most, and so few that one range may hold them, they are one."""
    if most is not None and most <= SMALL:
        return df.select((F.row_number().over(Window.orderBy(key)) - 1).cast("long").alias(name), *df.columns)
    blocks = df.withColumn("__block", F.floor(F.col(key) / block))
    starts = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.groupBy("__block").agg(F.count(F.lit(1)).alias("__n"))  # one row a block
    counts = counts.select("__block", F.coalesce(F.sum("__n").over(starts), F.lit(0)).alias("__start"))
    ranked = blocks.withColumn("__rank", F.row_number().over(Window.partitionBy("__block").orderBy(key)) - 1)
    return ranked.join(counts, "__block").select((F.col("__start") + F.col("__rank")).cast("long").alias(name), *df.columns)


def _quantile_range(keyed: DataFrame, ranges: int) -> tuple[int, str | None]:
    """The number of rows as far as it matters, and SQL for the range of a numeric `__lead`, or None
    where quantiles don't cut the rows evenly or well enough.

    Ranges are as many as asked for, or fewer that hold about SMALL rows each.
    """
    kind = dict(keyed.dtypes)["__lead"]
    if kind in ("date", "timestamp", "timestamp_ntz"):
        measure = "double(unix_micros(timestamp(__lead)))"
    elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        measure = "double(__lead)"
    else:
        n = keyed.count()
        return n, None if n > SMALL else "0"
    n, known, cuts = keyed.agg(F.count(F.lit(1)), F.count(F.expr(measure)), F.percentile_approx(F.expr(measure), [i / ranges for i in range(1, ranges)], 20 * ranges)).first()
    if n <= SMALL or not cuts:
        return n, "0"
    if n > ranges * LARGE:
        return n, None
    if max(cuts.count(c) for c in set(cuts)) > MOST_SHARES or (n - known) * ranges > MOST_SHARES * n:
        return n, None
    every = max(1, ranges * SMALL // n)
    return n, f"CASE WHEN {measure} IS NULL THEN -1 ELSE {_search(measure, sorted(set(cuts))[every - 1 :: every])} END"


def _search(value: str, cuts: list) -> str:
    """SQL for how many of the ascending cuts are less than value, by halving; one text, as building
    so many nested columns takes seconds."""
    if not cuts:
        return "0"
    m = len(cuts) // 2
    return f"CASE WHEN {value} > double('{cuts[m]!r}') THEN {m + 1} + {_search(value, cuts[m + 1 :])} ELSE {_search(value, cuts[:m])} END"


def normalise(index: int, n: int) -> int:
    """A Python row index as a position; out of range is an IndexError."""
    at = index + n if index < 0 else index
    if not 0 <= at < n:
        raise IndexError(f"Row index {index} out of range for a table of {n} rows")
    return at
