"""Ragged columns as nested arrays, their (data, end offsets) form, and enumerated columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import position
from tessera.operators.position import POS


def ends(df: DataFrame, column: str | Column, block: int = 100_000) -> DataFrame:
    """(_pos, end): cumulative lengths of a column of lists, by position.

    A prefix sum in two steps: within blocks of positions, then over the blocks' totals.
    """
    cells = df.select(POS, F.size(F.col(column) if isinstance(column, str) else column).cast("long").alias("n"), F.floor(F.col(POS) / block).alias("_block"))
    totals = cells.groupBy("_block").agg(F.sum("n").alias("t"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # one row for each `block` rows
    totals = totals.select("_block", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("_block").orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    return cells.join(totals, "_block").select(POS, (F.col("start") + F.sum("n").over(inside)).cast("long").alias("end"))


def encode(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """The flat values (_pos, value) and the ends (_pos, end) of a column of lists."""
    e = ends(df, column)
    cells = df.join(e, POS).select((F.col("end") - F.size(column)).alias("start"), F.posexplode(column).alias("i", "value"))
    return cells.select((F.col("start") + F.col("i")).alias(POS), "value"), e


def decode(flat: DataFrame, ends: DataFrame, block: int = 100_000) -> DataFrame:
    """(_pos, value): lists from flat (_pos, value) data and ends (_pos, end); empty cells are []."""
    lead = Window.partitionBy("_block").orderBy(POS)
    blocks = ends.withColumn("_block", F.floor(F.col(POS) / block))
    edge = blocks.groupBy("_block").agg(F.max("end").alias("before")).select((F.col("_block") + 1).alias("_block"), "before")
    spans = blocks.join(edge, "_block", "left").select(POS, F.coalesce(F.lag("end").over(lead), "before", F.lit(0)).alias("start"), "end")
    members = spans.where("end > start").select(POS, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("_at"))
    lists = members.join(flat.select(F.col(POS).alias("_at"), "value"), "_at").groupBy(POS).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "value"))), lambda x: x["value"]).alias("value"))
    return spans.select(POS).join(lists, POS, "left").select(POS, F.coalesce("value", F.array().cast(lists.schema["value"].dataType)).alias("value"))


def slice_by_ends(data: Column, ends: Column) -> Column:
    """The same for arrays within one row: data [a, b, c], ends [1, 3] gives [[a], [b, c]]."""
    cut = F.transform(F.sequence(F.lit(0), F.size(ends) - 1), lambda i: F.slice(data, F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1)).cast("int") + 1, (F.get(ends, i) - F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))).cast("int")))
    return F.when(F.size(ends) > 0, cut).otherwise(F.slice(F.array(data), 1, 0))


def lengths_differ(column: str | Column) -> Column:
    """An aggregate: whether lists differ in length."""
    c = F.col(column) if isinstance(column, str) else column
    return F.max(F.size(c)) > F.min(F.size(c))


def is_ragged(df: DataFrame, column: str) -> bool:
    """Whether the lists of a column differ in length at any level."""
    level, kind = F.col(column), df.schema[column].dataType
    cells = df.select(level.alias("c"))
    while kind.typeName() == "array":
        if cells.agg(lengths_differ("c").alias("r")).first()["r"]:
            return True
        cells, kind = cells.select(F.explode("c").alias("c")), kind.elementType
    return False


def elements_of(df: DataFrame, column: str) -> DataFrame:
    """(code, element): distinct values in sorted order, coded from 0."""
    distinct = df.select(F.col(column).alias("element")).where("element is not null").distinct()
    return position.number(distinct, "element", name="code")


def grow_elements(elements: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Elements with those of `new` that they lack, coded on in order of first appearance (_pos)."""
    first = new.groupBy(F.col(column).alias("element")).agg(F.min(POS).alias("first")).where("element is not null")
    lacking = first.join(elements, "element", "left_anti")
    base = elements.agg(F.coalesce(F.max("code") + 1, F.lit(0)).alias("base"))  # one row
    coded = position.number_sparse(lacking, "first", name="k").crossJoin(F.broadcast(base))
    return elements.unionByName(coded.select((F.col("base") + F.col("k")).alias("code"), "element"))


def enum_encode(df: DataFrame, column: str, elements: DataFrame) -> DataFrame:
    """Adds `<column>_code`; values outside the elements get null."""
    return df.join(elements.select(F.col("element").alias(column), F.col("code").alias(f"{column}_code")), column, "left")


def enum_decode(df: DataFrame, code: str, elements: DataFrame, out: str) -> DataFrame:
    return df.join(elements.select(F.col("code").alias(code), F.col("element").alias(out)), code, "left")


def enum_join(df: DataFrame, column: str, *by: str) -> DataFrame:
    """The selected elements as one string, in row order, by group."""
    return df.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(POS, column))), lambda x: x[column]), "").alias("joined"))


def code_width(n_elements: int) -> int:
    """Bits of the narrowest unsigned code for so many elements."""
    return next((b for b in (8, 16, 32, 64) if n_elements <= 1 << b), 64)


def code_widths(df: DataFrame, *columns: str) -> DataFrame:
    """(column, n_elements, bits): how wide the codes of enumerated columns have to be; one pass."""
    counts = df.agg(*[F.count_distinct(c).alias(f"_{i}") for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("n_elements")) for i, c in enumerate(columns)]
    n = F.col("n_elements")
    bits = F.when(n <= 1 << 8, 8).when(n <= 1 << 16, 16).when(n <= 1 << 32, 32).otherwise(64)
    return counts.select(F.inline(F.array(*rows))).withColumn("bits", bits)
