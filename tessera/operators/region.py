"""Regions: columns of row positions in another table, resolved as ordinary joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.position import POS
from tessera.operators.table import ID, Table


def cells(source: Table, column: str) -> DataFrame:
    """(_pos, _ord, _at): each position that a region cell holds, in its order. A region by key has its
    target's positions in ascending order, numbered by themselves."""
    if by := source.spec(column).by:
        own = source.df.select(POS, F.col(by[0]).alias("_key"))
        target = source.targets[column].df.select(F.col(by[1]).alias("_key"), F.col(POS).alias("_at"))
        return own.join(target, "_key").select(POS, F.col("_at").alias("_ord"), "_at")
    if source.is_ragged(column):
        return source.df.select(POS, F.posexplode(column).alias("_ord", "_at"))
    return source.df.select(POS, F.lit(0).alias("_ord"), F.col(column).alias("_at"))


def resolve(source: Table, column: str, how: str = "inner") -> DataFrame:
    """Each source row with the target row that its region cell points to; columns are
    `source__name` and `target__name`. A ragged cell gives a row for each position, in `_ord`."""
    target = source.targets[column]
    left = source.df
    if source.spec(column).by:
        left = left.join(cells(source, column), POS)
    elif source.is_ragged(column):
        left = left.select("*", F.posexplode(column).alias("_ord", "_at"))
    else:
        left = left.select("*", F.lit(0).alias("_ord"), F.col(column).alias("_at"))
    left = left.select(F.col(POS), "_ord", "_at", *[F.col(c).alias(f"{source.name}__{c}") for c in [ID, *source.colnames] if c != column])
    right = target.df.select(F.col(POS).alias("_target"), *[F.col(c).alias(f"{target.name}__{c}") for c in [ID, *target.colnames]])
    return left.join(right, F.col("_at") == F.col("_target"), how).drop("_target", "_at")


def nest(source: Table, column: str) -> DataFrame:
    """The source rows with each region cell replaced by an array of target row structs, in cell order.
    An empty cell stays an empty array."""
    target = source.targets[column]
    rows = target.df.select(F.col(POS).alias("_target"), F.struct(ID, *target.colnames).alias("_row"))
    nested = cells(source, column).join(rows, F.col("_at") == F.col("_target")).groupBy(POS).agg(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "_row"))), lambda x: x["_row"]).alias("_rows"))
    kind = nested.schema["_rows"].dataType
    joined = source.df.join(nested, POS, "left")
    return joined.withColumn(column, F.coalesce("_rows", F.array().cast(kind))).drop("_rows")


def nest_all(source: Table) -> DataFrame:
    """`nest` for all bound region columns, recursively."""
    out = source
    for column in source.foreign_columns:
        if column in source.targets:
            target = source.targets[column]
            inner = Table(target.name, nest_all(target), target.columns, target.description)
            bound = Table(out.name, out.df, out.columns, out.description, {**out.targets, column: inner})
            out = Table(out.name, nest(bound, column), out.columns, out.description, out.targets)
    return out.df


def gather(source: Table, column: str) -> DataFrame:
    """All target rows that a region column refers to, in reference order (`_src`, `_ord`), repeats kept."""
    target = source.targets[column]
    refs = cells(source, column).withColumnRenamed(POS, "_src")
    return refs.join(target.df, F.col("_at") == F.col(POS)).drop("_at", POS)


def dangling(source: Table, column: str) -> DataFrame:
    """References to rows that the target doesn't have."""
    return cells(source, column).select(POS, "_at").join(source.targets[column].df.select(F.col(POS).alias("_at")), "_at", "left_anti")


def shape(source: Table, column: str) -> tuple[int, int]:
    """How many references the column has, and how many columns its target has."""
    return cells(source, column).count(), len(source.targets[column].colnames)


def linked_tables(start: Table, *others: Table) -> list[tuple[str, str, str]]:
    """All (source table, column, target table) links reachable from the start, breadth first; cycles end."""
    seen, queue, out = set(), [start, *others], []
    while queue:
        table = queue.pop(0)
        if id(table) in seen:
            continue
        seen.add(id(table))
        for column in table.foreign_columns:
            if column in table.targets:
                out.append((table.name, column, table.targets[column].name))
                queue.append(table.targets[column])
    return out
