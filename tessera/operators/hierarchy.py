"""Recursive denormalisation of linked tables along the first region column of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.position import POS
from tessera.operators.table import ID, Table

SEPARATOR = "__"


def flatten(table: Table, ids: bool = True) -> DataFrame:
    """One row for each path from a row of `table` to a leaf row.

    Columns are named table__column: ids and columns of every table from the top down, without the
    region columns that were followed. Rows whose region cell is empty have no path and are left
    out. Joins are by position, or by the key of a region that has one; Spark picks broadcast or
    shuffle joins by size.
    """
    out, seen, here = None, set(), POS
    while True:
        if id(table) in seen:
            raise ValueError("the tables link in a circle")
        seen.add(id(table))
        follow = next((c for c in table.foreign_columns if c in table.targets), None)
        by = table.spec(follow).by if follow else None
        names = [c for c in ([ID] if ids and ID in table.df.columns else []) + table.colnames if c != follow]
        rows = table.df.select(*([] if out is None else [F.col(here).alias("_here")]), *[F.col(c).alias(f"{table.name}{SEPARATOR}{c}") for c in names], *([F.col(by[0] if by else follow).alias("_follow")] if follow else []))
        out = rows if out is None else out.join(rows, F.col("_next") == F.col("_here")).drop("_next", "_here")
        if follow is None:
            return out
        out = out.withColumn("_next", F.explode("_follow") if by is None and table.is_ragged(follow) else F.col("_follow")).drop("_follow")
        table, here = table.targets[follow], by[1] if by else POS


def column_path(name: str) -> tuple[str, ...]:
    return tuple(name.split(SEPARATOR))


def drop_id_columns(df: DataFrame) -> DataFrame:
    """Without the columns whose innermost name is `id`."""
    return df.drop(*[c for c in df.columns if column_path(c)[-1] == ID])


def flatten_names(df: DataFrame, max_levels: int | None = None) -> DataFrame:
    """Keeps the innermost `max_levels` parts of each name; clashes are an error."""
    if max_levels is not None and max_levels <= 0:
        raise ValueError("max_levels must be positive")
    names = [SEPARATOR.join(column_path(c)[-max_levels:] if max_levels else column_path(c)) for c in df.columns]
    if len(set(names)) != len(names):
        raise ValueError(f"names clash: {sorted({n for n in names if names.count(n) > 1})}")
    return df.toDF(*names)


def region_of(child: DataFrame, key: str, order: Sequence[str], child_pos: str, name: str) -> DataFrame:
    """(key, name): for each key the positions of the child rows that have it, in order: a ragged region."""
    if list(order) == [child_pos]:
        return child.groupBy(key).agg(F.sort_array(F.collect_list(child_pos)).alias(name))
    return child.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(child_pos).alias("__p")))), lambda x: x["__p"]).alias(name))
