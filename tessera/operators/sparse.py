"""Sparse matrices as (row, col, value), and their compressed-row form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import ragged
from tessera.operators.position import POS


def from_dense(df: DataFrame, column: str) -> DataFrame:
    """(row, col, value) of the non-zero cells of rows held as arrays."""
    cells = df.select(F.col(POS).alias("row"), F.posexplode(column).alias("col", "value"))
    return cells.where("value <> 0").select("row", F.col("col").cast("long").alias("col"), "value")


def csr_rows(cells: DataFrame, n_rows: int) -> DataFrame:
    """(_pos, indices, data, indptr_end) of every row, empty ones included; indptr is 0 and these ends."""
    lists = cells.groupBy(F.col("row").alias(POS)).agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("_c"))
    rows = cells.sparkSession.range(n_rows).select(F.col("id").alias(POS)).join(lists, POS, "left")
    rows = rows.select(POS, F.coalesce(F.transform("_c", lambda x: x["col"]), F.array().cast("array<long>")).alias("indices"), F.transform("_c", lambda x: x["value"]).alias("data"))
    return rows.join(ragged.ends(rows, "indices"), POS).withColumnRenamed("end", "indptr_end")


def to_cells(rows: DataFrame) -> DataFrame:
    return rows.select(F.col(POS).alias("row"), F.explode(F.arrays_zip("indices", "data")).alias("x")).select("row", F.col("x.indices").alias("col"), F.col("x.data").alias("value"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two sparse matrices: one equi-join and one aggregation."""
    left = a.select("row", F.col("col").alias("k"), F.col("value").alias("x"))
    right = b.select(F.col("row").alias("k"), "col", F.col("value").alias("y"))
    return left.join(right, "k").groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("value"))
