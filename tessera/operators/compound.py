"""References inside data: compound rows with fields that refer to nodes, and regions of datasets.

An object reference is a node id; a region reference is a struct (node_id, positions). Both are
resolved by equi-joins, so that rows of any number meet nodes or data of any number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.position import POS


def object_references(rows: DataFrame, nodes: DataFrame, path_col: str, out: str) -> DataFrame:
    """Adds `out`, the node id of each row's path; null where no node stands there."""
    target = nodes.select(F.col("path").alias(path_col), F.col("node_id").alias(out))
    return rows.join(target, path_col, "left")


def region_references(rows: DataFrame, nodes: DataFrame, path_col: str, positions_col: str, out: str) -> DataFrame:
    """Adds `out`, a region reference to positions of the dataset at each row's path; null where the path
    is not that of a dataset."""
    target = nodes.where("kind = 'dataset'").select(F.col("path").alias(path_col), F.col("node_id").alias("_node"))
    region = F.struct(F.col("_node").alias("node_id"), F.col(positions_col).alias("positions"))
    return rows.join(target, path_col, "left").withColumn(out, F.when(F.col("_node").isNotNull(), region)).drop("_node")


def resolve_fields(rows: DataFrame, nodes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Compound rows with each of the `fields`, which hold node ids, replaced by a struct (path, data_type)
    of the node; null stays null, and a dangling reference becomes null."""
    out = rows
    for f in fields:
        target = nodes.select(F.col("node_id").alias(f), F.struct("path", "data_type").alias("_target"))
        out = out.join(target, f, "left").drop(f).withColumnRenamed("_target", f)
    return out.select(*rows.columns)


def resolve_regions(refs: DataFrame, data: DataFrame, region_col: str) -> DataFrame:
    """(_pos, _ord, value...) the elements that each region reference of `refs` picks, in the order of its
    positions, repeats kept. `data` holds the elements of datasets: node_id, _pos and values."""
    wanted = refs.select(POS, F.col(f"{region_col}.node_id").alias("node_id"), F.posexplode(f"{region_col}.positions").alias("_ord", "_at"))
    elements = data.withColumnRenamed(POS, "_at")
    return wanted.join(elements, ["node_id", "_at"]).drop("node_id", "_at")


def slice_region(data: DataFrame, node_id: int, positions: Sequence[int]) -> DataFrame:
    """The elements of one dataset at a region's positions, in position order, each once."""
    return data.where((F.col("node_id") == node_id) & F.col(POS).isin(sorted(set(positions))))
