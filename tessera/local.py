"""Small tables from driver values: schemas, closures, configurations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_ARROW = {"string": pa.string(), "integer": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def small_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows as a local relation, whose size Spark knows, so that joins broadcast it without being told.
    `schema` has strings, whole numbers, doubles and booleans, or lists of them."""
    fields = StructType.fromDDL(schema)
    kinds = [pa.list_(_ARROW[f.dataType.elementType.typeName()]) if f.dataType.typeName() == "array" else _ARROW[f.dataType.typeName()] for f in fields]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=fields.names), fields)
