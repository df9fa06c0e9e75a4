"""Row tables: a fixed schema, appended to row by row or in bulk."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.position import POS


@dataclass(frozen=True)
class RowTable:
    name: str
    df: DataFrame  # _pos and the columns
    colnames: tuple[str, ...]

    @classmethod
    def empty(cls, spark: SparkSession, name: str, schema: str) -> RowTable:
        fields = StructType.fromDDL(schema)
        return cls(name, spark.createDataFrame([], StructType.fromDDL(f"{POS} long, {schema}")), tuple(fields.names))

    @classmethod
    def from_frame(cls, name: str, df: DataFrame, colnames: tuple[str, ...], extra_ok: bool = False, index: str | None = None) -> RowTable:
        """Columns must be those of the schema; a named index column may stand in for one that is missing."""
        missing = [c for c in colnames if c not in df.columns]
        if len(missing) == 1 and index:
            df, missing = df.withColumnRenamed(index, missing[0]), []
        extra = set(df.columns) - {*colnames, POS}
        if missing or (extra and not extra_ok):
            raise ValueError(f"missing {missing}, extra {sorted(extra)}")
        return cls(name, df.select(POS, *colnames), colnames)

    def add_rows(self, rows: list[dict]) -> RowTable:
        for r in rows:
            if set(r) != set(self.colnames):
                raise ValueError(f"a row has exactly the columns {self.colnames}")
        n = self.df.count()
        values = [(n + i, *(v[POS] if isinstance(v := r[c], Row) else v for c in self.colnames)) for i, r in enumerate(rows)]
        return replace(self, df=self.df.unionByName(self.df.sparkSession.createDataFrame(values, self.df.schema)))

    def which(self, **condition) -> DataFrame:
        """Positions where one column equals a value; null equals null, NaN equals nothing."""
        if len(condition) != 1:
            raise ValueError("exactly one column")
        ((name, value),) = condition.items()
        if name not in self.colnames:
            raise KeyError(name)
        match = F.col(name).eqNullSafe(F.lit(value))
        if self.df.schema[name].dataType.typeName() in ("float", "double"):
            match = match & ~F.isnan(F.coalesce(F.col(name), F.lit(0.0)))
        return self.df.where(match).select(POS)

    def __getitem__(self, key):
        """A row by position; a column by name; a cell by (column, row)."""
        if isinstance(key, str):
            if key not in self.colnames:
                raise KeyError(key)
            return self.df.select(POS, key)
        if isinstance(key, tuple):
            column, row = key
            return self[row][self.colnames[column] if isinstance(column, int) else column]
        row = self.df.where(F.col(POS) == key).first()
        if row is None:
            raise IndexError(key)
        return row

    def __len__(self) -> int:
        return self.df.count()
