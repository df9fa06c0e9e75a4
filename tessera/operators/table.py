"""Dynamic tables: a DataFrame of `_pos`, `id` and columns, with a spec of what the columns are."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from tessera.operators import position
from tessera.operators.position import POS

ID = "id"


@dataclass(frozen=True)
class ColumnSpec:
    """What a column is: plain data, a region (positions of rows of `target`), or an enumeration.

    A region `by` (own column, target's column) holds no positions: a row's cell is the target rows
    whose column has the value of its own, so that no list grows with the number of children.
    """

    name: str
    description: str = ""
    kind: str = "data"  # data, region or enum
    target: str | None = None
    vocabulary: object | None = None
    by: tuple[str, str] | None = None

    @property
    def metadata(self) -> dict:
        return {"description": self.description, "kind": self.kind, **({"target": self.target} if self.target else {})}


@dataclass(frozen=True)
class Table:
    """A named table. Columns are in order; `id` and `_pos` stand before them."""

    name: str
    df: DataFrame
    columns: tuple[ColumnSpec, ...]
    description: str = ""
    targets: dict[str, Table] = field(default_factory=dict)

    # construction

    @classmethod
    def from_frame(cls, name: str, df: DataFrame, id_col: str | None = None, pos_col: str | None = None, order: Sequence[str] = (), columns: Sequence[ColumnSpec] | None = None, description: str = "") -> Table:
        """A table from any DataFrame. Positions come from `pos_col` (0..n-1) or from `order`;
        ids from `id_col`, or else they are the positions."""
        if pos_col is None and not order:
            raise ValueError("a table needs pos_col or order: DataFrames have no order of their own")
        if POS not in df.columns:
            df = position.from_key(df, pos_col) if pos_col else position.number(df, *order)
        data = [c for c in df.columns if c not in (POS, ID, id_col)]
        ids = F.col(id_col) if id_col else F.col(ID) if ID in df.columns else F.col(POS)
        specs = {c.name: c for c in columns or ()}
        unknown = set(specs) - set(data)
        if unknown:
            raise ValueError(f"columns {sorted(unknown)} aren't in the data")
        ordered = [c.name for c in columns or ()] + [c for c in data if c not in specs]
        specs = tuple(specs.get(c, ColumnSpec(c)) for c in ordered)
        picked = [F.col(s.name).alias(s.name, metadata=s.metadata) for s in specs]
        return cls(name, df.select(POS, ids.cast("long").alias(ID), *picked), specs, description)

    @classmethod
    def from_columns(cls, name: str, columns: Sequence[tuple[ColumnSpec, DataFrame]], ids: DataFrame | None = None) -> Table:
        """A table from columns, each a DataFrame (_pos, value); all must have the same length."""
        names = [c.name for c, _ in columns]
        if len(set(names)) != len(names):
            raise ValueError("duplicate column names")
        lengths = {n: d.count() for n, (_, d) in zip(names, columns)}
        if len(set(lengths.values())) > 1:
            raise ValueError(f"columns differ in length: {lengths}")
        base = ids.select(POS, F.col("value").alias(ID)) if ids is not None else columns[0][1].select(POS, F.col(POS).alias(ID))
        if ids is not None and ids.count() != next(iter(lengths.values()), ids.count()):
            raise ValueError("ids and columns differ in length")
        for c, d in columns:
            base = base.join(d.select(POS, F.col("value").alias(c.name, metadata=c.metadata)), POS)
        return cls(name, base, tuple(c for c, _ in columns))

    def with_children(self, target: Table, own: str, key: str, name: str | None = None) -> Table:
        """With a region of the target rows whose `key` has the value of this table's `own` column."""
        name = name or target.name
        if name in self or name in self.targets:
            raise ValueError(f"{name} is already there")
        spec = ColumnSpec(name, kind="region", target=target.name, by=(own, key))
        return replace(self, columns=(*self.columns, spec), targets={**self.targets, name: target})

    @classmethod
    def predefined(cls, spark: SparkSession, name: str, spec) -> tuple[Table, list[str]]:
        """An empty table of a resolved table type: columns for its required datasets, and the names of the
        optional ones, which come when they are first used."""
        from tessera.plans.spec import compile_schema

        schema = compile_schema(spec)
        wanted = {c.name: c.required for c in spec.children if c.kind == "dataset" and c.name}
        fields = [f for f in schema.fields if wanted[f.name]]
        df = spark.createDataFrame([], StructType([StructField(POS, LongType()), StructField(ID, LongType()), *fields]))
        return cls(name, df, tuple(ColumnSpec(f.name, f.metadata.get("description", "")) for f in fields)), [n for n, r in wanted.items() if not r]

    # what the table has

    @property
    def colnames(self) -> list[str]:
        return [c.name for c in self.columns if c.by is None]

    def __contains__(self, name: str) -> bool:
        return name in self.colnames

    def __len__(self) -> int:
        return self.df.count()

    def spec(self, name: str) -> ColumnSpec:
        for c in self.columns:
            if c.name == name:
                return c
        raise KeyError(name)

    def reorder(self, names: Sequence[str]) -> Table:
        if sorted(names) != sorted(self.colnames):
            raise ValueError("names must be those of the table")
        return replace(self, df=self.df.select(POS, ID, *names), columns=(*(self.spec(n) for n in names), *(c for c in self.columns if c.by)))

    def bind(self, **targets: Table) -> Table:
        """Sets the tables that region columns point to; one that is set can't be changed."""
        held = dict(self.targets)
        for column, table in targets.items():
            if self.spec(column).kind != "region":
                raise ValueError(f"{column} isn't a region column")
            if column in held and held[column] is not table:
                raise ValueError(f"{column} already points to {held[column].name}")
            held[column] = table
        return replace(self, targets=held)

    @property
    def foreign_columns(self) -> list[str]:
        return [c.name for c in self.columns if c.kind == "region"]

    # selection

    def __getitem__(self, key) -> DataFrame:
        """Column by name; rows by position, slice, list of positions, boolean Column; cell by (row, column)."""
        if isinstance(key, str):
            return self.column(key)
        if isinstance(key, tuple):
            rows, col = key
            name = ([ID, *self.colnames][col]) if isinstance(col, int) else col
            picked = self.rows(rows)
            return picked.select(*([c for c in ("_ord", POS) if c in picked.columns]), name)
        return self.rows(key)

    def column(self, name: str) -> DataFrame:
        if name != ID and name not in self:
            raise KeyError(name)
        return self.df.select(POS, name)

    def rows(self, key) -> DataFrame:
        """The rows that a key picks. A list keeps its order and repeats in `_ord`."""
        if isinstance(key, bool) or isinstance(key, float):
            raise KeyError(key)
        if isinstance(key, int):
            at = position.normalise(key, len(self)) if key < 0 else key
            found = self.df.where(F.col(POS) == at)
            if found.isEmpty():
                raise IndexError(f"Row index {key} out of range for {self.name}")
            return found
        if isinstance(key, slice):
            return self.slice(key)
        if isinstance(key, Column):
            return self.df.where(key)
        if isinstance(key, DataFrame):
            return self.df.join(key.select(POS), POS, "left_semi")
        if isinstance(key, Iterable):
            key = list(key)
            if key and all(isinstance(k, bool) for k in key):
                key = [i for i, k in enumerate(key) if k]
            if any(isinstance(k, (list, tuple)) for k in key):
                raise ValueError("only lists of one dimension pick rows")
            return self.gather([position.normalise(k, len(self)) if k < 0 else k for k in key])
        raise KeyError(key)

    def slice(self, key: slice) -> DataFrame:
        start, stop, step = key.indices(len(self)) if key.start is not None and key.start < 0 or key.stop is None or key.stop < 0 or (key.step or 1) < 0 else (key.start or 0, key.stop, key.step or 1)
        pos = F.col(POS)
        if step > 0:
            return self.df.where((pos >= start) & (pos < stop) & (F.pmod(pos - start, F.lit(step)) == 0))
        return self.df.where((pos <= start) & (pos > stop) & (F.pmod(F.lit(start) - pos, F.lit(-step)) == 0))

    def gather(self, positions: Sequence[int]) -> DataFrame:
        """Rows at the positions, in their order (`_ord`), as often as they are named."""
        spark = self.df.sparkSession
        wanted = spark.createDataFrame(list(enumerate(positions)), "_ord long, _at long") if positions else spark.createDataFrame([], "_ord long, _at long")
        return wanted.join(self.df, F.col("_at") == F.col(POS)).drop("_at")

    def find_ids(self, ids: Iterable[int] | int | DataFrame) -> DataFrame:
        """Positions whose id is one of `ids`, in row order, whatever the order or repeats of the probe."""
        return self.where_ids(ids).select(POS)

    def where_ids(self, ids) -> DataFrame:
        if isinstance(ids, DataFrame):
            return self.df.join(ids.select(F.col(ids.columns[0]).alias(ID)), ID, "left_semi").select(self.df.columns)
        values = [ids] if isinstance(ids, int) else list(ids)
        if any(isinstance(v, bool) or not isinstance(v, int) for v in values):
            raise TypeError("ids are integers")
        return self.df.where(F.col(ID).isin(values))

    def to_frame(self, exclude: Iterable[str] = ()) -> DataFrame:
        return self.df.drop(*exclude)

    def get(self, key, nested: bool = False) -> DataFrame:
        """What `[]` gives; `nested` has region cells as arrays of the target's rows."""
        if not nested:
            return self[key]
        from tessera.operators import region

        return replace(self, df=region.nest_all(self), targets={})[key]

    def provenance(self) -> DataFrame:
        """(_pos, source): the file that each row was read from; empty for rows that no file holds."""
        return self.df.select(POS, F.input_file_name().alias("source"))

    def head(self, n: int = 4) -> DataFrame:
        """The first n rows."""
        return self.df.where(F.col(POS) < n)

    def summary(self) -> DataFrame:
        """(place, column, kind, n_rows, n_null): one row a column, in order, `id` first."""
        names = [ID, *self.colnames]
        counts = self.df.agg(F.count(F.lit(1)).alias("n"), *[F.count(F.col(c)).alias(f"_{i}") for i, c in enumerate(names)])
        rows = [F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.lit("id" if i == 0 else self.spec(c).kind).alias("kind"), F.col("n").alias("n_rows"), (F.col("n") - F.col(f"_{i}")).alias("n_null")) for i, c in enumerate(names)]
        return counts.select(F.inline(F.array(*rows)))

    def preview(self, n: int = 4) -> tuple[list, str]:
        """The first n rows, and how many more there are."""
        rows = self.head(n).orderBy(POS).collect()
        more = len(self) - len(rows)
        return rows, "" if more <= 0 else "... and 1 more row." if more == 1 else f"... and {more} more rows."

    def preview_html(self, n: int = 4) -> str:
        rows, more = self.preview(n)
        head = "".join(f"<th>{c}</th>" for c in [ID, *self.colnames])
        body = "".join("<tr>" + "".join(f"<td>{r[c]}</td>" for c in [ID, *self.colnames]) + "</tr>" for r in rows)
        return f"<table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table>" + (f"<p>{more}</p>" if more else "")

    # mutation: each gives a new table

    def add_rows(self, rows: DataFrame, order: Sequence[str] = (), unique_ids: bool = False) -> Table:
        """Appends rows after the last; ids default to positions. All columns must be there, and no others."""
        missing, extra = set(self.colnames) - set(rows.columns), set(rows.columns) - {*self.colnames, ID, POS}
        if missing or extra:
            raise ValueError(f"row data don't match: missing {sorted(missing)}, extra {sorted(extra)}")
        n = len(self)
        rows = rows if POS in rows.columns else position.number(rows, *(order or rows.columns[:1]))
        rows = rows.withColumn(POS, F.col(POS) + n)
        if ID not in rows.columns:
            rows = rows.withColumn(ID, F.col(POS))
        checked = {c.name: c.vocabulary.missing(rows.select(F.col(c.name).alias("term"))) for c in self.columns if c.vocabulary is not None}
        if bad := {name: terms for name, terms in checked.items() if terms}:
            raise ValueError(f"not in the vocabulary: {bad}")  # all columns at once
        out = replace(self, df=self.df.unionByName(rows.select(self.df.columns)))
        if unique_ids and not out.repeated_ids().isEmpty():
            raise ValueError("ids aren't unique")
        return out

    def repeated_ids(self) -> DataFrame:
        return self.df.groupBy(ID).agg(F.count(F.lit(1)).alias("n")).where("n > 1")

    def add_column(self, spec: ColumnSpec, values: DataFrame | Column, check_length: bool = True) -> Table:
        """Adds a column: an expression over the others, or a DataFrame (_pos, value) of equal length."""
        if spec.name in self or spec.name in (ID, POS):
            raise ValueError(f"column {spec.name} already exists")
        if isinstance(values, Column):
            df = self.df.withColumn(spec.name, values)
        else:
            if check_length and values.count() != len(self):
                raise ValueError("column must have the same number of rows as the table")
            df = self.df.join(values.select(POS, F.col("value").alias(spec.name)), POS)
        return replace(self, df=df.withMetadata(spec.name, spec.metadata), columns=(*self.columns, spec))

    def add_ragged_column(self, spec: ColumnSpec, flat: DataFrame, ends: DataFrame) -> Table:
        """Adds a column of lists from flat (_pos, value) data and end offsets (_pos, end)."""
        from tessera.operators import ragged

        return self.add_column(spec, ragged.decode(flat, ends))

    def create_region(self, positions: Sequence[int] | slice) -> Column:
        """A literal region of this table's rows; positions are checked."""
        n = len(self)
        at = list(range(*positions.indices(n))) if isinstance(positions, slice) else list(positions)
        if any(not 0 <= p < n for p in at):
            raise IndexError("region out of range")
        return F.array([F.lit(p).cast("long") for p in at]) if at else F.array().cast("array<long>")

    def equals(self, other: Table) -> bool:
        """Same name, description, columns and rows (NaN equals NaN), ids and order included."""
        if (self.name, self.description, self.colnames) != (other.name, other.description, other.colnames):
            return False
        left, right = self.df, other.df.select(self.df.columns)
        return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()

    def is_ragged(self, name: str) -> bool:
        return self.spec(name).by is not None or isinstance(self.df.schema[name].dataType, ArrayType)


def table_of(spark: SparkSession, name: str, rows: list, schema: str, **options) -> Table:
    """A small table from Python rows in their order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{POS} long, {schema}")
    return Table.from_frame(name, df, pos_col=POS, **options)
