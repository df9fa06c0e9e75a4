"""Aligned tables: a main table and category tables of the same rows, as one wide DataFrame with a
struct for each category. Categories cost a join on position once, when they are added."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import position
from tessera.operators.position import POS
from tessera.operators.table import ID, Table


@dataclass(frozen=True)
class AlignedTable:
    main: Table
    df: DataFrame
    categories: tuple[Table, ...] = ()

    @classmethod
    def of(cls, main: Table, *categories: Table) -> AlignedTable:
        out = cls(main, main.df)
        for c in categories:
            out = out.add_category(c)
        return out

    @property
    def name(self) -> str:
        return self.main.name

    @property
    def category_names(self) -> list[str]:
        return [c.name for c in self.categories]

    def add_category(self, table: Table) -> AlignedTable:
        """Adds a category of equal length. Aligned tables can't be nested, names can't repeat."""
        if not isinstance(table, Table):
            raise ValueError("a category is a plain table")
        if table.name in self.category_names or table.name == self.name or table.name in self.main:
            raise ValueError(f"{table.name} is already there")
        if table.df.count() != self.df.count():
            raise ValueError("a category must have the rows of the main table")
        cells = table.df.select(F.col(POS).alias("_p"), F.struct(ID, *table.colnames).alias(table.name))
        return replace(self, df=self.df.join(cells, F.col(POS) == F.col("_p")).drop("_p"), categories=(*self.categories, table))

    def add_rows(self, main: DataFrame, unique_ids: bool = False, **categories: DataFrame) -> AlignedTable:
        """Appends rows to the main table and all categories alike; `categories` has one DataFrame each."""
        if set(categories) != set(self.category_names):
            raise ValueError(f"rows are needed for each of {self.category_names}")
        return AlignedTable.of(self.main.add_rows(main, unique_ids=unique_ids), *(c.add_rows(categories[c.name], unique_ids=unique_ids) for c in self.categories))

    def category(self, name: str | None = None) -> DataFrame:
        if name is None or name == self.name:
            return self.df.select(POS, ID, *self.main.colnames)
        if name not in self.category_names:
            raise KeyError(name)
        return self.df.select(POS, f"{name}.*")

    def __contains__(self, key) -> bool:
        if isinstance(key, str):
            return key in self.category_names
        if len(key) != 2:
            raise ValueError("(category, column) has two parts")
        name, col = key
        table = self.main if name in (None, self.name) else next((c for c in self.categories if c.name == name), None)
        return table is not None and col in table

    def colnames(self, categories: bool = True, ignore_ids: bool = False) -> list[tuple[str, str]]:
        out = [(self.name, c) for c in self.main.colnames]
        for t in self.categories if categories else ():
            out += [(t.name, c) for c in ([] if ignore_ids else [ID]) + t.colnames]
        return out

    def to_frame(self, ignore_ids: bool = False) -> DataFrame:
        """All columns side by side, named category__column."""
        cols = [F.col(POS), F.col(ID).alias(f"{self.name}__{ID}")]
        cols += [F.col(c).alias(f"{self.name}__{c}") for c in self.main.colnames]
        for t in self.categories:
            cols += [F.col(t.name)[c].alias(f"{t.name}__{c}") for c in ([] if ignore_ids else [ID]) + t.colnames]
        return self.df.select(*cols)

    def get(self, *key) -> DataFrame:
        """(rows), (column), (category), (category, column), (row, category), (row, category, column);
        a category of None or the table's own name is the main table. Order of row and category is free."""
        if not key:
            raise ValueError("an empty key picks nothing")
        rows = next((k for k in key if not isinstance(k, str) and k is not None and not isinstance(k, tuple)), None)
        names = [k for part in key for k in (part if isinstance(part, tuple) else (part,)) if isinstance(k, str) or k is None]
        df = self._rows(rows) if rows is not None else self.df
        if not names:
            return replace(self, df=df).to_frame()
        if len(names) == 1:
            if names[0] is not None and names[0] in self.main:
                return df.select(POS, names[0])
            return replace(self, df=df).category(names[0])
        cell = F.col(names[1]) if names[0] in (None, self.name) else F.col(names[0])[names[1]]
        if names not in ([None, names[1]], [self.name, names[1]]) and names[0] not in self.category_names:
            raise KeyError(names[0])
        return df.select(POS, cell.alias(names[1]))

    def _rows(self, key) -> DataFrame:
        table = Table(self.name, self.df, self.main.columns)
        return table.rows(position.normalise(key, len(table)) if isinstance(key, int) else key)

    @property
    def foreign_columns(self) -> list[tuple[str | None, str]]:
        return [(None, c) for c in self.main.foreign_columns] + [(t.name, c) for t in self.categories for c in t.foreign_columns]

    def linked_tables(self, ignore_categories: bool = False) -> list[tuple[str, str, str]]:
        """All links reachable from the main table, and from the categories unless ignored."""
        from tessera.operators import region

        return region.linked_tables(self.main, *(() if ignore_categories else self.categories))
