"""Controlled vocabularies: terms with ids and meanings, and checks of data against them."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.local import small_frame

#: A vocabulary up to this size is broadcast; a larger one is joined by shuffle.
BROADCAST_TERMS = 100_000


@dataclass(frozen=True)
class Vocabulary:
    """`terms` has (term, id, description, meaning); `prefixes` maps a prefix to its reference."""

    name: str
    terms: DataFrame
    prefixes: dict[str, str]
    size: int

    @classmethod
    def from_rows(cls, spark: SparkSession, name: str, rows: list[tuple], prefixes: dict[str, str] | None = None) -> Vocabulary:
        return cls(name, small_frame(spark, rows, "term string, id string, description string, meaning string"), prefixes or {}, len(rows))

    @classmethod
    def from_frame(cls, name: str, terms: DataFrame, prefixes: dict[str, str] | None = None) -> Vocabulary:
        return cls(name, terms, prefixes or {}, terms.count())

    @classmethod
    def from_yaml(cls, spark: SparkSession, path: str) -> Vocabulary:
        """Reads the first enumeration of a YAML schema (driver-side: a vocabulary file is small)."""
        import yaml

        doc = yaml.safe_load(Path(path).read_text())
        prefixes = {k: v["prefix_reference"] if isinstance(v, dict) else v for k, v in (doc.get("prefixes") or {}).items()}
        name, enum = next(iter(doc["enums"].items()))
        rows = [(t, (v or {}).get("meaning", "").split(":", 1)[-1] if v else "", (v or {}).get("description"), (v or {}).get("meaning")) for t, v in (enum.get("permissible_values") or {}).items()]
        return cls.from_rows(spark, name, rows, prefixes)

    @classmethod
    def from_sheets(cls, spark: SparkSession, folder: str) -> Vocabulary:
        """Reads schema sheets (tab-separated, second row starts with '>') through Spark."""
        read = lambda n: spark.read.csv(f"{folder}/{n}.tsv", sep="\t", header=True)
        enums = read("enums")
        first = enums.columns[0]
        rows = enums.where(~F.col(first).startswith(">") & F.col(enums.columns[1]).isNotNull())
        terms = rows.select(F.col(enums.columns[1]).alias("term"), F.regexp_extract(F.col(enums.columns[2]), ":(.*)", 1).alias("id"), F.col(enums.columns[3] if len(enums.columns) > 3 else enums.columns[2]).alias("description"), F.col(enums.columns[2]).alias("meaning"))
        sheet = read("prefixes")
        prefixes = {r[0]: r[1] for r in sheet.where(~F.col(sheet.columns[0]).startswith(">")).collect()}
        return cls.from_frame(Path(folder).name, terms, prefixes)

    def _side(self, df: DataFrame) -> DataFrame:
        return F.broadcast(df) if self.size <= BROADCAST_TERMS else df

    def lookup(self, df: DataFrame, column: str, how: str = "inner") -> DataFrame:
        """Rows with the id, description and uri of their term."""
        prefix, local = F.split("meaning", ":", 2)[0], F.get(F.split("meaning", ":", 2), F.lit(1))
        refs = F.create_map(*[F.lit(x) for kv in self.prefixes.items() for x in kv]) if self.prefixes else None
        uri = F.concat(F.try_element_at(refs, prefix), local) if refs is not None else F.lit(None).cast("string")
        terms = self.terms.select(F.col("term").alias(column), F.col("id").alias("term_id"), F.col("description").alias("term_description"), uri.alias("term_uri"))
        return df.join(self._side(terms), column, how)

    def violations(self, df: DataFrame, column: str) -> DataFrame:
        """Rows whose value isn't a term."""
        return df.join(self._side(self.terms.select(F.col("term").alias(column))), column, "left_anti")

    def missing(self, df: DataFrame, column: str = "term", limit: int = 100) -> list:
        """Distinct values that aren't terms, sorted; up to `limit` for an error message."""
        return [r[0] for r in self.violations(df, column).select(column).distinct().orderBy(column).limit(limit).collect()]

    def validate(self, term: str) -> bool:
        return not self.terms.where(F.col("term") == term).isEmpty()

    def __getitem__(self, term: str):
        row = self.lookup(self.terms.where(F.col("term") == term).select("term"), "term").first()
        if row is None:
            raise ValueError(f"{term} isn't in the vocabulary")
        return row["term_id"], row["term_description"], row["term_uri"]

    def preview(self) -> list[str]:
        """The first three terms and the last if there are more than four, else all."""
        terms = [r[0] for r in self.terms.select("term").limit(4).collect()]
        if self.size <= 4:
            return terms
        return [*terms[:3], "...", self.terms.select("term").tail(1)[0][0]]


@dataclass(frozen=True)
class Checked:
    """A column whose values are, and stay, terms of a vocabulary."""

    vocabulary: Vocabulary
    df: DataFrame
    column: str

    @classmethod
    def of(cls, vocabulary: Vocabulary, df: DataFrame, column: str) -> Checked:
        bad = vocabulary.missing(df, column)
        if bad:
            raise ValueError(f"{bad} aren't in the vocabulary {vocabulary.name}")
        return cls(vocabulary, df, column)

    def extend(self, more: DataFrame) -> Checked:
        """Checks only what is added."""
        return Checked(self.vocabulary, self.df.unionByName(Checked.of(self.vocabulary, more, self.column).df), self.column)


def rules(config: dict) -> list[tuple[str, str, str, str]]:
    """(namespace, data type, field, vocabulary path) of a configuration; later files override earlier ones."""
    return [(ns, dt, f, path) for ns, types in config["namespaces"].items() for dt, fields in types["data_types"].items() for f, path in fields.items()]


def merge_config(*configs: dict) -> dict:
    out: dict = {"namespaces": {}}
    for c in configs:
        for ns, types in c["namespaces"].items():
            held = out["namespaces"].setdefault(ns, {"data_types": {}})["data_types"]
            held.update(types["data_types"])
    return out


def check_configured(cells: DataFrame, config: dict, vocabularies: dict[str, Vocabulary]) -> tuple[DataFrame, DataFrame]:
    """Checks values by a configuration: `cells` has (namespace, data_type, field, value) among its columns.

    Returns the cells whose value isn't a term of the vocabulary that the configuration names for their
    field, and (namespace, data_type) of cells that it says nothing of, which deserve a warning.
    """
    spark = cells.sparkSession
    found = F.broadcast(small_frame(spark, rules(config), "namespace string, data_type string, field string, _vocabulary string"))  # the size of the configuration
    known = found.select("namespace", "data_type").distinct()
    governed = cells.join(found, ["namespace", "data_type", "field"])
    bad = [v.violations(governed.where(F.col("_vocabulary") == path), "value") for path, v in vocabularies.items()]
    out = bad[0].select(cells.columns) if bad else cells.limit(0)
    for b in bad[1:]:
        out = out.unionByName(b.select(cells.columns))
    return out, cells.select("namespace", "data_type").distinct().join(known, ["namespace", "data_type"], "left_anti")
