"""The external-reference store: which values of which object fields stand for which entities.

Six tables joined by position: keys(key), entities(entity_id, entity_uri), files(file_object_id),
objects(files_idx, object_id, object_type, relative_path, field), object_keys(objects_idx, keys_idx)
and entity_keys(entities_idx, keys_idx). Adding references is a batch upsert made of joins.
"""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lineage import checkpoint
from tessera.local import small_frame
from tessera.operators import position, spread
from tessera.operators.position import POS

SCHEMAS = {
    "keys": "key string",
    "entities": "entity_id string, entity_uri string",
    "files": "file_object_id string",
    "objects": "files_idx long, object_id string, object_type string, relative_path string, field string",
    "object_keys": "objects_idx long, keys_idx long",
    "entity_keys": "entities_idx long, keys_idx long",
}
#: The denormalised columns, in order.
JOINED = ["file_object_id", "objects_idx", "object_id", "files_idx", "object_type", "relative_path", "field", "keys_idx", "key", "entities_idx", "entity_id", "entity_uri"]
LINKS = {"objects": {"files_idx": "files"}, "object_keys": {"objects_idx": "objects", "keys_idx": "keys"}, "entity_keys": {"entities_idx": "entities", "keys_idx": "keys"}}


def _after(size: int, rows: DataFrame) -> DataFrame:
    return rows.withColumn("_new", F.col("_new") + size)


def _side(df: DataFrame) -> DataFrame:
    """Files and entities for a join: while they are few, each has a large part of all rows, which must not meet in one task."""
    return F.broadcast(df) if df.limit(spread.FEW + 1).count() <= spread.FEW else df


@dataclass(frozen=True)
class ReferenceStore:
    keys: DataFrame
    entities: DataFrame
    files: DataFrame
    objects: DataFrame
    object_keys: DataFrame
    entity_keys: DataFrame
    counts: dict[str, int] | None = None  # rows by table, where known

    @classmethod
    def empty(cls, spark: SparkSession) -> ReferenceStore:
        return cls(**{n: small_frame(spark, [], f"{POS} long, {s}") for n, s in SCHEMAS.items()}, counts=dict.fromkeys(SCHEMAS, 0))

    @classmethod
    def from_rows(cls, spark: SparkSession, **rows: list) -> ReferenceStore:
        return cls(**{n: small_frame(spark, [(i, *r) for i, r in enumerate(rows.get(n, []))], f"{POS} long, {s}") for n, s in SCHEMAS.items()})

    def tables(self) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in SCHEMAS}

    # queries

    def joined(self) -> DataFrame:
        """One row for each (object, key, entity), with `_order` and `_order2` for row order; an empty
        store gives an empty result."""
        n = lambda df, pos: df.withColumnRenamed(POS, pos)
        return (
            n(self.object_keys, "_order")
            .join(n(self.objects, "objects_idx"), "objects_idx")
            .join(n(_side(self.files), "files_idx"), "files_idx")
            .join(n(self.entity_keys, "_order2"), "keys_idx")
            .join(n(_side(self.entities), "entities_idx"), "entities_idx")
            .join(n(self.keys, "keys_idx"), "keys_idx")
            .select("_order", "_order2", *JOINED)
        )

    def by_object_type(self, object_type: str, relative_path: str = "", field: str = "", all_instances: bool = False) -> DataFrame:
        rows = self.joined().where(F.col("object_type") == object_type)
        return rows if all_instances else rows.where((F.col("relative_path") == relative_path) & (F.col("field") == field))

    def object_entities(self, object_id: str, relative_path: str = "", field: str = "") -> DataFrame:
        """(entity_id, entity_uri) of an object's field, repeats kept; an unknown object is an error."""
        found = self._object(object_id, relative_path, field)
        if found.isEmpty():
            raise ValueError(f"no object {object_id} {relative_path} {field}")
        links = self.object_keys.join(found.select(F.col(POS).alias("objects_idx")), "objects_idx", "left_semi")
        links = links.select(F.col(POS).alias("_order"), "keys_idx").join(self.entity_keys.withColumnRenamed(POS, "_order2"), "keys_idx")
        return links.join(self.entities.withColumnRenamed(POS, "entities_idx"), "entities_idx").select("_order", "_order2", "entity_id", "entity_uri")

    def _object(self, object_id, relative_path, field) -> DataFrame:
        return self.objects.where((F.col("object_id") == object_id) & (F.col("relative_path") == relative_path) & (F.col("field") == field))

    def find_key(self, key: str, object_id: str | None = None, relative_path: str = "", field: str = "") -> DataFrame:
        """The key rows of a text, of one object if given; none is an error."""
        found = self.keys.where(F.col("key") == key)
        if object_id is not None:
            own = self.object_keys.join(self._object(object_id, relative_path, field).select(F.col(POS).alias("objects_idx")), "objects_idx", "left_semi")
            found = found.join(own.select(F.col("keys_idx").alias(POS)), POS, "left_semi")
        if found.isEmpty():
            raise ValueError(f"no key {key}")
        return found

    def find_entity(self, entity_id: str):
        """The first entity of an id, or None."""
        return self.entities.where(F.col("entity_id") == entity_id).orderBy(POS).first()

    # upsert

    def add(self, refs: DataFrame) -> ReferenceStore:
        """Upserts references (file_object_id, object_id, object_type, relative_path, field, key,
        entity_id, entity_uri), in the order of their `_pos`.

        Files, objects and entities are made once. A key text is reused within its object, and new for
        another object even if the text exists there. An entity that is new needs a uri; one that is
        known keeps its own. Links are made once.
        """
        names = ("file_object_id", "object_id", "object_type", "relative_path", "field", "key", "entity_id")
        refs = refs.select(POS, "entity_uri", *[F.coalesce(F.col(c), F.lit("")).alias(c) if c in ("relative_path", "field") else F.col(c) for c in names])
        # repeats are folded first; all that follows is about distinct references
        refs = checkpoint(refs.groupBy(*names).agg(F.min_by("entity_uri", POS).alias("entity_uri"), F.min(POS).alias(POS)))
        sizes = self.sizes() | {"refs": refs.count()}
        entities = checkpoint(self._upsert(sizes, "entities", refs, ["entity_id"], ["entity_uri"]))
        if not entities.where("entity_uri is null").isEmpty():
            raise ValueError("New entities must have an entity_uri.")
        files = checkpoint(self._upsert(sizes, "files", refs, ["file_object_id"], []))
        place = ["object_id", "relative_path", "field"]
        with_file = refs.join(_side(files).select(F.col(POS).alias("files_idx"), "file_object_id"), "file_object_id")
        objects = self._upsert(sizes, "objects", with_file, place, ["files_idx", "object_type"])
        at_object = refs.join(objects.select(F.col(POS).alias("objects_idx"), *place), place)
        known = self.object_keys.join(self.keys.withColumnRenamed(POS, "keys_idx"), "keys_idx").groupBy("objects_idx", "key").agg(F.min("keys_idx").alias("keys_idx"))
        firsts = at_object.groupBy("objects_idx", "key").agg(F.min(POS).alias(POS)).join(known.select("objects_idx", "key"), ["objects_idx", "key"], "left_anti")
        fresh = _after(sizes["keys"], position.number_sparse(firsts, POS, name="_new", most=sizes["refs"]))
        keys = self.keys.unionByName(fresh.select(F.col("_new").alias(POS), "key"))
        resolved = known.unionByName(fresh.select("objects_idx", "key", F.col("_new").alias("keys_idx")))
        linked = checkpoint(at_object.join(resolved, ["objects_idx", "key"]).join(_side(entities).select(F.col(POS).alias("entities_idx"), "entity_id"), "entity_id").select(POS, "objects_idx", "keys_idx", "entities_idx"))
        return replace(self, keys=keys, entities=entities, files=files, objects=objects, object_keys=self._upsert(sizes, "object_keys", linked, ["objects_idx", "keys_idx"], []), entity_keys=self._upsert(sizes, "entity_keys", linked, ["entities_idx", "keys_idx"], []), counts=None)

    def settled(self) -> ReferenceStore:
        """The same with its tables written to the shared folder: for a store that is added to many times."""
        return replace(self, **{n: checkpoint(df) for n, df in self.tables().items()})

    def sizes(self) -> dict[str, int]:
        """The number of rows of each table, in one job."""
        if self.counts is not None:
            return self.counts
        counts = [df.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, df in self.tables().items()]
        return dict(map(tuple, reduce(DataFrame.union, counts).collect()))

    def _upsert(self, sizes: dict[str, int], name: str, rows: DataFrame, key: list[str], rest: list[str]) -> DataFrame:
        """The table with the first row of each key that it lacks, numbered on in order."""
        held = getattr(self, name)
        first = rows.groupBy(*key).agg(F.min(POS).alias(POS), *[F.min_by(c, POS).alias(c) for c in rest])
        lacking = position.number_sparse(first.join(held.select(*key), key, "left_anti"), POS, name="_new", most=sizes["refs"])
        return held.unionByName(_after(sizes[name], lacking).select(F.col("_new").alias(POS), *[c for c in held.columns if c != POS]))

    def add_vocabulary(self, refs: DataFrame, vocabulary) -> tuple[ReferenceStore, DataFrame]:
        """Adds the entity of each key that is a term; returns (_pos, key) of those that aren't, repeats kept."""
        missing = vocabulary.violations(refs, "key").select(POS, "key")
        found = vocabulary.lookup(refs.drop("entity_id", "entity_uri"), "key").withColumnsRenamed({"term_id": "entity_id", "term_uri": "entity_uri"})
        return self.add(found), missing

    def add_tree(self, nodes: DataFrame, cells: DataFrame, vocabulary) -> tuple[ReferenceStore, DataFrame]:
        """Adds the terms of all checked fields of a tree: `cells` (_pos, node_id, field, value) are the values
        of the fields that a vocabulary governs. Objects are the typed nodes, their file is the root."""
        root = nodes.where("parent_id is null").select(F.col("object_id").alias("file_object_id"))
        named = cells.join(nodes.select("node_id", "object_id", F.col("data_type").alias("object_type")), "node_id")
        refs = named.crossJoin(F.broadcast(root)).select(POS, "file_object_id", "object_id", "object_type", F.lit("").alias("relative_path"), "field", F.col("value").alias("key"))  # a tree has one root
        return self.add_vocabulary(refs.withColumns({"entity_id": F.lit(None).cast("string"), "entity_uri": F.lit(None).cast("string")}), vocabulary)

    # checks and files

    def violations(self) -> dict[str, int]:
        """How many links of each kind point outside their table."""
        out = {}
        for name, links in LINKS.items():
            for column, target in links.items():
                rows = getattr(self, name).select(F.col(column).alias(POS)).join(getattr(self, target).select(POS), POS, "left_anti")
                out[f"{name}.{column}"] = rows.count()
        return out

    def equals(self, other: ReferenceStore) -> bool:
        """Whether all six tables are equal, positions included."""
        return all(a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty() for a, b in zip(self.tables().values(), other.tables().values()))

    def write(self, folder: str) -> None:
        """Each table as tab-separated files in a folder of its own."""
        for name, df in self.tables().items():
            df.write.mode("overwrite").csv(f"{folder}/{name}", sep="\t", header=True)

    @classmethod
    def read(cls, spark: SparkSession, folder: str) -> ReferenceStore:
        """Reads what `write` wrote; links out of range are an error."""
        store = cls(**{n: spark.read.csv(f"{folder}/{n}", sep="\t", header=True, schema=f"{POS} long, {s}").fillna("") for n, s in SCHEMAS.items()})
        bad = {k: v for k, v in store.violations().items() if v}
        if bad:
            raise ValueError(f"links out of range: {bad}")
        return store

    def to_zip(self, path: str, most_rows: int = 1_000_000) -> None:
        """Six .tsv files in a zip, for exchange: for stores that a person made. One of more than
        `most_rows` rows in all is refused; `write` has no such bound."""
        if sum(self.sizes().values()) > most_rows:
            raise ValueError(f"over {most_rows} rows: use write")
        with zipfile.ZipFile(path, "w") as z:
            for name, df in self.tables().items():
                z.writestr(f"{name}.tsv", df.orderBy(POS).drop(POS).toPandas().to_csv(sep="\t", index=False))

    @classmethod
    def from_zip(cls, spark: SparkSession, path: str) -> ReferenceStore:
        import pandas as pd

        rows = {}
        with zipfile.ZipFile(path) as z:
            for name in SCHEMAS:
                pdf = pd.read_csv(io.BytesIO(z.read(f"{name}.tsv")), sep="\t", keep_default_na=False)
                rows[name] = [tuple(int(v) if c.endswith("_idx") else str(v) for c, v in zip(pdf.columns, r)) for r in pdf.itertuples(index=False)]
        store = cls.from_rows(spark, **rows)
        bad = {k: v for k, v in store.violations().items() if v}
        if bad:
            raise ValueError(f"links out of range: {bad}")
        return store
