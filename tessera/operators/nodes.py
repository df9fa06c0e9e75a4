"""Trees of groups, datasets and links as a node table, and queries over them.

nodes: node_id, parent_id, path, kind, name, namespace, data_type, object_id, dtype, shape, link_target
attrs: node_id, name, dtype, shape, value, ref_target
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.local import small_frame

NODES = "node_id long, parent_id long, path string, kind string, name string, namespace string, data_type string, object_id string, dtype string, shape array<long>, link_target long"
ATTRS = "node_id long, name string, dtype string, shape array<long>, value string, ref_target long"


def from_tree(spark: SparkSession, tree: dict, namespace: str = "core") -> tuple[DataFrame, DataFrame]:
    """Node and attribute tables of a nested dict: name, kind, type, attrs, dtype, shape, children, link (path)."""
    nodes, attrs, by_path = [], [], {}

    def walk(d: dict, parent: int | None, above: str) -> None:
        n = len(nodes)
        path = f"{above}/{d['name']}" if parent is not None else "/"
        if path in by_path:
            raise ValueError(f"{path} is there twice")
        by_path[path] = n
        nodes.append([n, parent, path, d.get("kind", "group"), d["name"], namespace if d.get("type") else None, d.get("type"), d.get("object_id", f"object-{n}"), d.get("dtype"), d.get("shape"), d.get("link")])
        for name, a in d.get("attrs", {}).items():
            a = a if isinstance(a, dict) else {"value": a}
            value = a.get("value")
            attrs.append((n, name, a.get("dtype") or {str: "utf", int: "long", float: "double", bool: "bool"}.get(type(value), "utf"), a.get("shape"), None if value is None else str(value), None))
        for c in d.get("children", ()):
            walk(c, n, "" if path == "/" else path)

    walk(tree, None, "")
    rows = [(*r[:10], by_path[r[10]] if r[10] is not None else None) for r in nodes]
    return small_frame(spark, rows, NODES), small_frame(spark, attrs, ATTRS)


def at_path(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.where(F.col("path") == path)


def descendants(nodes: DataFrame, path: str) -> DataFrame:
    """The node at a path and all below it: a filter, as paths hold their ancestors."""
    return nodes if path == "/" else nodes.where((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))


def ancestors(nodes: DataFrame, path: str, data_type: str | None = None, closure: DataFrame | None = None) -> DataFrame:
    """The nodes above a path, nearest first (`distance`); with a type, those that are of it."""
    parts = path.strip("/").split("/")
    above = ["/", *("/" + "/".join(parts[:i]) for i in range(1, len(parts)))]
    out = nodes.where(F.col("path").isin(above)).withColumn("distance", F.lit(len(parts)) - F.when(F.col("path") == "/", 0).otherwise(F.size(F.split("path", "/")) - 1))
    if data_type is None:
        return out
    if closure is None:
        return out.where(F.col("data_type") == data_type)
    return out.join(closure.where(F.col("ancestor") == data_type).select("data_type"), "data_type", "left_semi")


def resolve_links(nodes: DataFrame) -> DataFrame:
    """Each link with the node that it points to; a broken link has none."""
    target = nodes.select(F.col("node_id").alias("link_target"), F.col("path").alias("target_path"), F.col("data_type").alias("target_type"))
    return nodes.where("kind = 'link'").join(target, "link_target", "left")


def materialise_links(nodes: DataFrame) -> DataFrame:
    """Links replaced by copies of what they point to."""
    links = nodes.where("kind = 'link'").select("node_id", "parent_id", "path", "name", F.col("link_target").alias("t"))
    target = nodes.select(F.col("node_id").alias("t"), "kind", "namespace", "data_type", "object_id", "dtype", "shape")
    copies = links.join(target, "t").withColumn("link_target", F.lit(None).cast("long"))
    return nodes.where("kind <> 'link'").unionByName(copies.select(nodes.columns))


def resolve_references(nodes: DataFrame, attrs: DataFrame) -> DataFrame:
    target = nodes.select(F.col("node_id").alias("ref_target"), F.col("path").alias("target_path"), F.col("data_type").alias("target_type"))
    return attrs.where("ref_target is not null").join(target, "ref_target")


def children(nodes: DataFrame, path: str, **where) -> DataFrame:
    """The children of a node, by any attribute of theirs."""
    out = nodes.join(at_path(nodes, path).select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi")
    for name, value in where.items():
        out = out.where(F.col(name) == value)
    return out


def child_counts(nodes: DataFrame) -> DataFrame:
    """All nodes that have children, with how many (n_children)."""
    counts = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_children"))
    return nodes.join(counts, "node_id")


def name_clashes(nodes: DataFrame) -> DataFrame:
    """Children of one parent with the same name."""
    return nodes.groupBy("parent_id", "name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def empty_groups(nodes: DataFrame, attrs: DataFrame) -> DataFrame:
    """Groups with no attribute, dataset or link anywhere below."""
    full = nodes.where("kind <> 'group'").select("path").union(nodes.join(attrs.select("node_id"), "node_id", "left_semi").select("path"))
    parts = F.split(F.ltrim(F.col("path"), F.lit("/")), "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    kept = full.select(F.explode(F.array_union(above, F.array(F.lit("/")))).alias("path")).distinct()
    return nodes.where("kind = 'group'").join(kept, "path", "left_anti")
