"""The store of a hierarchy: node and attribute tables, specifications, and a Parquet folder for each
dataset. Paths are Hadoop URIs; nothing here opens a local file."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import nodes as N
from tessera.plans.spec import Namespace, from_dict, latest_versions, to_dict

#: The writer's names of gzip levels 0 to 9.
GZIP_LEVELS = ["NO_COMPRESSION", "BEST_SPEED", "TWO", "THREE", "FOUR", "FIVE", "SIX", "SEVEN", "EIGHT", "BEST_COMPRESSION"]
#: Mode letters and what they mean for an existing store.
MODES = {"w": "overwrite", "w-": "error", "x": "error", "a": "append", "r": None, "r+": "append"}


def write_options(compression: str = "snappy", level: int | None = None, row_group_bytes: int | None = None, partitions: int | None = None) -> dict:
    """Checked writer options. gzip takes a level of 0 to 9, zstd 1 to 22, the others none."""
    levels = {"gzip": range(10), "zstd": range(1, 23), "snappy": (), "none": (), "lz4": ()}
    if compression not in levels:
        raise ValueError(f"compression is one of {sorted(levels)}")
    if level is not None and level not in levels[compression]:
        raise ValueError(f"{compression} has no level {level}")
    out = {"compression": compression}
    if level is not None:
        out |= {"parquet.compression.codec.zstd.level": str(level)} if compression == "zstd" else {"zlib.compress.level": GZIP_LEVELS[level]}
    if row_group_bytes:
        out["parquet.block.size"] = str(row_group_bytes)
    return out | ({"_partitions": partitions} if partitions else {})


class Store:
    """A hierarchy under one URI, opened with a mode."""

    def __init__(self, spark: SparkSession, uri: str, mode: str = "r"):
        if mode not in MODES:
            raise ValueError(f"mode is one of {sorted(MODES)}")
        self.spark, self.uri, self.mode = spark, uri.rstrip("/"), mode
        self.options: dict[str, dict] = {}
        if mode in ("r", "r+") and not self.exists():
            raise FileNotFoundError(uri)
        if mode in ("w-", "x") and self.exists():
            raise FileExistsError(uri)

    def exists(self) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.uri}/nodes")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def set_options(self, path: str, **options) -> None:
        """Writer options of one dataset (see `write_options`), in place of those given for all."""
        self.options[path] = write_options(**options)

    def _readable(self):
        if self.mode in ("w", "w-", "x"):
            raise ValueError(f"a store opened with {self.mode} can't be read")

    def _write(self, df: DataFrame, name: str, options: dict | None = None) -> None:
        if self.mode == "r":
            raise ValueError("the store is open for reading")
        options = dict(options or {})
        n = options.pop("_partitions", None)
        (df.repartition(n) if n else df).write.mode("overwrite" if self.mode in ("w", "w-", "x") else MODES[self.mode]).options(**options).parquet(f"{self.uri}/{name}")

    def write(self, nodes: DataFrame, attrs: DataFrame, datasets: dict[str, DataFrame] | None = None, namespaces: list[Namespace] | None = None, options: dict | None = None) -> None:
        """Writes the tree, the data of its dataset nodes by path, and the specifications."""
        self._write(nodes, "nodes")
        self._write(attrs, "attrs")
        for path, df in (datasets or {}).items():
            self._write(df, f"data{path}", self.options.get(path, options))
        if namespaces:
            self.write_specs(namespaces)

    def write_specs(self, namespaces: list[Namespace]) -> None:
        rows = [(ns.name, ns.version, t, s.kind, json.dumps(to_dict(s))) for ns in namespaces for t, s in ns.catalog.specs.items()]
        self._write(self.spark.createDataFrame(rows, "namespace string, version string, data_type string, kind string, spec string"), "specs")

    def read_specs(self) -> dict[str, Namespace]:
        """The last version of each stored namespace."""
        self._readable()
        out: dict[str, Namespace] = {}
        for r in latest_versions(self.spark.read.parquet(f"{self.uri}/specs")).collect():  # one row a type
            out.setdefault(r["namespace"], Namespace(r["namespace"], r["version"])).catalog.register(from_dict(json.loads(r["spec"]), r["kind"]))
        return out

    def nodes(self) -> DataFrame:
        self._readable()
        return self.spark.read.parquet(f"{self.uri}/nodes")

    def attrs(self) -> DataFrame:
        self._readable()
        return self.spark.read.parquet(f"{self.uri}/attrs")

    def dataset(self, path: str) -> DataFrame:
        """A dataset's rows, through links."""
        node = N.at_path(self.nodes(), path).first()
        if node is None:
            raise KeyError(path)
        if node["kind"] == "link":
            target = self.nodes().where(F.col("node_id") == node["link_target"]).first()
            if target is None:
                raise KeyError(f"{path} is a broken link")
            path = target["path"]
        return self.spark.read.parquet(f"{self.uri}/data{path}")

    def export(self, target: Store, expand_links: bool = False) -> None:
        """Copies the whole hierarchy, ids included; links stay links unless expanded."""
        nodes = self.nodes()
        target.write(N.materialise_links(nodes) if expand_links else nodes, self.attrs())
        held = self.data_paths()
        for path in held:
            target._write(self.spark.read.parquet(f"{self.uri}/data{path}"), f"data{path}")
        if expand_links and held:
            links = N.resolve_links(nodes).select("path", "target_path").where(F.col("target_path").isin(held))
            for r in links.toLocalIterator():
                target._write(self.spark.read.parquet(f"{self.uri}/data{r['target_path']}"), f"data{r['path']}")

    def link_references(self, references) -> None:
        """Keeps a reference store with the hierarchy."""
        if self.mode == "r":
            raise ValueError("the store is open for reading")
        references.write(f"{self.uri}/references")

    def linked_references(self):
        """The reference store that is kept with the hierarchy."""
        from tessera.operators.references import ReferenceStore

        self._readable()
        return ReferenceStore.read(self.spark, f"{self.uri}/references")

    def data_paths(self) -> list[str]:
        """The paths of datasets whose data is in the store."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/data")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        root, found, files = str(fs.getFileStatus(top).getPath().toString()), set(), fs.listFiles(top, True)
        while files.hasNext():
            path = files.next().getPath()
            if path.getName().startswith("part-"):
                found.add(path.getParent().toString().removeprefix(root))
        return sorted(found)
