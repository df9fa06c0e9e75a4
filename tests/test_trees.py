import pytest
from pyspark.sql import functions as F

from tessera.operators import nodes as N
from tessera.operators import validate as V
from tessera.operators.position import POS
from tessera.operators.references import ReferenceStore
from tessera.operators.vocabulary import Checked, Vocabulary, merge_config, rules
from tessera.plans.spec import Attribute, Catalog, Namespace, NamespaceCatalog, Spec, compile_schema, from_dict, latest_versions, order_dependencies, to_dict
from tessera.sources import chunks
from tessera.sources.store import Store, write_options
from tessera.streaming import ingest


@pytest.fixture(scope="module")
def catalog():
    c = Catalog()
    c.register(Spec("group", type_def="Base"))
    c.register(Spec("group", type_def="Bar", type_inc="Base", attributes=(Attribute("attr1", dtype="text"),), children=(Spec("dataset", name="data", dtype="int", shape=(None,)),)))
    c.register(Spec("group", type_def="Root", children=(Spec("group", type_inc="Bar", quantity="+"),)))
    return c


def errors(spark, catalog, tree):
    return sorted((r["error"], r["name"], r["location"]) for r in V.validate(*N.from_tree(spark, tree), catalog).collect())


def test_validation(spark, catalog):
    good = {"name": "bar", "type": "Bar", "attrs": {"attr1": "a"}, "children": [{"name": "data", "kind": "dataset", "dtype": "int", "shape": [3]}]}
    assert errors(spark, catalog, {"name": "r", "type": "Root", "children": [good]}) == []
    assert errors(spark, catalog, {"name": "r", "type": "Root"}) == [("MissingDataType", "Root", "/")]
    bad = {"name": "bar", "type": "Bar", "attrs": {"attr1": 10}}
    assert errors(spark, catalog, {"name": "r", "type": "Root", "children": [bad]}) == [("DtypeError", "Bar/attr1", "/bar.attr1"), ("MissingError", "Bar/data", "/bar")]
    shape = good | {"children": [{"name": "data", "kind": "dataset", "dtype": "long", "shape": [3, 2]}]}
    assert errors(spark, catalog, {"name": "r", "type": "Root", "children": [shape]}) == [("ShapeError", "Bar/data", "/bar/data")]
    assert errors(spark, catalog, {"name": "r", "type": "Nope"}) == [("UnknownType", "Nope", "/")]


def test_tree_queries(spark, catalog):
    tree = {"name": "r", "type": "Root", "children": [{"name": "a", "type": "Bar", "children": [{"name": "b", "type": "Bar", "attrs": {"x": 1}}]}, {"name": "c"}, {"name": "l", "kind": "link", "link": "/a"}]}
    nodes, attrs = N.from_tree(spark, tree)
    assert sorted(r["path"] for r in N.descendants(nodes, "/a").collect()) == ["/a", "/a/b"]
    assert [(r["path"], r["distance"]) for r in N.ancestors(nodes, "/a/b").orderBy("distance").collect()] == [("/a", 1), ("/", 2)]
    assert N.resolve_links(nodes).first()["target_path"] == "/a"
    assert {r["path"] for r in N.empty_groups(nodes, attrs).collect()} == {"/c"}
    assert N.children(nodes, "/", name="c").count() == 1
    assert catalog.hierarchy("Bar") == ("Bar", "Base") and catalog.subtypes("Base") == ("Bar",) and catalog.is_a("Bar", "Base")


def test_store_round_trip(spark, catalog, tmp_path):
    nodes, attrs = N.from_tree(spark, {"name": "r", "type": "Root", "children": [{"name": "d", "kind": "dataset", "dtype": "int", "shape": [2]}, {"name": "l", "kind": "link", "link": "/d"}]})
    ns = Namespace("core", "1.0", catalog=catalog)
    Store(spark, str(tmp_path / "s"), "w").write(nodes, attrs, {"/d": spark.range(2)}, [ns])
    store = Store(spark, str(tmp_path / "s"))
    assert store.dataset("/l").count() == 2
    assert store.read_specs()["core"].catalog.get("Bar").attributes[0].name == "attr1"
    store.export(Store(spark, str(tmp_path / "t"), "w"), expand_links=True)
    out = Store(spark, str(tmp_path / "t"))
    assert out.nodes().where("kind = 'link'").isEmpty() and out.dataset("/l").count() == 2
    with pytest.raises(FileNotFoundError):
        Store(spark, str(tmp_path / "nope"))
    with pytest.raises(FileExistsError):
        Store(spark, str(tmp_path / "s"), "x")
    with pytest.raises(ValueError):
        store.write(nodes, attrs)
    assert write_options("gzip", 9)["compression"] == "gzip"
    with pytest.raises(ValueError):
        write_options("snappy", 3)


def test_specs(spark, tmp_path):
    base = from_dict({"data_type_def": "A", "doc": "d", "attributes": [{"name": "x", "dtype": "int"}], "datasets": [{"name": "d", "dtype": "int", "shape": [None, 3]}]})
    sub = from_dict({"data_type_def": "B", "data_type_inc": "A", "attributes": [{"name": "x", "dtype": "int64"}, {"name": "y", "dtype": "text"}]})
    full = sub.resolve(base)
    assert [(a.name, a.inherited, a.overridden) for a in full.attributes] == [("x", False, True), ("y", False, False)]
    assert [c.name for c in full.children] == ["d"] and full.own_parts().children == ()
    assert from_dict(to_dict(base)) == base
    assert compile_schema(base)["d"].dataType.simpleString() == "array<int>"
    with pytest.raises(ValueError):
        from_dict({"data_type_def": "A", "oops": 1})
    ns = Namespace("one", "1.0")
    ns.catalog.register(base)
    held = NamespaceCatalog()
    held.add(ns)
    held.export("one", str(tmp_path))
    again = NamespaceCatalog()
    assert again.load(str(tmp_path / "one.namespace.yaml")) == ["one"] and again.types("one") == ("A",)
    with pytest.raises(KeyError):
        held.add(ns)
    versions = spark.createDataFrame([("a", "1.0"), ("a", "unversioned"), ("a", "1.2"), ("b", "None")], "namespace string, version string")
    assert sorted(map(tuple, latest_versions(versions).select("namespace", "version").collect())) == [("a", "1.2"), ("b", "None")]
    assert order_dependencies({"a": ["b"], "b": ["c"], "c": []}) == ["c", "b", "a"]


def refs(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{POS} long, file_object_id string, object_id string, object_type string, relative_path string, field string, key string, entity_id string, entity_uri string")


def test_reference_upsert(spark, tmp_path):
    store = ReferenceStore.empty(spark)
    assert store.joined().count() == 0
    store = store.add(refs(spark, ("f", "o1", "T", "", "", "key1", "e1", "u1"), ("f", "o2", "T", "", "", "key1", "e1", None), ("f", "o1", "T", "", "", "key1", "e2", "u2")))
    rows = lambda t: [tuple(r)[1:] for r in t.orderBy(POS).collect()]
    assert rows(store.keys) == [("key1",), ("key1",)]
    assert rows(store.entities) == [("e1", "u1"), ("e2", "u2")]
    assert rows(store.object_keys) == [(0, 0), (1, 1)]
    assert sorted(rows(store.entity_keys)) == [(0, 0), (0, 1), (1, 0)]
    again = store.add(refs(spark, ("f", "o1", "T", "", "", "key1", "e1", "other")))
    assert again.equals(store)
    with pytest.raises(ValueError, match="New entities must have an entity_uri"):
        store.add(refs(spark, ("f", "o1", "T", "", "", "k", "e9", None)))
    assert store.find_entity("nope") is None and store.find_key("key1", "o2").first()[POS] == 1
    with pytest.raises(ValueError):
        store.object_entities("nope")
    store.write(str(tmp_path / "tsv"))
    assert ReferenceStore.read(spark, str(tmp_path / "tsv")).equals(store)
    store.to_zip(str(tmp_path / "s.zip"))
    assert ReferenceStore.from_zip(spark, str(tmp_path / "s.zip")).equals(store)
    broken = ReferenceStore.from_rows(spark, keys=[("k",)], object_keys=[(5, 0)])
    assert broken.violations()["object_keys.objects_idx"] == 1


def test_vocabulary(spark):
    v = Vocabulary.from_rows(spark, "species", [("Homo sapiens", "9606", "human", "NCBI_TAXON:9606")], {"NCBI_TAXON": "http://x/"})
    assert v["Homo sapiens"] == ("9606", "human", "http://x/9606") and not v.validate("Unicorn")
    with pytest.raises(ValueError):
        v["Unicorn"]
    good, bad = spark.createDataFrame([("Homo sapiens",)], "s string"), spark.createDataFrame([("Unicorn",)], "s string")
    held = Checked.of(v, good, "s")
    with pytest.raises(ValueError, match="Unicorn"):
        held.extend(bad)
    config = {"namespaces": {"core": {"data_types": {"A": {"f": "x.yaml"}}}}}
    assert rules(merge_config(config, {"namespaces": {"core": {"data_types": {"A": {"f": "y.yaml"}}}}})) == [("core", "A", "f", "y.yaml")]


def test_chunks(spark):
    assert chunks.chunk_shape((2, 2000, 2000), 2, 1) == (2, 79, 79)
    assert chunks.chunk_shape((1, 2000, 2000), 2, 1) == (1, 79, 79)
    assert list(chunks.tiles((3,), (2,))) == [((0, 2),), ((2, 3),)] and chunks.n_tiles((5, 2), (2, 2)) == 3
    make = lambda v: spark.createDataFrame(list(enumerate(v)), f"{POS} long, v int")
    got = lambda v: sorted((r["start"], r["stop"]) for r in chunks.blocks(make(v), "v", 2).collect())
    assert got([1, 2, 3, 4, None, None, 7, 8, None, None]) == [(0, 2), (2, 4), (6, 8)]
    assert got([1, 2, 3, None, None, None, None, 8, 9, 10]) == [(0, 2), (2, 3), (7, 9), (9, 10)]
    assert got([None, None, 3]) == [(2, 3)]


def test_array_source(spark):
    import numpy as np

    data = np.arange(12).reshape(3, 4)
    spark.dataSource.register(chunks.source_of(lambda b: data[tuple(slice(x, y) for x, y in b)]))
    df = spark.read.format("array_tiles").option("shape", "3,4").option("tile", "2,3").load()
    assert df.agg(F.sum("value"), F.countDistinct("tile")).first()[:] == (66.0, 4)


def test_streamed_chunks(spark, tmp_path):
    spark.createDataFrame([(0, "a"), (1, "b")], f"{POS} long, v string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(f"{POS} long, v string").parquet(str(tmp_path / "in"))
    put = lambda: ingest.drain(ingest.write_chunks(stream, str(tmp_path / "out"), str(tmp_path / "ck")))
    put()
    spark.createDataFrame([(1, "B"), (2, "c")], f"{POS} long, v string").write.mode("append").parquet(str(tmp_path / "in"))
    put()
    rows = ingest.latest(ingest.read_chunks(spark, str(tmp_path / "out"))).orderBy(POS).collect()
    assert [r["v"] for r in rows] == ["a", "B", "c"]
