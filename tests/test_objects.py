"""References within data, the parts of specifications, keyed regions, and validation of what they say."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import dtypes
from tessera.operators import compound, hierarchy, position, ragged, region
from tessera.operators import nodes as N
from tessera.operators import validate as V
from tessera.operators.position import POS
from tessera.operators.references import ReferenceStore
from tessera.operators.table import ColumnSpec, Table, table_of
from tessera.operators.vocabulary import Vocabulary, check_configured
from tessera.sources import chunks
from tessera.plans.spec import Attribute, Catalog, NamespaceBuilder, NamespaceCatalog, Spec, from_dict, problems, to_dict


def errors(spark, catalog, tree):
    return sorted(map(tuple, V.validate(*N.from_tree(spark, tree), catalog).select("error", "name", "location", "reason").collect()))


def test_untyped_children_are_checked_all_the_way_down(spark):
    c = Catalog()
    deep = Spec("group", name="deep", children=(Spec("dataset", name="x", dtype="int", attributes=(Attribute("unit", dtype="text"),)),))
    c.register(Spec("group", type_def="Top", children=(Spec("group", name="mid", attributes=(Attribute("a", dtype="int"),), children=(deep,)),)))
    mid = {"name": "mid", "attrs": {"a": {"value": 1, "dtype": "int"}}, "children": [{"name": "deep", "children": [{"name": "x", "kind": "dataset", "dtype": "text", "attrs": {}}]}]}
    assert errors(spark, c, {"name": "r", "type": "Top", "children": [mid]}) == [
        ("DtypeError", "Top/mid/deep/x", "/mid/deep/x", "incorrect type - expected 'int', got 'text'"),
        ("MissingError", "Top/mid/deep/x/unit", "/mid/deep/x", "argument missing"),
    ]
    assert errors(spark, c, {"name": "r", "type": "Top", "children": [{"name": "mid"}]}) == [
        ("MissingError", "Top/mid/a", "/mid", "argument missing"),
        ("MissingError", "Top/mid/deep", "/mid", "argument missing"),
    ]


def test_compounds_without_rows_have_dtypes(spark):
    c = Catalog()
    c.register(Spec("group", type_def="Top", children=(Spec("dataset", name="rows", fields=(("a", "long"), ("b", "double"))), Spec("dataset", name="plain", dtype="long"))))
    tree = lambda n: {"name": "r", "type": "Top", "children": [{"name": "rows", "kind": "dataset", "dtype": "a:utf,b:double", "shape": [n]}, {"name": "plain", "kind": "dataset", "dtype": "utf", "shape": [n]}]}
    assert [e[1] for e in errors(spark, c, tree(1))] == ["Top/plain", "Top/rows"]
    assert errors(spark, c, tree(0)) == [("DtypeError", "Top/rows", "/rows", "incorrect type - expected '['long', 'double']', got '['utf', 'double']'")]


def test_children_take_turns(spark):
    """Two slots of one type: the first child fills the first, the second the other, more go to the first."""
    c = Catalog()
    c.register(Spec("group", type_def="Leaf"))
    c.register(Spec("group", type_def="Top", children=(Spec("group", type_inc="Leaf", quantity=2), Spec("group", name="named", type_inc="Leaf"))))
    leaf = lambda name: {"name": name, "type": "Leaf"}
    tree = lambda *names: {"name": "r", "type": "Top", "children": [leaf(n) for n in names]}
    assert errors(spark, c, tree("a", "b", "named")) == []
    assert errors(spark, c, tree("a", "named")) == [  # greedy: the named one is taken by the first slot that needs some
        ("MissingDataType", "Top", "/", "missing data type Leaf (named)")
    ]
    assert [e[3] for e in errors(spark, c, tree("a", "b", "c", "named"))] == ["expected a quantity of 2 for data type Leaf, received 3"]


def test_values_and_references(spark):
    c = Catalog()
    c.register(Spec("group", type_def="Top", attributes=(Attribute("when", dtype="isodatetime"), Attribute("n", dtype="numeric"), Attribute("to", dtype={"target_type": "Top", "reftype": "object"}))))
    assert c.get("Top").attributes[2].target_type == "Top" and from_dict(to_dict(c.get("Top"))) == c.get("Top")
    nodes, attrs = N.from_tree(spark, {"name": "r", "type": "Top", "attrs": {"when": "2020-01-02", "n": 3, "to": "x"}})
    found = V.validate(nodes, attrs, c).collect()
    assert [(r["error"], r["reason"]) for r in found] == [("DtypeError", "incorrect type - expected 'object reference', got 'utf'")]
    late = attrs.withColumn("value", F.when(F.col("name") == "when", "soon").otherwise(F.col("value"))).withColumn("ref_target", F.when(F.col("name") == "to", 0).cast("long"))
    assert [r["name"] for r in V.validate(nodes, late, c).collect()] == ["Top/when"]
    nothing = V.validate(nodes.limit(0), attrs.limit(0), c)
    assert nothing.count() == 0 and nothing.columns == V.COLUMNS


def many_children(spark):
    """A type whose node has 4,000 children, one of them by a link and one of another type."""
    c = Catalog()
    c.register(Spec("group", type_def="Leaf"))
    c.register(Spec("group", type_def="Top", children=(Spec("group", type_inc="Leaf", quantity="*"), Spec("group", name="last", type_inc="Leaf", attributes=(Attribute("a", dtype="int"),)))))
    leaves = [{"name": f"n{i}", "type": "Leaf" if i else "Odd"} for i in range(3999)] + [{"name": "l", "kind": "link", "link": "/n1"}]
    return c, N.from_tree(spark, {"name": "r", "type": "Top", "children": leaves})


def test_children_of_one_parent_meet_in_no_task(spark):
    c, (nodes, _) = many_children(spark)
    nodes = nodes.repartition(4, "node_id")
    closure = c.closure(spark).select(F.col("data_type").alias("_sub"), F.col("ancestor").alias("_super"))
    filled = V.assign(nodes, spark.createDataFrame([(0, "Top")], "node_id long, part string"), c.parts(spark)[0]["slots"], closure)
    sizes = [r["count"] for r in filled.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 3999 and max(sizes) < 2000


def test_only_ranks_that_hold_the_wanted_parts_are_checked(spark, monkeypatch):
    """An attribute of the first rank and a dataset of the second: neither takes the nodes of the other's rank along."""
    c = Catalog()
    c.register(Spec("group", type_def="Top", attributes=(Attribute("a", dtype="int", shape=(2,)),), children=(Spec("dataset", name="d", dtype="int", shape=(3,)),)))
    tree = {"name": "r", "type": "Top", "attrs": {"a": {"value": [1], "dtype": "int", "shape": [1]}}, "children": [{"name": "d", "kind": "dataset", "dtype": "int", "shape": [4]}]}
    ranks = {}
    for name in ("_attribute_errors", "_dataset_errors"):
        was = getattr(V, name)
        monkeypatch.setattr(V, name, lambda duties, *rest, was=was, name=name: ranks.update({name: [r["rank"] for r in duties.collect()]}) or was(duties, *rest))
    assert V.validate(*N.from_tree(spark, tree), c, {"ShapeError"}).count() == 2
    assert ranks == {"_attribute_errors": [0], "_dataset_errors": [1]}


def test_errors_asked_for(spark):
    c, (nodes, attrs) = many_children(spark)
    every = sorted(map(tuple, V.validate(nodes, attrs, c).collect()))
    assert {e[0] for e in every} == {"UnknownType", "MissingDataType"}
    for error in V.ERRORS:
        assert sorted(map(tuple, V.validate(nodes, attrs, c, {error}).collect())) == [e for e in every if e[0] == error]
    assert "SortMergeJoin" not in V.validate(nodes, attrs, c, {"UnknownType"})._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        V.validate(nodes, attrs, c, {"NoError"})


def test_nodes_made_of_one_known_type_are_not_read(spark):
    c, (nodes, attrs) = many_children(spark)
    of = lambda t: nodes.withColumn("data_type", F.lit(t))
    found = V.validate(of("Leaf").unionByName(of("Odd")), attrs, c, {"UnknownType"})
    assert found.count() == 4001 and "Union" not in found._jdf.queryExecution().optimizedPlan().toString()


def parents_of_few(spark):
    """Nodes of a type that wants three leaves and a dataset: the first has 3,000 leaves, the others 0 to 4 and some a dataset."""
    c = Catalog()
    c.register(Spec("group", type_def="Leaf"))
    c.register(Spec("group", type_def="Box", children=(Spec("group", type_inc="Leaf", quantity=3), Spec("dataset", name="d", quantity="?", dtype="int"))))
    leaves = lambda n: [{"name": f"l{i}", "type": "Leaf"} for i in range(n)]
    boxes = [{"name": f"b{i}", "type": "Box", "children": leaves(i % 5 if i else 3000) + [{"name": "d", "kind": "dataset", "dtype": "int", "shape": [1]}] * (i % 2)} for i in range(60)]
    return c, N.from_tree(spark, {"name": "r", "type": "Leaf", "children": boxes})


def test_numbers_of_children(spark):
    c, (nodes, attrs) = parents_of_few(spark)
    said = "expected a quantity of 3 for data type Leaf, received "
    want = [("IncorrectQuantityError", f"/b{i}", f"{said}{i % 5 if i else 3000}") for i in range(60) if i == 0 or i % 5 in (1, 2, 4)]
    want += [("MissingDataType", f"/b{i}", "missing data type Leaf") for i in range(5, 60, 5)]
    for asked in ({"IncorrectQuantityError"}, {"MissingDataType"}, None):
        got = sorted(map(tuple, V.validate(nodes, attrs, c, asked).select("error", "location", "reason").collect()))
        assert got == sorted(w for w in want if asked is None or w[0] in asked)


def test_children_are_counted_where_they_meet_their_parents(spark, monkeypatch):
    """No shuffle by slot after that by node, and a child that fills no slot in question is not shuffled."""
    c, (nodes, attrs) = parents_of_few(spark)
    monkeypatch.setattr(V.spread, "heavy_keys", lambda *_: [])  # of so few children, each parent has a large part
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = V.validate(nodes, attrs, c, {"MissingDataType"})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    by = [line.split("hashpartitioning(")[1].split("#")[0] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert by.count("node_id") == 2 * by.count("error") == 2 and "path#" not in "".join(line for line in plan.splitlines() if "hashpartitioning(node_id" in line)


def test_only_links_meet_parents_for_errors_of_links(spark, monkeypatch):
    c = Catalog()
    c.register(Spec("group", type_def="Leaf"))
    c.register(Spec("group", type_def="Box", children=(Spec("group", type_inc="Leaf", quantity="*", linkable=False),)))
    tree = {"name": "r", "type": "Box", "children": [{"name": "a", "type": "Leaf"}, {"name": "l", "kind": "link", "link": "/a"}]}
    met, joined = [], V.spread.joined
    monkeypatch.setattr(V.spread, "joined", lambda rows, *rest: met.extend(r["child_kind"] for r in rows.collect()) or joined(rows, *rest))
    found = V.validate(*N.from_tree(spark, tree), c, {"IllegalLinkError"}).collect()
    assert [r["location"] for r in found] == ["/"] and met == ["link"]


def test_shapes_are_made_for_errors_of_datasets_alone(spark):
    from tessera.plans import objects

    reads = lambda q: any("lineitem" in f for f in q(spark, "/root/testdata/sf0.001").inputFiles())
    assert [q.__name__ for q in (objects.validate_reference, objects.validate_link, objects.validate_missing, objects.validate_quantity, objects.validate_shape) if reads(q)] == ["validate_shape"]


def test_compound_and_region_references(spark):
    nodes, _ = N.from_tree(spark, {"name": "r", "type": "T", "children": [{"name": "d", "kind": "dataset", "dtype": "int", "shape": [3]}, {"name": "g", "type": "G"}]})
    rows = spark.createDataFrame([(0, 1, 2), (1, 2, 99), (2, None, 1)], f"{POS} long, a long, b long")
    got = compound.resolve_fields(rows, nodes, ["a", "b"]).orderBy(POS).collect()
    assert [(r["a"] and r["a"]["path"], r["b"] and r["b"]["path"]) for r in got] == [("/d", "/g"), ("/g", None), (None, "/d")]
    refs = spark.createDataFrame([(0, "/d", [2, 0, 2]), (1, "/g", [0]), (2, "/d", [])], f"{POS} long, path string, at array<long>")
    refs = compound.region_references(refs, nodes, "path", "at", "region")
    assert {r[POS]: r["region"] is None for r in refs.collect()} == {0: False, 1: True, 2: False}
    data = spark.createDataFrame([(1, i, 10 * i) for i in range(3)], f"node_id long, {POS} long, value int")
    assert [r["value"] for r in compound.resolve_regions(refs, data, "region").orderBy(POS, "_ord").collect()] == [20, 0, 20]
    assert sorted(r["value"] for r in compound.slice_region(data, 1, [2, 0, 2]).collect()) == [0, 20]
    assert compound.object_references(rows.select(POS, F.lit("/nope").alias("path")), nodes, "path", "node").where("node is not null").isEmpty()


def test_regions_by_key(spark):
    leaf = table_of(spark, "leaf", [("a", 1), ("b", 0), ("c", 1)], "tag string, parent long")
    top = table_of(spark, "top", [("x",), ("y",), ("z",)], "label string").with_children(leaf, POS, "parent")
    assert top.colnames == ["label"] and top.foreign_columns == ["leaf"] and top.is_ragged("leaf")
    assert sorted((r["top__label"], r["leaf__tag"]) for r in hierarchy.flatten(top).collect()) == [("x", "b"), ("y", "a"), ("y", "c")]
    nested = {r["label"]: [x["tag"] for x in r["leaf"]] for r in region.nest(top, "leaf").collect()}
    assert nested == {"x": ["b"], "y": ["a", "c"], "z": []}
    assert region.shape(top, "leaf") == (3, 2) and region.dangling(top, "leaf").isEmpty()
    assert [r["tag"] for r in region.gather(top, "leaf").orderBy("_src", "_ord").collect()] == ["b", "a", "c"]
    with pytest.raises(ValueError):
        top.with_children(leaf, POS, "parent")
    empty = table_of(spark, "none", [], "label string").with_children(leaf, POS, "parent")
    assert hierarchy.flatten(empty).count() == 0


def test_numbering_beyond_what_quantiles_cut(spark, monkeypatch):
    monkeypatch.setattr(position, "SMALL", 10)
    monkeypatch.setattr(position, "LARGE", 20)
    df = spark.createDataFrame([(i * 37 % 300, i) for i in range(300)], "k int, i int").repartition(3)
    assert [r["k"] for r in position.number(df, "k", ranges=4).orderBy(POS).collect()] == sorted(i * 37 % 300 for i in range(300))


def test_enumerations_of_many_elements(spark, monkeypatch):
    monkeypatch.setattr(position, "SMALL", 10)
    df = spark.createDataFrame([(i, f"v{i * 7 % 90:02}") for i in range(180)], f"{POS} long, v string")
    assert [r["element"] for r in ragged.elements_of(df, "v").orderBy("code").collect()] == sorted({f"v{i:02}" for i in range(90)})
    first = ragged.elements_of(df.where("v < 'v03'"), "v")
    grown = ragged.grow_elements(first, df, "v").orderBy("code").collect()
    assert [r["code"] for r in grown] == list(range(90)) and [r["element"] for r in grown[:5]] == ["v00", "v01", "v02", "v07", "v14"]


def test_specifications_by_type_and_dims(spark):
    s = Spec("group", type_def="A", children=(Spec("group", name="x", type_inc="B"), Spec("group", name="y", type_inc="B"), Spec("group", type_inc="C"), Spec("group", name="z", type_inc="C"), Spec("link", name="l", type_inc="B")))
    assert [c.name for c in s.of_type("B")] == ["x", "y"] and s.of_type("C").name is None and s.of_type("D") is None and s.target("B").name == "l"
    assert Spec("group", type_inc="B", quantity="one_or_many").many
    d = Spec("dataset", name="d", shape=((None, None), (None, 3)), dims=(("a", "b"), ("a", "rgb")))
    assert d.dims_of((5, 3)) == ("a", "rgb") and d.dims_of((5, 4)) == ("a", "b") and d.dims_of((5,)) is None


def test_authoring_and_structure(spark, tmp_path):
    base = NamespaceBuilder("base", "1.0")
    base.add_spec("base.yaml", Spec("group", type_def="A", doc="a"))
    base.add_spec("base.yaml", Spec("dataset", type_def="D", doc="d", dtype="int"))
    lab = NamespaceBuilder("lab", "0.1")
    lab.include_type("A", "base")
    lab.add_source("empty.yaml")
    lab.add_spec("lab.yaml", Spec("group", type_def="B", type_inc="A", doc="b"))
    held = NamespaceCatalog()
    for b in (base, lab):
        held.load(b.export(str(tmp_path)))
    assert held.types("base") == ("A", "D") and held.types("lab") == ("A", "B")
    with pytest.raises(ValueError):
        NamespaceBuilder("x", "")
    with pytest.raises(ValueError):
        base.add_spec("base.yaml", Spec("group", name="g"))
    assert problems({"data_type_def": "A", "doc": "a", "datasets": [{"name": "d", "doc": "d", "dtype": "int"}]}) == []
    bad = problems({"data_type_def": "A", "datasets": [{"name": "d", "doc": "d", "dtype": "integer", "quantity": "many"}], "links": [{"name": "l", "doc": "l"}], "attributes": [{"dtype": "int"}]})
    assert bad == ["/A: no doc", "/A: an attribute without a name", "/A/d: quantity 'many'", "/A/d: dtype 'integer'", "/A/l: a link without a target_type"]


def test_predefined_columns_provenance_and_vocabularies(spark, tmp_path):
    t, optional = Table.predefined(spark, "t", Spec("group", type_def="T", children=(Spec("dataset", name="a", dtype="int"), Spec("dataset", name="b", dtype="text", quantity="?"))))
    assert t.colnames == ["a"] and optional == ["b"] and len(t.add_rows(spark.createDataFrame([(1,)], "a int"))) == 1
    spark.createDataFrame([(0, "x")], "k long, v string").coalesce(1).write.parquet(str(tmp_path / "data"))
    held = Table.from_frame("p", spark.read.parquet(str(tmp_path / "data")), pos_col="k")
    assert "/data/part-" in held.provenance().first()["source"]
    v = Vocabulary.from_rows(spark, "v", [("x", "1", "an x", "P:1")], {"P": "http://x/"})
    checked = table_of(spark, "c", [("x", "x")], "a string, b string", columns=[ColumnSpec("a", vocabulary=v), ColumnSpec("b", vocabulary=v)])
    with pytest.raises(ValueError, match="'a': \\['y'\\], 'b': \\['z'\\]"):
        checked.add_rows(spark.createDataFrame([("y", "z")], "a string, b string"))
    cells = spark.createDataFrame([("core", "A", "f", "x"), ("core", "A", "f", "q"), ("core", "Z", "f", "q")], "namespace string, data_type string, field string, value string")
    bad, unknown = check_configured(cells, {"namespaces": {"core": {"data_types": {"A": {"f": "v"}}}}}, {"v": v})
    assert [r["value"] for r in bad.collect()] == ["q"] and [r["data_type"] for r in unknown.collect()] == ["Z"]


def test_references_refuse_and_settle(spark, tmp_path):
    row = "file_object_id string, object_id string, object_type string, relative_path string, field string, key string, entity_id string, entity_uri string"
    refs = spark.createDataFrame([(i, "f", f"o{i % 3}", "T", None, "", f"k{i % 2}", f"e{i % 2}", "u") for i in range(60)], f"{POS} long, {row}")
    store = ReferenceStore.empty(spark).add(refs).settled()
    assert store.sizes() == {"keys": 6, "entities": 2, "files": 1, "objects": 3, "object_keys": 6, "entity_keys": 6}
    assert store.add(refs).equals(store) and ReferenceStore.empty(spark).add(refs.limit(0)).joined().count() == 0
    with pytest.raises(ValueError, match="use write"):
        store.to_zip(str(tmp_path / "s.zip"), most_rows=3)


def test_references_to_one_entity_meet_in_no_task(spark):
    refs = spark.range(4000).select(F.col("id").alias(POS), F.lit("f").alias("file_object_id"), F.concat(F.lit("o"), "id").alias("object_id"), F.lit("T").alias("object_type"), F.lit("").alias("relative_path"), F.lit("").alias("field"), F.lit("k").alias("key"), F.lit("e").alias("entity_id"), F.lit("u").alias("entity_uri"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in ReferenceStore.empty(spark).add(refs).joined().groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4000 and max(sizes) < 2000


def test_chunks_across_parts(spark, monkeypatch):
    monkeypatch.setattr(chunks, "PART", 4)
    there = [0, 1, 2, 3, 4, 5, 6, 7, 8, 11, 12, 15, 16, 19, 20, 21, 22, 23, 24, 30]
    df = spark.createDataFrame([(i, 1) for i in there], f"{POS} long, v int")
    got = sorted((r["start"], r["stop"]) for r in chunks.blocks(df, "v", 3).collect())
    assert got == [(0, 3), (3, 6), (6, 9), (11, 13), (15, 17), (19, 22), (22, 25), (30, 31)]


def test_unsigned_ranges(spark):
    df = spark.createDataFrame([(-1,), (0,), (255,), (256,)], "v long")
    assert [r[0] for r in df.select(dtypes.cast(F.col("v"), "uint8", strict=False)).collect()] == [None, 0, 255, None]
    with pytest.raises(Exception, match="out of range"):
        df.select(dtypes.cast(F.col("v"), "uint8")).collect()
