import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import dtypes
from tessera.operators import hierarchy, position, query, ragged, region, sparse
from tessera.operators.aligned import AlignedTable
from tessera.operators.position import POS
from tessera.operators.rowtable import RowTable
from tessera.operators.table import ColumnSpec, Table, table_of


def values(df, col, order=POS):
    return [r[col] for r in df.orderBy(order).collect()]


@pytest.fixture(scope="module")
def basic(spark):
    rows = [(i, 10.0 * i, b) for i, b in enumerate(["cat", "dog", "bird", "fish", "lizard"], 1)]
    return table_of(spark, "t", rows, "foo int, bar double, baz string")


def test_rows_cells_and_slices(basic):
    assert basic[2].first()["baz"] == "bird"
    assert values(basic[0:5:2], "foo") == [1, 3, 5]
    assert values(basic[1:3, "bar"], "bar") == [20.0, 30.0]
    assert basic[2, 2].first()["bar"] == 30.0
    assert basic[2, 0].first()["id"] == 2
    assert values(basic[-1], "baz") == ["lizard"]
    assert values(basic[[3, 1, 3]], "foo", "_ord") == [4, 2, 4]
    assert values(basic[[True, False, True, False, False]], "foo") == [1, 3]
    assert values(basic[::-2], "foo") == [1, 3, 5]


def test_bad_keys(basic):
    with pytest.raises(IndexError):
        basic[9]
    with pytest.raises(KeyError):
        basic["nope"]
    with pytest.raises(KeyError):
        basic[0.5]
    with pytest.raises(ValueError):
        basic[[[1]]]
    with pytest.raises(TypeError):
        basic.find_ids([0.1])


def test_id_search_gives_row_order_once(basic):
    assert values(basic.find_ids([4, 2, 2, 10]), POS) == [2, 4]
    assert values(basic.where_ids(3), "foo") == [4]


def test_mutation_and_equality(spark, basic):
    more = spark.createDataFrame([(6, 60.0, "newt")], "foo int, bar double, baz string")
    grown = basic.add_rows(more, order=["foo"])
    assert len(grown) == 6 and grown[5].first()["id"] == 5
    assert not grown.equals(basic) and basic.equals(basic)
    with pytest.raises(ValueError):
        basic.add_rows(more.drop("bar"))
    clash = more.withColumn("id", F.lit(1).cast("long"))
    assert basic.add_rows(clash, order=["foo"]).repeated_ids().count() == 1
    with pytest.raises(ValueError):
        basic.add_rows(clash, order=["foo"], unique_ids=True)
    wide = basic.add_column(ColumnSpec("twice"), F.col("foo") * 2)
    assert values(wide["twice"], "twice") == [2, 4, 6, 8, 10]
    with pytest.raises(ValueError):
        wide.add_column(ColumnSpec("twice"), F.lit(1))
    rows, more_text = basic.preview()
    assert len(rows) == 4 and more_text == "... and 1 more row."


def test_numbering_is_gapless_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(None, 1), (2, 2), (2, 3), (1, 4), (9, 5)], "k int, v int")
    assert values(position.number(df, "k", "v"), "v") == [1, 4, 2, 3, 5]
    text = spark.createDataFrame([("b",), ("a",), ("ba",), ("",)], "k string")
    assert values(position.number(text, "k"), "k") == ["", "a", "b", "ba"]


def test_numbering_in_ranges(spark, monkeypatch):
    monkeypatch.setattr(position, "SMALL", 10)
    rng = random.Random(4)
    rows = [(rng.randrange(60), f"k{rng.randrange(50)}", i) for i in range(300)] + [(None, None, 300)]
    hot = [(7, "same", i) for i in range(200)] + rows[:20]
    for data in (rows, hot):
        df = spark.createDataFrame(data, "n int, s string, i int").repartition(3)
        for lead, at in (("n", 0), ("s", 1)):
            got = values(position.number(df, lead, "i", ranges=20), "i")
            assert got == [r[2] for r in sorted(data, key=lambda r: (r[at] is not None, r[at] if r[at] is not None else 0, r[2]))]


def test_regions_and_hierarchy(spark):
    leaf = table_of(spark, "leaf", [("a",), ("b",), ("c",)], "tag string")
    mid = table_of(spark, "mid", [([0, 1], "x"), ([], "y"), ([2], "z")], "refs array<bigint>, label string", columns=[ColumnSpec("refs", kind="region", target="leaf")]).bind(refs=leaf)
    top = table_of(spark, "top", [([0, 2],), ([1],)], "kids array<bigint>", columns=[ColumnSpec("kids", kind="region", target="mid")]).bind(kids=mid)
    flat = hierarchy.flatten(top)
    assert flat.columns == ["top__id", "mid__id", "mid__label", "leaf__id", "leaf__tag"]
    assert sorted(r["leaf__tag"] for r in flat.collect()) == ["a", "b", "c"]  # the empty cell has no path
    nested = region.nest(mid, "refs")
    assert [[x["tag"] for x in r["refs"]] for r in nested.orderBy(POS).collect()] == [["a", "b"], [], ["c"]]
    deep = region.nest_all(top).orderBy(POS).first()["kids"]
    assert [x["tag"] for x in deep[0]["refs"]] == ["a", "b"]
    assert region.linked_tables(top) == [("top", "kids", "mid"), ("mid", "refs", "leaf")]
    assert region.shape(mid, "refs") == (3, 1)
    assert hierarchy.drop_id_columns(flat).columns == ["mid__label", "leaf__tag"]
    with pytest.raises(ValueError):
        hierarchy.flatten_names(flat, 1)
    with pytest.raises(ValueError):
        mid.bind(refs=top)


def test_ragged_round_trip(spark):
    df = spark.createDataFrame([(0, [1, 2]), (1, []), (2, [3])], f"{POS} long, v array<int>")
    flat, ends = ragged.encode(df, "v")
    assert values(ends, "end") == [2, 2, 3]
    assert values(ragged.decode(flat, ends), "value") == [[1, 2], [], [3]]
    assert values(ragged.ends(df, "v", block=1), "end") == [2, 2, 3]
    assert ragged.is_ragged(df, "v")
    nested = spark.createDataFrame([([[1], [2]],), ([[3], [4]],)], "v array<array<int>>")
    assert not ragged.is_ragged(nested, "v")
    row = spark.createDataFrame([([1, 2, 3], [1, 3]), ([], [])], "d array<int>, e array<long>")
    got = [r["x"] for r in row.select(ragged.slice_by_ends(F.col("d"), F.col("e")).alias("x")).collect()]
    assert got == [[[1], [2, 3]], []]
    assert [ragged.code_width(n) for n in (1, 256, 257, 65536, 1 << 24, 1 << 32)] == [8, 8, 16, 16, 32, 32]


def test_sorted_queries(spark):
    data = spark.range(10).select(F.col("id").alias(POS), F.col("id").alias("value"))
    one = lambda op, v: tuple(query.sorted_range(data, op, v).first())
    assert [one(*x) for x in ((">", 5), (">=", 5), ("<", 5), ("<=", 5), ("==", 5), ("==", 99), ("==", (2, 4)))] == [(6, 10), (5, 10), (0, 5), (0, 6), (5, 6), (10, 10), (2, 4)]
    ranges = lambda q: sorted(map(tuple, q.ranges().collect()))
    assert ranges(query.compare(data, "!=", 5)) == [(0, 5), (6, 10)]
    assert ranges(query.compare(data, "==", [1, 2, 7])) == [(1, 3), (7, 8)]
    assert sorted(map(tuple, query.islands(data.select(POS), block=3).collect())) == [(0, 10)]
    space = query.LinSpace(0, 10, 1)
    assert [space.range_of(o, 5) for o in (">", ">=", "<", "<=", "==", "!=")] == [[(6, 10)], [(5, 10)], [(0, 5)], [(0, 6)], [(5, 6)], [(0, 5), (6, 10)]]
    assert space.range_of("<", -3) == [(0, 0)]


def test_row_table(spark):
    t = RowTable.empty(spark, "t", "col1 string, col2 double").add_rows([{"col1": "foo", "col2": 100.0}, {"col1": "bar", "col2": math.nan}])
    assert values(t.which(col1="bar"), POS) == [1]
    assert t.which(col2=math.nan).count() == 0
    assert t["col1", 0] == "foo" and t[0, 1] == "bar"
    with pytest.raises(KeyError):
        t.which(nope=1)
    with pytest.raises(ValueError):
        t.add_rows([{"col1": "x"}])


def test_aligned(spark):
    main = table_of(spark, "main", [(2,), (3,)], "c1 int")
    cat = table_of(spark, "cat", [(4,), (5,)], "c1 int")
    a = AlignedTable.of(main, cat)
    assert a.to_frame().columns == [POS, "main__id", "main__c1", "cat__id", "cat__c1"]
    assert a.get(1, ("cat", "c1")).first()["c1"] == 5
    assert a.get("cat", "c1", 0).first()["c1"] == 4
    assert a.get(1, None, "c1").first()["c1"] == 3
    assert ("cat", "c1") in a and "cat" in a and ("cat", "nope") not in a
    with pytest.raises(KeyError):
        a.category("nope")
    with pytest.raises(ValueError):
        a.add_category(table_of(spark, "short", [(1,)], "x int"))
    grown = a.add_rows(spark.createDataFrame([(9,)], "c1 int"), cat=spark.createDataFrame([(8,)], "c1 int"))
    assert grown.get(2, ("cat", "c1")).first()["c1"] == 8


def test_sparse(spark):
    df = spark.createDataFrame([(0, [1, 0, 2]), (1, [0, 0, 3]), (2, [4, 5, 6])], f"{POS} long, v array<int>")
    rows = sparse.csr_rows(sparse.from_dense(df, "v"), 3).orderBy(POS).collect()
    assert [r["indptr_end"] for r in rows] == [2, 3, 6]
    assert [r["indices"] for r in rows] == [[0, 2], [2], [0, 1, 2]]


def test_dtypes(spark):
    assert dtypes.convert("int8", "int") == ("int", True)
    assert dtypes.convert("long", "int") == ("long", False)
    assert dtypes.convert("long", "uint32") == ("uint64", True)
    assert dtypes.convert("uint64", "float") == ("double", True)
    assert dtypes.accepts("int8", "int64") and not dtypes.accepts("int64", "int8")
    assert dtypes.accepts("utf8", "ascii") and not dtypes.accepts("ascii", "utf8")
    assert dtypes.accepts("numeric", "uint8") and not dtypes.accepts("numeric", "bool")
    assert dtypes.refines("int", "int64") and not dtypes.refines("int", "float")
    assert dtypes.shape_fits([(None, 3), (2,)], (7, 3)) and not dtypes.shape_fits((None, 3), (7, 4))
    assert dtypes.compare_shapes((2, 3), (2,)) == "NUM_DIMS" and dtypes.compare_shapes((2, 3), (4, 3), 1, 1) is None
    assert dtypes.snake_case("FooBar", True) == "foo_bars"
    df = spark.createDataFrame([("aéz",), ("2020-01-02T03:04:05.6+01:00",)], "s string")
    assert df.select(dtypes.ascii_escape(F.col("s"))).first()[0] == "a\\xe9z"
    assert [r[0] for r in df.select(dtypes.is_iso8601(F.col("s"))).collect()] == [False, True]


def test_from_columns_checks_lengths(spark):
    col = lambda *v: spark.createDataFrame(list(enumerate(v)), f"{POS} long, value int")
    assert len(Table.from_columns("t", [(ColumnSpec("a"), col(1, 2)), (ColumnSpec("b"), col(3, 4))])) == 2
    with pytest.raises(ValueError):
        Table.from_columns("t", [(ColumnSpec("a"), col(1, 2)), (ColumnSpec("b"), col(3))])


def test_number_sparse_positions(spark):
    keys = [0, 3, 99, 100, 101, 250, 999, 1000, 5000]
    rows = position.number_sparse(spark.createDataFrame([(k,) for k in reversed(keys)], "k long"), "k", block=100).collect()
    assert sorted((r[POS], r["k"]) for r in rows) == list(enumerate(keys))
    assert position.number_sparse(spark.createDataFrame([], "k long"), "k").count() == 0


def test_number_by_fewer_ranges(spark, monkeypatch):
    monkeypatch.setattr(position, "SMALL", 100)
    values = [float(i * 7919 % 1000) - 500.5 for i in range(1000)] + [None]
    rows = position.number(spark.createDataFrame([(v,) for v in values], "v double"), "v").orderBy(POS).collect()
    assert [r[POS] for r in rows] == list(range(1001))
    assert [r["v"] for r in rows] == [None, *sorted(values[:-1])]
