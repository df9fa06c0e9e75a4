"""The registered queries and their SQL.

Each query applies one operator to the whole of its driver tables. Keys of region, nation, customer,
supplier, part, orders, events, documents and pages are dense, so they serve as row positions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import dtypes
from tessera.lineage import scratch
from tessera.operators import hierarchy, nodes, position, query, ragged, region, sparse, validate
from tessera.operators.aligned import AlignedTable
from tessera.operators.position import POS
from tessera.operators.references import ReferenceStore
from tessera.operators.rowtable import RowTable
from tessera.operators.table import ColumnSpec, Table
from tessera.operators.vocabulary import Vocabulary
from tessera.plans.spec import Attribute, Catalog, Spec
from tessera.sources import chunks
from tessera.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def table(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str, specs=()) -> Table:
    df = read(spark, sf_dir, name, key, *columns)
    return Table.from_frame(name, df, id_col=key, pos_col=key, columns=specs)


# selection


@registered("SELECT o_orderkey AS _pos, o_totalprice FROM orders")
def select_column(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_totalprice")["o_totalprice"]


@registered("SELECT o_orderkey AS id, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 42")
def select_row(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")[42].drop(POS)


@registered("SELECT o_orderkey AS _pos, o_orderstatus FROM orders WHERE o_orderkey = 77")
def select_cell(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_orderstatus")[77, "o_orderstatus"]


@registered("SELECT o_orderkey AS id, o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 1400 AND (o_orderkey - 100) % 7 = 0")
def select_slice_step(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice")[100:1400:7].drop(POS)


@registered("SELECT CAST(p.ord AS BIGINT) AS _ord, o.o_orderkey AS id, o.o_custkey FROM (VALUES (0, 5), (1, 3), (2, 5), (3, 99), (4, 0)) AS p(ord, pos) JOIN orders o ON o.o_orderkey = p.pos")
def select_gather(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_custkey")[[5, 3, 5, 99, 0]].drop(POS)


@registered("SELECT c_custkey AS id, c_name, c_acctbal FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'")
def select_mask(spark, sf):
    t = table(spark, sf, "customer", "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return t[(F.col("c_acctbal") > 0) & (F.col("c_mktsegment") == "BUILDING")].drop(POS, "c_mktsegment")


@registered("SELECT c_custkey AS _pos FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def id_search(spark, sf):
    probe = read(spark, sf, "orders", "o_custkey", "o_orderstatus").where("o_orderstatus = 'F'")
    return table(spark, sf, "customer", "c_custkey", "c_name").find_ids(probe)


@registered("SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey IN (1, 7, 30)")
def id_filter(spark, sf):
    return table(spark, sf, "customer", "c_custkey", "c_name").where_ids([30, 7, 1, 7, 10**9]).drop(POS)


@registered("SELECT p_partkey AS _pos FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def which_eq(spark, sf):
    df = read(spark, sf, "part", "p_partkey", "p_brand")
    least = df.agg(F.min("p_brand")).first()[0]
    return RowTable.from_frame("part", position.from_key(df, "p_partkey").drop("p_partkey"), ("p_brand",)).which(p_brand=least)


@registered("SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderkey <= 200 AND o_orderkey > 5 AND (200 - o_orderkey) % 3 = 0")
def select_slice_back(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_custkey")[200:5:-3].drop(POS)


@registered("SELECT o_orderkey AS _pos, o_totalprice AS value, CASE WHEN o_orderkey = 3 THEN 0 WHEN o_orderkey < 30 THEN 1 ELSE 2 END AS _ord FROM orders WHERE o_orderkey IN (3, 10, 14, 18, 30, 31, 32)")
def pick_mixed(spark, sf):
    data = read(spark, sf, "orders", "o_orderkey", "o_totalprice").select(F.col("o_orderkey").alias(POS), F.col("o_totalprice").alias("value"))
    return query.pick(data, [3, slice(10, 20, 4), (30, 33)])


# positions and sorted queries


def _prices(spark, sf) -> DataFrame:
    rows = read(spark, sf, "orders", "o_orderkey", "o_totalprice")
    return position.number(rows, "o_totalprice", "o_orderkey").select(POS, F.col("o_totalprice").alias("value"), "o_orderkey")


_SORTED = "WITH s AS (SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos, o_totalprice AS value FROM orders) "


@registered("SELECT row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS _pos, o_orderkey FROM orders")
def number_rows(spark, sf):
    return _prices(spark, sf).select(POS, "o_orderkey")


def _range_query(name: str, op: str, cond: tuple[str, str]) -> None:
    def f(spark, sf):
        return query.sorted_range(read(spark, sf, "orders", "o_totalprice").select(F.col("o_totalprice").alias("value")), op, 50000.0)

    f.__name__ = f"sorted_{name}"
    registered(f"SELECT {cond[0]} AS start, {cond[1]} AS stop FROM orders")(f)


_LT, _LE, _N = "count(*) FILTER (o_totalprice < 50000)", "count(*) FILTER (o_totalprice <= 50000)", "count(*)"
for _name, _op, _cond in (("lt", "<", ("CAST(0 AS BIGINT)", _LT)), ("le", "<=", ("CAST(0 AS BIGINT)", _LE)), ("gt", ">", (_LE, _N)), ("ge", ">=", (_LT, _N)), ("eq", "==", (_LT, _LE))):
    _range_query(_name, _op, _cond)


@registered("SELECT count(*) FILTER (o_totalprice < 10000) AS start, greatest(count(*) FILTER (o_totalprice < 10000), count(*) FILTER (o_totalprice < 20000)) AS stop FROM orders")
def sorted_between(spark, sf):
    return query.sorted_range(read(spark, sf, "orders", "o_totalprice").select(F.col("o_totalprice").alias("value")), "==", (10000.0, 20000.0))


_STATUS = "WITH m AS (SELECT o_orderkey AS pos, o_orderkey - row_number() OVER (ORDER BY o_orderkey) AS g FROM orders WHERE {}) SELECT min(pos) AS start, max(pos) + 1 AS stop FROM m GROUP BY g"


@registered(_STATUS.format("o_orderstatus IN ('F', 'P')"))
def islands_in(spark, sf):
    data = read(spark, sf, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").alias(POS), F.col("o_orderstatus").alias("value"))
    return query.compare(data, "==", ["F", "P"]).ranges()


@registered("SELECT o_orderkey AS _pos, o_totalprice AS value, 0 AS _ord FROM orders WHERE o_totalprice > 300000")
def query_pick(spark, sf):
    """Elements of an array by a query over it."""
    data = read(spark, sf, "orders", "o_orderkey", "o_totalprice").select(F.col("o_orderkey").alias(POS), F.col("o_totalprice").alias("value"))
    return query.pick(data, query.compare(data, ">", 300000.0))


@registered("SELECT o_orderkey AS _pos, o_totalprice AS value FROM orders WHERE (o_totalprice < 50000) <> (o_orderkey < 100) AND NOT (o_totalprice >= 20000 AND o_totalprice < 30000)")
def query_xor_not(spark, sf):
    data = read(spark, sf, "orders", "o_orderkey", "o_totalprice").select(F.col("o_orderkey").alias(POS), F.col("o_totalprice").alias("value"))
    by_position = query.Query(data, F.col(POS) < 100)
    return ((query.compare(data, "<", 50000.0) ^ by_position) & ~query.compare(data, "==", (20000.0, 30000.0))).rows()


@registered(_STATUS.format("o_orderstatus <> 'O'"))
def islands_ne(spark, sf):
    data = read(spark, sf, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderkey").alias(POS), F.col("o_orderstatus").alias("value"))
    return query.compare(data, "!=", "O").ranges()


@registered("SELECT o_orderkey AS _pos, o_totalprice AS value FROM orders WHERE (o_totalprice >= 1000 AND o_totalprice < 30000) OR o_totalprice > 200000")
def query_algebra(spark, sf):
    data = read(spark, sf, "orders", "o_orderkey", "o_totalprice").select(F.col("o_orderkey").alias(POS), F.col("o_totalprice").alias("value"))
    return (query.compare(data, "==", (1000.0, 30000.0)) | query.compare(data, ">", 200000.0)).rows()


@registered("SELECT i AS _pos, CAST(0.5 + 0.25 * i AS DOUBLE) AS value FROM range(0, 400) t(i) WHERE 0.5 + 0.25 * i >= 7.3 AND 0.5 + 0.25 * i < 50")
def linspace_query(spark, sf):
    space = query.LinSpace(0.5, 100.5, 0.25)
    return space.frame(spark, space.range_of("==", (7.3, 50.0)))


# what a table has, as tables


@registered("SELECT o_orderkey AS _pos, o_orderkey AS id, o_custkey FROM orders")
def to_frame_exclude(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus").to_frame(exclude={"o_totalprice", "o_orderstatus"})


@registered("SELECT place, name AS \"column\", CASE WHEN place = 0 THEN 'id' ELSE 'data' END AS kind, n_rows, n_null FROM (SELECT (SELECT count(*) FROM documents) AS n_rows, * FROM (SELECT 0 AS place, 'id' AS name, CAST(0 AS BIGINT) AS n_null UNION ALL SELECT 1, 'source', count(*) - count(source) FROM documents UNION ALL SELECT 2, 'lang', count(*) - count(lang) FROM documents))")
def table_summary(spark, sf):
    """Columns in order, how many rows there are, and how many lack a value."""
    t = table(spark, sf, "documents", "doc_id", "lang", "source")
    return t.reorder(["source", "lang"]).summary()


@registered("SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderkey < 4")
def preview_rows(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_custkey").head().drop(POS)


@registered("SELECT 0 AS _src, CAST((o_orderkey - 10) // 3 AS INTEGER) AS _ord, o_orderkey AS id, o_custkey FROM orders WHERE o_orderkey BETWEEN 10 AND 19 AND (o_orderkey - 10) % 3 = 0")
def create_region(spark, sf):
    """A region made of a slice of a table's rows, and the rows behind it."""
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey")
    one = Table("selection", spark.range(1).select(F.lit(0).cast("long").alias(POS), F.col("id"), orders.create_region(slice(10, 20, 3)).alias("rows")), (ColumnSpec("rows", kind="region", target="orders"),))
    return region.gather(one.bind(rows=orders), "rows").withColumn("_src", F.col("_src").cast("int"))


@registered("SELECT o_orderkey AS _pos, 'orders.parquet' AS file FROM orders")
def provenance(spark, sf):
    return table(spark, sf, "orders", "o_orderkey", "o_custkey").provenance().select(POS, F.regexp_extract("source", "(orders[.]parquet)", 1).alias("file"))


@registered("SELECT p_partkey AS _pos, p_name FROM part")
def row_table_column(spark, sf):
    rows = position.from_key(read(spark, sf, "part", "p_partkey", "p_name", "p_brand"), "p_partkey").drop("p_partkey")
    return RowTable.from_frame("part", rows, ("p_name", "p_brand"))["p_name"]


@registered("SELECT CAST(n_nationkey AS BIGINT) AS _pos, n_name AS name, CAST(n_regionkey AS INTEGER) AS code FROM nation UNION ALL SELECT CAST(25 AS BIGINT), 'ATLANTIS', 9")
def row_table_append(spark, sf):
    rows = read(spark, sf, "nation", "n_nationkey", "n_name", "n_regionkey").select(F.col("n_nationkey").cast("long").alias(POS), F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("code"))
    return RowTable.from_frame("nation", rows, ("name", "code")).add_rows([{"name": "ATLANTIS", "code": 9}]).df


@registered("SELECT * FROM (VALUES ('required', 'quantity'), ('required', 'price'), ('optional', 'note')) t(kind, name)")
def predefined_columns(spark, sf):
    """The columns of a table type: required ones are there from the start, optional ones wait."""
    spec = Spec("group", type_def="Lines", children=(Spec("dataset", name="quantity", dtype="long"), Spec("dataset", name="price", dtype="double"), Spec("dataset", name="note", dtype="text", quantity="?")))
    t, optional = Table.predefined(spark, "lines", spec)
    return spark.createDataFrame([("required", c) for c in t.colnames] + [("optional", c) for c in optional], "kind string, name string")


# regions and hierarchies


def _orders_to_customer(spark, sf) -> Table:
    customer = table(spark, sf, "customer", "c_custkey", "c_name", "c_mktsegment")
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", specs=[ColumnSpec("o_custkey", kind="region", target="customer")])
    return orders.bind(o_custkey=customer)


@registered("SELECT o_orderkey AS _pos, 0 AS _ord, o_orderkey AS orders__id, o_totalprice AS orders__o_totalprice, c_custkey AS customer__id, c_name AS customer__c_name, c_mktsegment AS customer__c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def region_join(spark, sf):
    return region.resolve(_orders_to_customer(spark, sf), "o_custkey")


@registered("SELECT o_orderkey AS _src, 0 AS _ord, c_custkey AS id, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def region_gather(spark, sf):
    return region.gather(_orders_to_customer(spark, sf), "o_custkey")


def _customer_orders(spark, sf) -> Table:
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    refs = hierarchy.region_of(orders.df, "o_custkey", [POS], POS, "orders")
    customer = read(spark, sf, "customer", "c_custkey", "c_name").join(refs, F.col("c_custkey") == F.col("o_custkey"), "left")
    customer = customer.select("c_custkey", "c_name", F.coalesce("orders", F.array().cast("array<long>")).alias("orders"))
    t = Table.from_frame("customer", customer, id_col="c_custkey", pos_col="c_custkey", columns=[ColumnSpec("c_name"), ColumnSpec("orders", kind="region", target="orders")])
    return t.bind(orders=orders)


@registered("SELECT c_custkey AS id, count(o_orderkey) AS n, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS refs FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def ragged_region_resolve(spark, sf):
    nested = region.nest(_customer_orders(spark, sf), "orders")
    return nested.select("id", F.size("orders").cast("long").alias("n"), F.array_join(F.transform("orders", lambda r: r["id"].cast("string")), ",").alias("refs"))


def _customers_by_key(spark, sf) -> Table:
    """Customers with their orders by key, and those with their customer's nation."""
    nation = table(spark, sf, "nation", "n_nationkey", "n_name")
    orders = table(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    customer = table(spark, sf, "customer", "c_custkey", "c_name", "c_nationkey", specs=[ColumnSpec("c_name"), ColumnSpec("c_nationkey", kind="region", target="nation")])
    return customer.bind(c_nationkey=nation).with_children(orders, "id", "o_custkey")


@registered("SELECT c_custkey AS customer__id, c_name AS customer__c_name, c_nationkey AS customer__c_nationkey, o_orderkey AS orders__id, o_totalprice AS orders__o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey")
def region_by_key(spark, sf):
    return region.resolve(_customers_by_key(spark, sf), "orders").select("customer__id", "customer__c_name", "customer__c_nationkey", "orders__id", "orders__o_totalprice")


@registered("SELECT count(*) AS n_references FROM orders")
def region_size(spark, sf):
    return region.cells(_customers_by_key(spark, sf), "orders").agg(F.count(F.lit(1)).alias("n_references"))


@registered("SELECT c_custkey AS id, n_name AS nation, count(o_orderkey) AS n_orders, CAST(coalesce(sum(o_orderkey), 0) AS BIGINT) AS sum_of_ids FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL")
def nested_tables(spark, sf):
    """All region cells as nested rows."""
    rows = region.nest_all(_customers_by_key(spark, sf))
    return rows.select("id", F.col("c_nationkey")[0]["n_name"].alias("nation"), F.size("orders").cast("long").alias("n_orders"), F.aggregate("orders", F.lit(0).cast("long"), lambda n, o: n + o["id"]).alias("sum_of_ids"))


@registered("SELECT c_custkey AS id, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey = 7 GROUP BY c_custkey")
def select_nested_row(spark, sf):
    return _customers_by_key(spark, sf).get(7, nested=True).select("id", F.size("orders").cast("long").alias("n_orders"))


@registered("SELECT CAST(count(*) AS BIGINT) AS n_dangling FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)")
def region_integrity(spark, sf):
    return region.dangling(_orders_to_customer(spark, sf), "o_custkey").agg(F.count(F.lit(1)).alias("n_dangling"))


def _chain(spark, sf) -> Table:
    """region, nation, customer, orders, lineitem, each with the rows of the next by their key."""
    line = read(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    below, key = Table("lineitem", line, tuple(ColumnSpec(c) for c in line.columns)), "l_orderkey"  # reached by key alone
    for name, own, up, column in (("orders", "o_orderkey", "o_custkey", "o_totalprice"), ("customer", "c_custkey", "c_nationkey", "c_name"), ("nation", "n_nationkey", "n_regionkey", "n_name"), ("region", "r_regionkey", None, "r_name")):
        here = table(spark, sf, name, own, column, *([up] if up else []))
        below, key = here.with_children(below, "id", key), up
    return below


_FLAT = "SELECT {} FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey"
_FLAT_COLS = "r_name AS region__r_name, n_name AS nation__n_name, n_regionkey AS nation__n_regionkey, c_name AS customer__c_name, c_nationkey AS customer__c_nationkey, o_totalprice AS orders__o_totalprice, o_custkey AS orders__o_custkey, l_orderkey AS lineitem__l_orderkey, l_linenumber AS lineitem__l_linenumber, l_quantity AS lineitem__l_quantity, l_extendedprice AS lineitem__l_extendedprice"


@registered(_FLAT.format("CAST(r_regionkey AS BIGINT) AS region__id, CAST(n_nationkey AS BIGINT) AS nation__id, c_custkey AS customer__id, o_orderkey AS orders__id, " + _FLAT_COLS))
def hierarchy_flatten(spark, sf):
    return hierarchy.flatten(_chain(spark, sf)).drop("lineitem__id")


@registered(_FLAT.format(_FLAT_COLS))
def hierarchy_drop_ids(spark, sf):
    return hierarchy.drop_id_columns(hierarchy.flatten(_chain(spark, sf)))


@registered(_FLAT.format("r_name, n_name, n_regionkey, c_name, c_nationkey, o_totalprice, o_custkey, l_orderkey, l_linenumber, l_quantity, l_extendedprice"))
def hierarchy_flat_names(spark, sf):
    return hierarchy.flatten_names(hierarchy.drop_id_columns(hierarchy.flatten(_chain(spark, sf))), 1)


@registered("SELECT * FROM (VALUES (0, 'region', 'nation', 'nation'), (1, 'nation', 'customer', 'customer'), (2, 'customer', 'orders', 'orders'), (3, 'orders', 'lineitem', 'lineitem')) t(depth, source_table, source_column, target_table)")
def linked_tables(spark, sf):
    links = region.linked_tables(_chain(spark, sf))
    return spark.createDataFrame([(i, *x) for i, x in enumerate(links)], "depth int, source_table string, source_column string, target_table string")


# aligned tables


def _aligned(spark, sf) -> AlignedTable:
    docs = table(spark, sf, "documents", "doc_id", "lang", "source")
    size = Table.from_frame("size", read(spark, sf, "documents", "doc_id", "n_chars"), id_col="doc_id", pos_col="doc_id")
    text = Table.from_frame("text", read(spark, sf, "documents", "doc_id", "text").select("doc_id", F.length("text").alias("length")), id_col="doc_id", pos_col="doc_id")
    return AlignedTable.of(docs, size, text)


@registered("SELECT doc_id AS _pos, doc_id AS documents__id, lang AS documents__lang, source AS documents__source, doc_id AS size__id, n_chars AS size__n_chars, doc_id AS text__id, length(text) AS text__length FROM documents")
def aligned_wide(spark, sf):
    return _aligned(spark, sf).to_frame().withColumn("text__length", F.col("text__length").cast("long"))


@registered("SELECT doc_id AS _pos, doc_id AS id, n_chars FROM documents WHERE doc_id = 11")
def aligned_row(spark, sf):
    return _aligned(spark, sf).get(11, "size")


@registered("SELECT doc_id AS _pos, n_chars FROM documents")
def aligned_column(spark, sf):
    return _aligned(spark, sf).get("size", "n_chars")


def _aligned_customers(spark, sf) -> AlignedTable:
    nation = table(spark, sf, "nation", "n_nationkey", "n_name")
    main = table(spark, sf, "customer", "c_custkey", "c_name")
    place = table(spark, sf, "customer", "c_custkey", "c_nationkey", specs=[ColumnSpec("c_nationkey", kind="region", target="nation")]).bind(c_nationkey=nation)
    return AlignedTable.of(main, Table("place", place.df, place.columns, targets=place.targets))


@registered("SELECT c_custkey AS _pos, c_name AS customer__c_name, c_nationkey AS place__c_nationkey FROM customer UNION ALL SELECT (SELECT count(*) FROM customer), 'New', 3")
def aligned_append(spark, sf):
    """A row more in the main table and its category alike."""
    a = _aligned_customers(spark, sf)
    more = spark.range(1)
    grown = a.add_rows(more.select(F.lit("New").alias("c_name")), place=more.select(F.lit(3).cast(a.categories[0].df.schema["c_nationkey"].dataType).alias("c_nationkey")))
    return grown.to_frame(ignore_ids=True).select(POS, "customer__c_name", "place__c_nationkey")


@registered("SELECT * FROM (VALUES ('place', 'c_nationkey', 'nation')) t(source_table, source_column, target_table)")
def aligned_links(spark, sf):
    return spark.createDataFrame(_aligned_customers(spark, sf).linked_tables(), "source_table string, source_column string, target_table string")


@registered("SELECT * FROM (VALUES ('customer', 'c_name', TRUE), ('place', 'id', FALSE), ('place', 'c_nationkey', TRUE)) t(category, name, held)")
def aligned_columns(spark, sf):
    a = _aligned_customers(spark, sf)
    return spark.createDataFrame([(t, c, (t, c) in a) for t, c in a.colnames()], "category string, name string, held boolean")


# ragged and enumerated columns


@registered("SELECT c_custkey AS id, c_name, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def add_ragged_column(spark, sf):
    """A ragged column made of flat data and end offsets."""
    flat, ends = ragged.encode(_customer_orders(spark, sf).df, "orders")
    t = table(spark, sf, "customer", "c_custkey", "c_name").add_ragged_column(ColumnSpec("orders"), flat, ends)
    return t.df.select("id", "c_name", F.array_join(F.col("orders").cast("array<string>"), ",").alias("orders"))


@registered("SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN '|1,2|3,4,5' WHEN 1 THEN '1|2|3,4,5' ELSE '1,2||3,4,5' END AS cells FROM nation")
def ragged_slices(spark, sf):
    k = F.col("n_nationkey") % 3
    cut = ragged.slice_by_ends(F.sequence(F.lit(1), F.lit(5)), F.array(k, F.lit(2), F.lit(5)))
    return read(spark, sf, "nation", "n_nationkey").select("n_nationkey", F.array_join(F.transform(cut, lambda c: F.array_join(c.cast("array<string>"), ",")), "|").alias("cells"))


@registered("SELECT 'event_type' AS \"column\", count(DISTINCT event_type) AS n_elements, CASE WHEN count(DISTINCT event_type) <= 256 THEN 8 WHEN count(DISTINCT event_type) <= 65536 THEN 16 ELSE 32 END AS bits FROM events UNION ALL SELECT 'event_id', count(DISTINCT event_id), CASE WHEN count(DISTINCT event_id) <= 256 THEN 8 WHEN count(DISTINCT event_id) <= 65536 THEN 16 ELSE 32 END FROM events")
def enum_widths(spark, sf):
    return ragged.code_widths(read(spark, sf, "events", "event_id", "event_type"), "event_type", "event_id")


@registered("SELECT c_custkey AS _pos, CAST(sum(n) OVER (ORDER BY c_custkey) AS BIGINT) AS \"end\" FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def ragged_ends(spark, sf):
    return ragged.ends(_customer_orders(spark, sf).df, "orders")


@registered("SELECT c_custkey AS _pos, coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '') AS refs FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def ragged_round_trip(spark, sf):
    flat, ends = ragged.encode(_customer_orders(spark, sf).df, "orders")
    return ragged.decode(flat, ends).select(POS, F.array_join(F.col("value").cast("array<string>"), ",").alias("refs"))


@registered("SELECT count(DISTINCT n) > 1 AS ragged FROM (SELECT count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)")
def is_ragged(spark, sf):
    return _customer_orders(spark, sf).df.agg(ragged.lengths_differ("orders").alias("ragged"))


@registered("SELECT e.event_id, e.event_type, CAST(d.code AS INTEGER) AS event_type_code FROM events e JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)) d USING (event_type)")
def enum_encode(spark, sf):
    df = read(spark, sf, "events", "event_id", "event_type")
    coded = ragged.enum_encode(df, "event_type", ragged.elements_of(df, "event_type"))
    return coded.withColumn("event_type_code", F.col("event_type_code").cast("int"))


@registered("SELECT event_id, event_type AS decoded FROM events")
def enum_decode(spark, sf):
    df = read(spark, sf, "events", "event_id", "event_type")
    elements = ragged.elements_of(df, "event_type")
    return ragged.enum_decode(ragged.enum_encode(df, "event_type", elements).drop("event_type"), "event_type_code", elements, "decoded").drop("event_type_code")


@registered("SELECT user_id, string_agg(event_type, '' ORDER BY event_id) AS joined FROM events GROUP BY user_id")
def enum_join(spark, sf):
    df = position.from_key(read(spark, sf, "events", "event_id", "user_id", "event_type"), "event_id")
    return ragged.enum_join(df, "event_type", "user_id")


@registered("SELECT lang AS element, row_number() OVER (ORDER BY min(doc_id)) - 1 AS code FROM documents GROUP BY lang")
def enum_grow(spark, sf):
    df = position.from_key(read(spark, sf, "documents", "doc_id", "lang"), "doc_id")
    empty = spark.createDataFrame([], "code long, element string")
    return ragged.grow_elements(empty, df, "lang").select("element", F.col("code").cast("long").alias("code"))


# mutation and comparison


@registered("SELECT CAST(row_number() OVER (ORDER BY part, key) - 1 AS BIGINT) AS _pos, key AS id, name FROM (SELECT 0 AS part, s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT 1, n_nationkey, n_name FROM nation)")
def append_rows(spark, sf):
    t = Table.from_frame("names", read(spark, sf, "supplier", "s_suppkey", "s_name").withColumnRenamed("s_name", "name"), id_col="s_suppkey", pos_col="s_suppkey")
    more = read(spark, sf, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return t.add_rows(more, order=["id"]).df


@registered("SELECT key AS id, count(*) AS n FROM (SELECT s_suppkey AS key FROM supplier UNION ALL SELECT n_nationkey FROM nation) GROUP BY key HAVING count(*) > 1")
def repeated_ids(spark, sf):
    t = Table.from_frame("names", read(spark, sf, "supplier", "s_suppkey", "s_name").withColumnRenamed("s_name", "name"), id_col="s_suppkey", pos_col="s_suppkey")
    more = read(spark, sf, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    return t.add_rows(more, order=["id"]).repeated_ids()


@registered("SELECT c_custkey AS id, c_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name")
def add_column(spark, sf):
    customer = table(spark, sf, "customer", "c_custkey", "c_name")
    counts = read(spark, sf, "customer", "c_custkey").join(read(spark, sf, "orders", "o_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias(POS)).agg(F.count("o_custkey").alias("value"))
    return customer.add_column(ColumnSpec("n_orders"), counts).df.drop(POS)


@registered("SELECT TRUE AS same, FALSE AS changed")
def table_equal(spark, sf):
    a = table(spark, sf, "nation", "n_nationkey", "n_name")
    b = Table(a.name, a.df.withColumn("n_name", F.upper("n_name")).withColumn("n_name", F.concat("n_name", F.lit("!"))), a.columns)
    return spark.createDataFrame([(a.equals(table(spark, sf, "nation", "n_nationkey", "n_name")), a.equals(b))], "same boolean, changed boolean")


# vocabularies


def _vocabulary(spark, sf) -> Vocabulary:
    rows = read(spark, sf, "nation").where("n_regionkey < 3")
    terms = rows.select(F.col("n_name").alias("term"), F.col("n_nationkey").cast("string").alias("id"), F.lit("a nation").alias("description"), F.concat(F.lit("NAT:"), F.col("n_nationkey")).alias("meaning"))
    return Vocabulary.from_frame("nations", terms, {"NAT": "http://example.org/nation/"})


def _named_customers(spark, sf) -> DataFrame:
    nation = read(spark, sf, "nation", "n_nationkey", "n_name")
    return read(spark, sf, "customer", "c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("nation"))


@registered("SELECT c_custkey, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey >= 3")
def vocabulary_violations(spark, sf):
    return _vocabulary(spark, sf).violations(_named_customers(spark, sf), "nation").select("c_custkey", "nation")


@registered("SELECT c_custkey, n_name AS nation, CAST(n_nationkey AS VARCHAR) AS term_id, 'a nation' AS term_description, 'http://example.org/nation/' || n_nationkey AS term_uri FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 3")
def vocabulary_lookup(spark, sf):
    return _vocabulary(spark, sf).lookup(_named_customers(spark, sf), "nation")


# references


def _event_refs(spark, sf) -> DataFrame:
    """Every event as a reference: users are objects, event types keys and entities."""
    e = read(spark, sf, "events", "event_id", "user_id", "event_type")
    return e.select(F.col("event_id").alias(POS), F.concat(F.lit("file"), F.pmod("user_id", F.lit(3))).alias("file_object_id"), F.concat(F.lit("user"), F.col("user_id")).alias("object_id"), F.lit("User").alias("object_type"), F.lit("").alias("relative_path"), F.lit("type").alias("field"), F.col("event_type").alias("key"), F.concat(F.lit("E:"), F.col("event_type")).alias("entity_id"), F.concat(F.lit("http://example.org/"), F.col("event_type")).alias("entity_uri"))


def _store(spark, sf) -> ReferenceStore:
    return ReferenceStore.empty(spark).add(_event_refs(spark, sf))


_PAIRS = "WITH p AS (SELECT 'file' || (user_id % 3) AS file_object_id, 'user' || user_id AS object_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) "


@registered(_PAIRS + "SELECT file_object_id, object_id, 'User' AS object_type, '' AS relative_path, 'type' AS field, event_type AS key, 'E:' || event_type AS entity_id, 'http://example.org/' || event_type AS entity_uri FROM p")
def refs_denormalise(spark, sf):
    return _store(spark, sf).joined().select("file_object_id", "object_id", "object_type", "relative_path", "field", "key", "entity_id", "entity_uri")


@registered("SELECT row_number() OVER (ORDER BY first) - 1 AS _pos, key FROM (SELECT user_id, event_type AS key, min(event_id) AS first FROM events GROUP BY user_id, event_type)")
def refs_upsert_keys(spark, sf):
    return _store(spark, sf).keys


@registered("SELECT row_number() OVER (ORDER BY first) - 1 AS _pos, object_id FROM (SELECT 'user' || user_id AS object_id, min(event_id) AS first FROM events GROUP BY user_id)")
def refs_upsert_objects(spark, sf):
    return _store(spark, sf).objects.select(POS, "object_id")


@registered("SELECT DISTINCT 'E:' || event_type AS entity_id, 'http://example.org/' || event_type AS entity_uri FROM events WHERE user_id = (SELECT min(user_id) FROM events)")
def refs_object_entities(spark, sf):
    least = read(spark, sf, "events", "user_id").agg(F.min("user_id")).first()[0]
    return _store(spark, sf).object_entities(f"user{least}", "", "type").select("entity_id", "entity_uri")


@registered(_PAIRS + "SELECT count(*) AS n FROM p")
def refs_object_type(spark, sf):
    return _store(spark, sf).by_object_type("User", "", "type").agg(F.count(F.lit(1)).alias("n"))


# types, trees and validation


@registered("SELECT event_id, regexp_full_match(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '\\d{4}-\\d{2}-\\d{2}(T\\d{2}:\\d{2}(:\\d{2}(\\.\\d{1,9})?)?(Z|[+-]\\d{2}:?\\d{2})?)?') AS is_time, regexp_full_match(event_type, '\\d{4}-\\d{2}-\\d{2}') AS is_type FROM events")
def iso_check(spark, sf):
    e = read(spark, sf, "events", "event_id", "ts", "event_type")
    return e.select("event_id", dtypes.is_iso8601(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("is_time"), dtypes.is_iso8601(F.col("event_type")).alias("is_type"))


def _tree(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A node table: region groups, nation groups within, a dataset of each nation's customers; every
    third nation lacks its key attribute, every fifth has it as text."""
    nation, reg = read(spark, sf, "nation"), read(spark, sf, "region")
    none = lambda kind: F.lit(None).cast(kind)
    node = lambda i, p, path, kind, name, dt, dtype, shape: (i.cast("long").alias("node_id"), p.alias("parent_id"), path.alias("path"), F.lit(kind).alias("kind"), name.alias("name"), F.lit("core").alias("namespace"), F.lit(dt).cast("string").alias("data_type"), F.concat(F.lit("o"), i).alias("object_id"), F.lit(dtype).cast("string").alias("dtype"), shape.alias("shape"), none("long").alias("link_target"))
    root = spark.range(1).select(*node(F.lit(0), none("long"), F.lit("/"), "group", F.lit("root"), "World", None, none("array<long>")))
    regions = reg.select(*node(F.col("r_regionkey") + 1, F.lit(0).cast("long"), F.concat(F.lit("/"), F.col("r_name")), "group", F.col("r_name"), "Region", None, none("array<long>")))
    both = nation.join(reg, F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.concat(F.lit("/"), F.col("r_name"), F.lit("/"), F.col("n_name"))
    nations = both.select(*node(F.col("n_nationkey") + 100, (F.col("r_regionkey") + 1).cast("long"), path, "group", F.col("n_name"), "Nation", None, none("array<long>")))
    counts = read(spark, sf, "customer", "c_nationkey").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    sets = both.join(counts, F.col("c_nationkey") == F.col("n_nationkey")).select(*node(F.col("n_nationkey") + 1000, (F.col("n_nationkey") + 100).cast("long"), F.concat(path, F.lit("/customers")), "dataset", F.lit("customers"), None, "long", F.array("n")))
    attrs = nation.where("n_nationkey % 3 <> 0").select((F.col("n_nationkey") + 100).cast("long").alias("node_id"), F.lit("key").alias("name"), F.when(F.col("n_nationkey") % 5 == 0, "utf").otherwise("int").alias("dtype"), none("array<long>").alias("shape"), F.col("n_nationkey").cast("string").alias("value"), none("long").alias("ref_target"))
    return root.unionByName(regions).unionByName(nations).unionByName(sets), attrs


def _catalog() -> Catalog:
    c = Catalog()
    place = Spec("group", type_def="Place")
    nation = Spec("group", type_def="Nation", type_inc="Place", attributes=(Attribute("key", dtype="int"),), children=(Spec("dataset", name="customers", dtype="long", shape=(None,)), Spec("dataset", name="notes", dtype="utf")))
    region_type = Spec("group", type_def="Region", type_inc="Place", children=(Spec("group", type_inc="Nation", quantity="+"),))
    for s in (place, nation, region_type, Spec("group", type_def="World", children=(Spec("group", type_inc="Place", quantity="*"),))):
        c.register(s)
    return c


@registered("""
SELECT 'MissingError' AS error, 'Nation/key' AS name, '/' || r_name || '/' || n_name AS location, 'argument missing' AS reason FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0
UNION ALL SELECT 'DtypeError', 'Nation/key', '/' || r_name || '/' || n_name || '.key', 'incorrect type - expected ''int'', got ''utf''' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0 AND n_nationkey % 5 = 0
UNION ALL SELECT 'MissingError', 'Nation/notes', '/' || r_name || '/' || n_name, 'argument missing' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'MissingError', 'Nation/customers', '/' || r_name || '/' || n_name, 'argument missing' FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer)""")
def validate_tree(spark, sf):
    return validate.validate(*_tree(spark, sf), _catalog())


@registered("SELECT '/' || r_name || '/' || n_name AS path, n_name AS name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def tree_descendants(spark, sf):
    return nodes.descendants(_tree(spark, sf)[0], "/ASIA").where("data_type = 'Nation'").select("path", "name")


@registered("SELECT * FROM (VALUES ('Place', 'Place', 0), ('Nation', 'Nation', 0), ('Nation', 'Place', 1), ('Region', 'Region', 0), ('Region', 'Place', 1), ('World', 'World', 0)) t(data_type, ancestor, distance)")
def type_closure(spark, sf):
    return _catalog().closure(spark)


@registered("SELECT r_name AS name, count(*) AS n_children FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def tree_children(spark, sf):
    return nodes.child_counts(_tree(spark, sf)[0]).where("data_type = 'Region'").select("name", "n_children")


# chunks, streams and sparse matrices


@registered("WITH k AS (SELECT event_id AS pos, event_id - row_number() OVER (ORDER BY event_id) AS g FROM events WHERE event_type <> 'view'), i AS (SELECT pos, min(pos) OVER (PARTITION BY g) AS s FROM k), b AS (SELECT s, (pos - s) // 3 AS c, min(pos) AS start, max(pos) + 1 AS stop FROM i GROUP BY ALL) SELECT start, stop, stop - start AS n FROM b")
def chunk_blocks(spark, sf):
    e = read(spark, sf, "events", "event_id", "event_type")
    return chunks.blocks(e.select(F.col("event_id").alias(POS), F.when(F.col("event_type") != "view", F.col("event_type")).alias("v")), "v", 3)


@registered("SELECT 0 AS axis, max(event_id) + 1 AS bound FROM events WHERE event_type <> 'view'")
def chunk_bounds(spark, sf):
    return chunks.bounds(chunk_blocks(spark, sf).select(F.array("stop").alias("stop")))


@registered("SELECT event_type, count(*) AS n_samples FROM events GROUP BY event_type")
def sample_count(spark, sf):
    return ingest.sample_count(read(spark, sf, "events", "event_id", "event_type"), "event_type")


@registered("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windowed_counts(spark, sf):
    counts = ingest.windowed_counts(read(spark, sf, "events", "ts", "event_type"), "ts", "event_type")
    return counts.select(F.col("window.start").alias("start"), "event_type", "n")


@registered("SELECT user_id AS _pos, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_chunk_wins(spark, sf):
    e = read(spark, sf, "events", "event_id", "user_id", "event_type")
    return ingest.latest(e.select(F.col("user_id").alias(POS), F.col("event_id").alias("_batch"), "event_type"))


@registered("SELECT o_orderstatus AS status, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY o_orderstatus")
def fold(spark, sf):
    """A user's fold over batches: partial results, then one merge for each key."""
    rows = read(spark, sf, "orders", "o_orderkey", "o_orderstatus").withColumnRenamed("o_orderstatus", "status")
    partial = lambda f: f.groupby("status", as_index=False).agg(n=("o_orderkey", "size"), keys=("o_orderkey", "sum"))
    merge = lambda f: f.groupby("status", as_index=False).sum()
    return ingest.process(rows, partial, merge, "status string, n long, keys long", "status")


@registered("SELECT max(event_id) + 1 AS length FROM events")
def chunk_extent(spark, sf):
    return ingest.extent(read(spark, sf, "events", "event_id").select(F.col("event_id").alias(POS)))


def _tile_value(bounds):
    import numpy as np

    (a, b), (c, d) = bounds
    return np.add.outer(1000 * np.arange(a, b), np.arange(c, d))


@registered("SELECT i // 10 AS tile_row, j // 20 AS tile_col, count(*) AS n, CAST(sum(1000 * i + j) AS DOUBLE) AS total FROM range(37) a(i), range(50) b(j) GROUP BY ALL")
def array_tiles(spark, sf):
    """An N-d array read in tiles, one partition each."""
    spark.dataSource.register(chunks.source_of(_tile_value))
    cells = spark.read.format("array_tiles").option("shape", "37,50").option("tile", "10,20").load()
    return cells.groupBy(F.col("tile")[0].alias("tile_row"), F.col("tile")[1].alias("tile_col")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@registered("SELECT user_id AS _pos, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def streamed_chunks(spark, sf):
    """Two streams of chunks drained side by side into one target each; the last write of a position wins."""
    folder = scratch(spark, "stream")
    e = read(spark, sf, "events", "event_id", "user_id", "event_type").select(F.col("user_id").alias(POS), "event_id", "event_type")
    for half in (0, 1):
        e.where(F.col(POS) % 2 == half).write.parquet(f"{folder}/in{half}")
    stream = lambda half: spark.readStream.schema(e.schema).parquet(f"{folder}/in{half}")
    ingest.exhaust(spark, [lambda half=half: ingest.write_chunks(stream(half), f"{folder}/out{half}", f"{folder}/log{half}") for half in (0, 1)])
    both = ingest.read_chunks(spark, f"{folder}/out0").unionByName(ingest.read_chunks(spark, f"{folder}/out1"))
    return ingest.latest(both.drop("_batch"), "event_id")


_CSR = "WITH c AS (SELECT c_nationkey AS r, c_custkey % 7 AS c, count(*) AS v FROM customer GROUP BY ALL) "


@registered(_CSR + "SELECT CAST(n_nationkey AS BIGINT) AS _pos, coalesce(string_agg(CAST(c.c AS VARCHAR), ',' ORDER BY c.c), '') AS indices, coalesce(string_agg(CAST(c.v AS VARCHAR), ',' ORDER BY c.c), '') AS data, CAST(sum(count(c.c)) OVER (ORDER BY n_nationkey) AS BIGINT) AS indptr_end FROM nation LEFT JOIN c ON c.r = n_nationkey GROUP BY n_nationkey")
def csr_build(spark, sf):
    cells = read(spark, sf, "customer", "c_custkey", "c_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("row"), F.pmod("c_custkey", F.lit(7)).cast("long").alias("col")).agg(F.count(F.lit(1)).alias("value"))
    rows = sparse.csr_rows(cells, 25)
    return rows.select(POS, F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"), F.coalesce(F.array_join(F.col("data").cast("array<string>"), ","), F.lit("")).alias("data"), "indptr_end")


@registered(_CSR + "SELECT CAST(a.r AS BIGINT) AS row, CAST(b.r AS BIGINT) AS col, CAST(sum(a.v * b.v) AS BIGINT) AS value FROM c a JOIN c b ON a.c = b.c GROUP BY a.r, b.r")
def sparse_multiply(spark, sf):
    cells = read(spark, sf, "customer", "c_custkey", "c_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("row"), F.pmod("c_custkey", F.lit(7)).cast("long").alias("col")).agg(F.count(F.lit(1)).alias("value"))
    return sparse.multiply(cells, cells.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))


@registered("SELECT CAST(c_nationkey AS BIGINT) AS row, CAST(c AS BIGINT) AS col, v AS value FROM (SELECT c_nationkey, c_custkey % 3 AS c, count(*) AS v FROM customer GROUP BY ALL)")
def sparse_from_dense(spark, sf):
    """The non-zero cells of rows held as arrays."""
    k = F.pmod("c_custkey", F.lit(3))
    dense = read(spark, sf, "customer", "c_custkey", "c_nationkey").groupBy(F.col("c_nationkey").cast("long").alias(POS)).agg(F.array(*[F.count(F.when(k == i, 1)) for i in range(3)]).alias("v"))
    return sparse.from_dense(dense, "v")


@registered(_CSR + "SELECT CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col, v AS value FROM c")
def sparse_round_trip(spark, sf):
    """Cells as compressed rows and back."""
    cells = read(spark, sf, "customer", "c_custkey", "c_nationkey").groupBy(F.col("c_nationkey").cast("long").alias("row"), F.pmod("c_custkey", F.lit(7)).cast("long").alias("col")).agg(F.count(F.lit(1)).alias("value"))
    return sparse.to_cells(sparse.csr_rows(cells, 25))
