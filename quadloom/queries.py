"""Registered graph queries over the tables, and the same in SQL on the tables themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions import filters as FF
from quadloom.functions import terms as T
from quadloom.languages import chains, graphql, sexp, steps, templates
from quadloom.operators import dedup, graph_stream, inference, records
from quadloom.plans.path import Path
from quadloom.sources import formats, nquads
from quadloom.sources.tables import Cell, Mapping, Node, Value, cell_quads, cells, node
from quadloom.storage import Scratch
from quadloom.store import GraphStore
from quadloom.streaming import deltas

MAPPINGS = {
    "region": Mapping(("region", "r_regionkey"), {}, ("r_name",)),
    "nation": Mapping(("nation", "n_nationkey"), {"n_regionkey": "region"}, ("n_name",)),
    "customer": Mapping(("customer", "c_custkey"), {"c_nationkey": "nation"}, ("c_name", "c_acctbal", "c_mktsegment")),
    "supplier": Mapping(("supplier", "s_suppkey"), {"s_nationkey": "nation"}, ("s_name", "s_acctbal")),
    "part": Mapping(("part", "p_partkey"), {}, ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    "orders": Mapping(("order", "o_orderkey"), {"o_custkey": "customer"}, ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
    "events": Mapping(("event", "event_id"), {"user_id": "user"}, ("ts", "event_type", "value")),
    "documents": Mapping(("doc", "doc_id"), {}, ("lang", "source", "n_chars")),
}
LABELLED_ORDERS = Mapping(("order", "o_orderkey"), {"o_custkey": "customer"}, ("o_orderpriority",), label="o_orderstatus")


def iri(x) -> T.IRI:
    return T.IRI(x)


def number(c) -> Column:
    """The number at the end of a node's IRI."""
    return F.regexp_extract(c, r"(\d+)>$", 1).cast("long")


def kind(c) -> Column:
    return F.regexp_extract(c, r"^<([a-z]+)/", 1)


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(spark, sf_dir, *names) -> list[Cell]:
    return [c for n in names for c in cells(table(spark, sf_dir, n), MAPPINGS[n])]


def graph(spark, sf_dir, *names) -> GraphStore:
    return GraphStore.of_cells(columns(spark, sf_dir, *names))


def edges_of_items(spark, sf_dir) -> list[Cell]:
    """order -has_part-> part, part -supplied_by-> supplier: distinct edges of lineitem, which has no key of its own."""
    items, part = table(spark, sf_dir, "lineitem"), Node("part", ("l_partkey",))
    return [
        Cell(items.select("l_orderkey", "l_partkey").distinct(), "<has_part>", Node("order", ("l_orderkey",)), part),
        Cell(items.select("l_partkey", "l_suppkey").distinct(), "<supplied_by>", part, Node("supplier", ("l_suppkey",))),
    ]


def items_graph(spark, sf_dir, *names) -> GraphStore:
    return GraphStore.of_cells([*edges_of_items(spark, sf_dir), *columns(spark, sf_dir, *names)])


def turns_graph(spark, sf_dir) -> GraphStore:
    t = table(spark, sf_dir, "conversations").withColumn("before", F.col("turn") - 1)
    turn = Node("turn", ("conv_id", "turn"))
    return GraphStore.of_cells([Cell(t.where("turn > 0"), "<next>", Node("turn", ("conv_id", "before")), turn), Cell(t, "<role>", turn, Value("role"))])


def turn_ids(c: str) -> list[Column]:
    return [F.regexp_extract(c, r"^<turn/(-?\d+)/", 1).cast("long").alias(f"{c}_conv"), F.regexp_extract(c, r"/(\d+)>$", 1).cast("long").alias(f"{c}_turn")]


QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# Scans


@query("SELECT '<region/' || r_regionkey || '>' AS id FROM region UNION SELECT '\"' || r_name || '\"' FROM region UNION SELECT '<nation/' || n_nationkey || '>' FROM nation UNION SELECT '\"' || n_name || '\"' FROM nation UNION SELECT '<r_name>' UNION SELECT '<n_name>' UNION SELECT '<n_regionkey>'")
def all_nodes(spark, sf_dir):
    return graph(spark, sf_dir, "region", "nation").V().to_df()


@query("SELECT count(*)::BIGINT AS n_quads, count(DISTINCT s)::BIGINT AS n_subjects FROM (SELECT c_custkey AS s FROM customer WHERE c_nationkey IS NOT NULL UNION ALL SELECT c_custkey FROM customer WHERE c_name IS NOT NULL UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal IS NOT NULL UNION ALL SELECT c_custkey FROM customer WHERE c_mktsegment IS NOT NULL)")
def all_quads(spark, sf_dir):
    return graph(spark, sf_dir, "customer").quads.agg(F.count("*").alias("n_quads"), F.countDistinct("s").alias("n_subjects"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey IN (3, 5)")
def filter_quads(spark, sf_dir):
    q = graph(spark, sf_dir, "customer").filter_quads(predicates=[iri("c_nationkey")], objects=[iri("nation/3"), iri("nation/5")])
    return q.select(number("s").alias("c_custkey"))


@query("SELECT c_name FROM customer WHERE c_custkey IN (1, 2, 11)")
def is_start(spark, sf_dir):
    df = graph(spark, sf_dir, "customer").V(iri("customer/1"), iri("customer/2"), iri("customer/11")).out(iri("c_name")).to_df()
    return df.select(T.text(F.col("id")).alias("c_name"))


@query("SELECT 'str' AS kind, n_name AS str, NULL::BIGINT AS i FROM nation UNION SELECT 'int', NULL, p_size::BIGINT FROM part")
def typed_nodes(spark, sf_dir):
    nodes = graph(spark, sf_dir, "nation").nodes().where("kind = 'str'").union(graph(spark, sf_dir, "part").nodes().where("kind = 'int'"))
    return nodes.select("kind", F.when(F.col("kind") == "str", F.col("str")).alias("str"), "i")


# Hops


@query("SELECT c_custkey, c_nationkey::BIGINT AS n_nationkey FROM customer")
def out_hop(spark, sf_dir):
    df = graph(spark, sf_dir, "customer", "nation").V().tag("c").out(iri("c_nationkey")).to_df()
    return df.select(number("c").alias("c_custkey"), number("id").alias("n_nationkey"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 7")
def in_hop(spark, sf_dir):
    return graph(spark, sf_dir, "customer", "nation").V(iri("nation/7")).in_(iri("c_nationkey")).to_df().select(number("id").alias("c_custkey"))


@query("SELECT 'region' AS kind, n_regionkey::BIGINT AS key FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_nationkey < 3")
def both_hop(spark, sf_dir):
    df = graph(spark, sf_dir, "customer", "nation").V(*(iri(f"nation/{k}") for k in range(3))).both(iri("n_regionkey"), iri("c_nationkey")).to_df()
    return df.select(kind("id").alias("kind"), number("id").alias("key"))


@query("SELECT 'c_nationkey' AS pred, c_custkey AS key, c_nationkey::BIGINT AS nation FROM customer UNION ALL SELECT 's_nationkey', s_suppkey, s_nationkey FROM supplier")
def via_path(spark, sf_dir):
    """Predicates that a path gives, and a tag for the one taken."""
    g = graph(spark, sf_dir, "customer", "supplier")
    g = GraphStore(g.quads.unionByName(GraphStore.of(spark, [(iri("home"), iri("uses"), iri("c_nationkey")), (iri("home"), iri("uses"), iri("s_nationkey"))]).quads))
    df = g.V().tag("x").out(Path().start(iri("home")).out(iri("uses")), tags=("p",)).to_df()
    return df.select(F.regexp_extract("p", "<(.*)>", 1).alias("pred"), number("x").alias("key"), number("id").alias("nation"))


@query("SELECT o_orderkey, c_custkey, c_nationkey::BIGINT AS n_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def tag_multi_hop(spark, sf_dir):
    df = graph(spark, sf_dir, "orders", "customer").V().tag("o").out(iri("o_custkey")).tag("c").out(iri("c_nationkey")).to_df()
    return df.select(number("o").alias("o_orderkey"), number("c").alias("c_custkey"), number("id").alias("n_nationkey"))


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def follow(spark, sf_dir):
    """A morphism backwards: regions to orders."""
    up = Path.morphism().out(iri("o_custkey")).out(iri("c_nationkey")).out(iri("n_regionkey"))
    return graph(spark, sf_dir, "orders", "customer", "nation").V(iri("region/2")).follow_reverse(up).to_df().select(number("id").alias("o_orderkey"))


@query("SELECT o_orderkey, n_regionkey::BIGINT AS r_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT'")
def follow_forward(spark, sf_dir):
    up = Path.morphism().out(iri("o_custkey")).out(iri("c_nationkey")).out(iri("n_regionkey"))
    df = graph(spark, sf_dir, "orders", "customer", "nation").V().has(iri("o_orderpriority"), "1-URGENT").tag("o").follow(up).to_df()
    return df.select(number("o").alias("o_orderkey"), number("id").alias("r_regionkey"))


# Has and save


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def has_value(spark, sf_dir):
    return graph(spark, sf_dir, "customer").V().has(iri("c_mktsegment"), "BUILDING").to_df().select(number("id").alias("c_custkey"))


@query("SELECT l_partkey AS p_partkey, count(*)::BIGINT AS n FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) GROUP BY 1")
def has_any(spark, sf_dir):
    """A bag: a node stands once per quad that it has."""
    return GraphStore.of_cells(edges_of_items(spark, sf_dir)).V().has(iri("supplied_by")).to_df().groupBy(number("id").alias("p_partkey")).agg(F.count("*").alias("n"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey FROM nation JOIN customer ON n_nationkey = c_nationkey WHERE c_custkey IN (1, 4, 9)")
def has_reverse(spark, sf_dir):
    p = graph(spark, sf_dir, "customer", "nation").V().has_reverse(iri("c_nationkey"), iri("customer/1"), iri("customer/4"), iri("customer/9"))
    return p.to_df().select(number("id").alias("n_nationkey"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000.0 AND c_acctbal <= 9000.5")
def has_filter(spark, sf_dir):
    p = graph(spark, sf_dir, "customer").V().has_filter(iri("c_acctbal"), False, FF.gt(5000.0), FF.lte(9000.5))
    return p.to_df().select(number("id").alias("c_custkey"))


@query("SELECT c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
def has_path(spark, sf_dir):
    p = graph(spark, sf_dir, "customer", "orders").V().has_path(Path().in_(iri("o_custkey")).has(iri("o_orderpriority"), "1-URGENT"))
    return p.to_df().select(number("id").alias("c_custkey"))


@query("SELECT c_custkey, c_mktsegment AS segment FROM customer WHERE c_nationkey = 4")
def save(spark, sf_dir):
    df = graph(spark, sf_dir, "customer").V().has(iri("c_nationkey"), iri("nation/4")).save(iri("c_mktsegment"), "segment").to_df()
    return df.select(number("id").alias("c_custkey"), T.text(F.col("segment")).alias("segment"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey")
def save_reverse(spark, sf_dir):
    df = graph(spark, sf_dir, "nation", "supplier").V().has(iri("n_name")).save_reverse(iri("s_nationkey"), "supplier").to_df()
    return df.select(number("id").alias("n_nationkey"), number("supplier").alias("s_suppkey"))


@query("SELECT d.doc_id, quality::BIGINT AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND quality IS NOT NULL")
def save_optional(spark, sf_dir):
    docs = graph(spark, sf_dir, "documents").quads.unionByName(cell_quads(table(spark, sf_dir, "labels"), Mapping(("doc", "doc_id"), {}, ("quality",))))
    df = GraphStore(docs).V().has(iri("n_chars")).save_optional(iri("quality"), "q").to_df()
    return df.select(number("id").alias("doc_id"), T.int_value(F.col("q")).alias("quality"))


@query("SELECT n_nationkey::BIGINT AS n_nationkey, s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey")
def save_optional_reverse(spark, sf_dir):
    df = graph(spark, sf_dir, "nation", "supplier").V().has(iri("n_name")).save_optional_reverse(iri("s_nationkey"), "supplier").to_df()
    return df.select(number("id").alias("n_nationkey"), number("supplier").alias("s_suppkey"))


@query("SELECT c_custkey, count(*)::BIGINT AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'F' GROUP BY 1")
def back(spark, sf_dir):
    """Back to the tagged node, a row per way taken."""
    p = graph(spark, sf_dir, "customer", "orders").V().has(iri("c_name")).tag("c").in_(iri("o_custkey")).has(iri("o_orderstatus"), "F").back("c")
    return p.to_df().groupBy(number("id").alias("c_custkey")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '2-HIGH') ON o_custkey = c_custkey WHERE c_nationkey = 1")
def optional(spark, sf_dir):
    p = graph(spark, sf_dir, "customer", "orders").V(iri("nation/1")).in_(iri("c_nationkey")).optional(Path().in_(iri("o_custkey")).has(iri("o_orderpriority"), "2-HIGH").tag("o"))
    return p.to_df().select(number("id").alias("c_custkey"), number("o").alias("o_orderkey"))


# Recursion


@query("WITH RECURSIVE r AS (SELECT conv_id, turn, 0::BIGINT AS depth FROM conversations WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, depth + 1 FROM r JOIN conversations c ON c.conv_id = r.conv_id AND c.turn = r.turn + 1) SELECT conv_id AS start_conv, 0::BIGINT AS start_turn, conv_id AS id_conv, turn AS id_turn, depth FROM r WHERE depth > 0")
def follow_recursive(spark, sf_dir):
    starts = Path().has(iri("next")).except_(Path().has_reverse(iri("next"))).unique()
    df = turns_graph(spark, sf_dir).V().and_(starts).tag("start").follow_recursive(iri("next"), -1, ("depth",)).to_df()
    return df.select(*turn_ids("start"), *turn_ids("id"), T.int_value(F.col("depth")).alias("depth"))


@query("SELECT conv_id AS id_conv, turn AS id_turn, turn AS depth FROM conversations WHERE turn BETWEEN 1 AND 3")
def follow_recursive_bounded(spark, sf_dir):
    starts = Path().has(iri("next")).except_(Path().has_reverse(iri("next"))).unique()
    df = turns_graph(spark, sf_dir).V().and_(starts).follow_recursive(iri("next"), 3, ("depth",)).to_df()
    return df.select(*turn_ids("id"), T.int_value(F.col("depth")).alias("depth"))


@query("WITH RECURSIVE r AS (SELECT 'o' AS k, o_custkey AS x, 1::BIGINT AS depth FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders) UNION ALL SELECT CASE k WHEN 'o' THEN 'c' WHEN 'c' THEN 'n' END, CASE k WHEN 'o' THEN c_nationkey WHEN 'c' THEN n_regionkey END, depth + 1 FROM r LEFT JOIN customer ON k = 'o' AND x = c_custkey LEFT JOIN nation ON k = 'c' AND x = n_nationkey WHERE depth < 3) SELECT CASE k WHEN 'o' THEN 'customer' WHEN 'c' THEN 'nation' ELSE 'region' END AS kind, x::BIGINT AS key, depth FROM r")
def recursive_path(spark, sf_dir):
    """Recursion over a path of several predicates."""
    g = graph(spark, sf_dir, "orders", "customer", "nation")
    first = table(spark, sf_dir, "orders").agg(F.min("o_orderkey")).first()[0]
    df = g.V(iri(f"order/{first}")).follow_recursive(Path().out(iri("o_custkey"), iri("c_nationkey"), iri("n_regionkey")), 0, ("depth",)).to_df()
    return df.select(kind("id").alias("kind"), number("id").alias("key"), T.int_value(F.col("depth")).alias("depth"))


# Sets


@query("SELECT a.l_orderkey AS o_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey BETWEEN 1 AND 40) a JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_partkey BETWEEN 41 AND 80) b USING (l_orderkey)")
def intersect(spark, sf_dir):
    g = GraphStore.of_cells(edges_of_items(spark, sf_dir))
    some = lambda a, b: g.V(*(iri(f"part/{k}") for k in range(a, b + 1))).in_(iri("has_part")).unique()
    return some(1, 40).and_(some(41, 80)).to_df().select(number("id").alias("o_orderkey"))


@query("SELECT c_custkey AS key FROM customer WHERE c_nationkey = 1 UNION ALL SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'")
def union(spark, sf_dir):
    g = graph(spark, sf_dir, "customer")
    return g.V(iri("nation/1")).in_(iri("c_nationkey")).or_(g.V("MACHINERY").in_(iri("c_mktsegment"))).to_df().select(number("id").alias("key"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def except_(spark, sf_dir):
    p = graph(spark, sf_dir, "customer", "orders").V().has(iri("c_mktsegment"), "BUILDING").except_(Path().has(iri("o_orderpriority"), "1-URGENT").out(iri("o_custkey")))
    return p.to_df().select(number("id").alias("c_custkey"))


@query("SELECT DISTINCT c_nationkey::BIGINT AS n_nationkey FROM orders JOIN customer ON o_custkey = c_custkey")
def unique(spark, sf_dir):
    return graph(spark, sf_dir, "customer", "orders").V().out(iri("o_custkey")).out(iri("c_nationkey")).unique().to_df().select(number("id").alias("n_nationkey"))


# Labels and predicates


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O'")
def label_context(spark, sf_dir):
    g = GraphStore.of_cells(cells(table(spark, sf_dir, "orders"), LABELLED_ORDERS))
    return g.V().label_context(iri("O")).tag("o").out(iri("o_custkey")).to_df().select(number("o").alias("o_orderkey"), number("id").alias("o_custkey"))


@query("SELECT DISTINCT o_orderstatus AS label FROM orders")
def labels(spark, sf_dir):
    g = GraphStore.of_cells(cells(table(spark, sf_dir, "orders"), LABELLED_ORDERS))
    return g.V().has(iri("o_custkey")).labels().to_df().select(T.text(F.col("id")).alias("label"))


@query("SELECT unnest(['c_nationkey', 's_nationkey']) AS predicate")
def in_predicates(spark, sf_dir):
    return graph(spark, sf_dir, "customer", "supplier").V(*(iri(f"nation/{k}") for k in range(25))).in_predicates().to_df().select(T.text(F.col("id")).alias("predicate"))


@query("SELECT unnest(['c_nationkey', 'c_name', 'c_acctbal', 'c_mktsegment']) AS predicate")
def out_predicates(spark, sf_dir):
    return graph(spark, sf_dir, "customer", "nation").V(iri("customer/1")).out_predicates().to_df().select(T.text(F.col("id")).alias("predicate"))


@query("SELECT predicate, count(*)::BIGINT AS n FROM (SELECT unnest(['n_name', 'n_regionkey']) AS predicate FROM nation) GROUP BY 1")
def save_predicates(spark, sf_dir):
    df = graph(spark, sf_dir, "nation").V().save_predicates(False, "p").to_df()
    return df.groupBy(T.text(F.col("p")).alias("predicate")).agg(F.count("*").alias("n"))


# Filters


@query("SELECT DISTINCT p_size::BIGINT AS p_size FROM part WHERE p_size >= 20 AND p_size < 35")
def compare_int(spark, sf_dir):
    return graph(spark, sf_dir, "part").V().out(iri("p_size")).filters(FF.gte(20), FF.lt(35)).unique().to_df().select(T.int_value(F.col("id")).alias("p_size"))


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > 910.25")
def compare_float(spark, sf_dir):
    df = graph(spark, sf_dir, "part").V().tag("p").out(iri("p_retailprice")).filter(">", 910.25).to_df()
    return df.select(number("p").alias("p_partkey"), T.float_value(F.col("id")).alias("p_retailprice"))


@query("SELECT c_name FROM customer WHERE c_name > 'Customer#000000100' AND c_name <= 'Customer#000000120'")
def compare_string(spark, sf_dir):
    df = graph(spark, sf_dir, "customer").V().out(iri("c_name")).filters(FF.gt("Customer#000000100"), FF.lte("Customer#000000120")).to_df()
    return df.select(T.text(F.col("id")).alias("c_name"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT min(ts) + INTERVAL 10 DAY FROM events)")
def compare_time(spark, sf_dir):
    first = table(spark, sf_dir, "events").agg((F.min("ts") + F.expr("INTERVAL 10 DAY")).alias("t"))
    first = first.select(T.KEY_OF[first.dtypes[0][1]](F.col("t"))).first()[0]
    df = graph(spark, sf_dir, "events").V().tag("e").out(iri("ts")).filters(FF.gte(T.Raw(first))).to_df()
    return df.select(number("e").alias("event_id"))


@query("SELECT c_custkey FROM customer WHERE 'customer/' || c_custkey > 'customer/5' AND 'customer/' || c_custkey < 'customer/7'")
def compare_iri(spark, sf_dir):
    df = graph(spark, sf_dir, "customer").V().has(iri("c_name")).filters(FF.gt(iri("customer/5")), FF.lt(iri("customer/7"))).to_df()
    return df.select(number("id").alias("c_custkey"))


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_name, 'l[de]?.*[gi]n|^h.*t$')")
def regex(spark, sf_dir):
    return graph(spark, sf_dir, "part").V().tag("p").out(iri("p_name")).regex("l[de]?.*[gi]n|^h.*t$").to_df().select(number("p").alias("p_partkey"))


@query("SELECT c_custkey FROM customer WHERE regexp_matches('customer/' || c_custkey, 'r/1?2$')")
def regex_refs(spark, sf_dir):
    return graph(spark, sf_dir, "customer").V().has(iri("c_name")).regex_with_refs("r/1?2$").to_df().select(number("id").alias("c_custkey"))


@query("SELECT p_partkey FROM part WHERE p_type LIKE '%_TEEL' OR p_brand LIKE 'Brand#1_'")
def like(spark, sf_dir):
    g = graph(spark, sf_dir, "part")
    df = g.V().has_filter(iri("p_type"), False, FF.like("%?TEEL")).or_(g.V().has_filter(iri("p_brand"), False, FF.like("Brand#1?"))).unique().to_df()
    return df.select(number("id").alias("p_partkey"))


@query("SELECT c_name FROM customer ORDER BY c_name LIMIT 20 OFFSET 30")
def order_skip_limit(spark, sf_dir):
    return graph(spark, sf_dir, "customer").V().out(iri("c_name")).order().skip(30).limit(20).to_df().select(T.text(F.col("id")).alias("c_name"))


@query("SELECT count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey")
def count(spark, sf_dir):
    df = graph(spark, sf_dir, "orders", "customer").V().out(iri("o_custkey")).out(iri("c_nationkey")).count().to_df()
    return df.select(T.int_value(F.col("id")).alias("n"))


# The published workload's shapes


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 7 AND o_orderpriority = '1-URGENT'")
def two_branches(spark, sf_dir):
    """Orders that are reached from a nation over its customers, and from a priority."""
    g = graph(spark, sf_dir, "orders", "customer")
    return g.V(iri("nation/7")).in_(iri("c_nationkey")).in_(iri("o_custkey")).and_(g.V("1-URGENT").in_(iri("o_orderpriority"))).to_df().select(number("id").alias("o_orderkey"))


@query(
    "SELECT c.c_custkey, count(*)::BIGINT AS n FROM customer c JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') a ON a.o_custkey = c_custkey JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') b ON b.o_custkey = c_custkey JOIN orders o ON o.o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1"
)
def three_branches(spark, sf_dir):
    """Three large sets reached over followed paths, and a way back."""
    g = graph(spark, sf_dir, "orders", "customer")
    reached = lambda p, v: g.V(v).in_(iri(p)).out(iri("o_custkey")).unique()
    both = reached("o_orderpriority", "1-URGENT").and_(reached("o_orderstatus", "F")).and_(g.V("BUILDING").in_(iri("c_mktsegment")))
    return both.tag("c").in_(iri("o_custkey")).to_df().groupBy(number("c").alias("c_custkey")).agg(F.count("*").alias("n"))


@query("SELECT n_regionkey::BIGINT AS r_regionkey, count(*)::BIGINT AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) USING (l_partkey) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def four_hops(spark, sf_dir):
    """An unanchored walk."""
    p = items_graph(spark, sf_dir, "supplier", "nation").V().out(iri("has_part")).out(iri("supplied_by")).out(iri("s_nationkey")).out(iri("n_regionkey"))
    return p.counted().groupBy(number("id").alias("r_regionkey")).agg(F.sum("n").alias("n"))


# Languages


@query(ORACLES["tag_multi_hop"])
def chain_script(spark, sf_dir):
    script = 'var up = g.M().out("<o_custkey>").tag("c").out("<c_nationkey>"); g.V().tag("o").follow(up).all()'
    df = chains.frame(graph(spark, sf_dir, "orders", "customer"), script)
    return df.select(number("o").alias("o_orderkey"), number("c").alias("c_custkey"), number("id").alias("n_nationkey"))


@query("SELECT r_name, n_name, list_sort(list(c_custkey)) AS customers FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2")
def graphql_nested(spark, sf_dir):
    df = graphql.frame(graph(spark, sf_dir, "region", "nation", "customer"), '{ regions { r_name n_regionkey @rev { n_name c_nationkey(c_mktsegment: "BUILDING") @rev { id } } } }')
    df = df.select(F.col("f0")[0].alias("r"), F.explode("f1").alias("n")).select("r", F.col("n.f0")[0].alias("n"), F.col("n.f1").alias("c")).where(F.size("c") > 0)
    return df.select(T.text(F.col("r")).alias("r_name"), T.text(F.col("n")).alias("n_name"), F.array_sort(F.transform("c", lambda c: number(c["id"]))).alias("customers"))


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'HOUSEHOLD'")
def json_template(spark, sf_dir):
    df = templates.frame(graph(spark, sf_dir, "customer", "nation"), '[{"id": null, "<c_mktsegment>": "HOUSEHOLD", "<c_name>": null, "<c_nationkey>": {"<n_name>": null}}]')
    return df.select(number("id").alias("c_custkey"), T.text(F.col("f2")[0]).alias("c_name"), T.text(F.col("f3")[0]["f0"][0]).alias("n_name"))


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def s_expression(spark, sf_dir):
    df = sexp.frame(graph(spark, sf_dir, "orders", "customer"), '($o (:<o_custkey> ($c (:<c_mktsegment> "BUILDING"))))')
    return df.select(number("$o").alias("o_orderkey"), number("$c").alias("c_custkey"))


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def step_match(spark, sf_dir):
    q = {"@type": "Match", "pattern": {"http://t/c_mktsegment": "BUILDING", "http://t/c_nationkey": {"@id": "nation/3"}}}
    g = graph(spark, sf_dir, "customer").quads.withColumn("p", F.concat(F.lit("<http://t/"), F.substring("p", 2, 100)))
    return steps.frame(GraphStore(g), q).select(number("id").alias("c_custkey"))


@query("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 1000.0")
def step_select(spark, sf_dir):
    high = {"@type": "Where", "from": {"@type": "Match", "pattern": {}}, "condition": {"@type": "GreaterThan", "from": {"@type": "Visit", "from": {"@type": "Placeholder"}, "properties": "s_acctbal"}, "value": {"@value": "1000", "@type": T.FLOAT}}}
    q = {"@type": "Select", "from": {"@type": "Properties", "names": ["n_name"], "from": {"@type": "Visit", "properties": ["s_nationkey"], "from": {"@type": "As", "name": "s", "from": high}}}, "tags": ["s", "n_name"]}
    return steps.frame(graph(spark, sf_dir, "supplier", "nation"), q).select(number("s").alias("s_suppkey"), T.text(F.col("n_name")).alias("n_name"))


@query("SELECT n_regionkey::BIGINT AS r_regionkey, n_nationkey::BIGINT AS n_nationkey FROM nation")
def step_collect(spark, sf_dir):
    """RDF lists: the nations of a region, in order."""
    n, none = table(spark, sf_dir, "nation"), F.lit(None).cast("string").alias("l")
    cells = n.selectExpr("n_regionkey AS r", "n_nationkey AS n", "lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS after", "row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k")
    rest = F.when(F.col("after").isNull(), T.key(steps.jsonld.NIL)).otherwise(node("cell", "r", "after"))
    q = cells.where("k = 1").select(node("region", "r").alias("s"), F.lit("<nations>").alias("p"), node("cell", "r", "n").alias("o"), none)
    q = q.union(cells.select(node("cell", "r", "n"), F.lit(f"<{steps.FIRST}>"), node("nation", "n"), none)).union(cells.select(node("cell", "r", "n"), F.lit(f"<{steps.REST}>"), rest, none))
    df = steps.frame(GraphStore(q), {"@type": "Select", "from": {"@type": "Collect", "from": {"@type": "Match", "pattern": {}}, "name": "nations"}, "tags": [steps.FIRST]})
    return df.where(F.col(f"`{steps.FIRST}`").isNotNull()).select(F.regexp_extract("id", r"<cell/(\d+)/", 1).cast("long").alias("r_regionkey"), number(F.col(f"`{steps.FIRST}`")).alias("n_nationkey"))


# Records, closures, tools, writes


@query("SELECT n_nationkey::BIGINT AS id, n_name, r_regionkey::BIGINT AS region, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def record_load(spark, sf_dir):
    region = records.Record((records.Prop("name", iri("r_name")),))
    nation = records.Record((records.Prop("name", iri("n_name")), records.Prop("region", iri("n_regionkey"), region)))
    df = records.load(graph(spark, sf_dir, "nation", "region"), nation)
    return df.select(number("id").alias("id"), F.col("name").alias("n_name"), number("region.id").alias("region"), F.col("region.name").alias("r_name"))


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def record_write(spark, sf_dir):
    """Rows to quads and back."""
    supplier = records.Record((records.Prop("s_name", iri("http://t/name")), records.Prop("s_acctbal", iri("http://t/balance"), "double")), type=iri("http://t/Supplier"))
    rows = table(spark, sf_dir, "supplier").select(node("supplier", "s_suppkey").alias("id"), "s_name", "s_acctbal")
    return records.load(GraphStore(records.to_quads(rows, supplier)), supplier).select(number("id").alias("s_suppkey"), "s_name", "s_acctbal")


@query(
    "WITH RECURSIVE e AS (SELECT DISTINCT '<part/' || p_brand || '>' AS a, '<part/' || substr(p_brand, 1, 7) || '>' AS b FROM part UNION SELECT DISTINCT '<part/' || substr(p_brand, 1, 7) || '>', '<part/all>' FROM part), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS sub, b AS super FROM r WHERE a != b"
)
def rdfs_closure(spark, sf_dir):
    """Sub-classes of a hierarchy: brand, maker, all parts."""
    sub = f"<{inference.SUB_CLASS}>"
    p, maker = table(spark, sf_dir, "part"), F.substring("p_brand", 1, 7)
    q = p.select(node("part", "p_brand").alias("s"), F.lit(sub).alias("p"), node("part", maker).alias("o")).union(p.select(node("part", maker), F.lit(sub), F.lit("<part/all>"))).distinct()
    df = inference.Schema(GraphStore(q.withColumn("l", F.lit(None).cast("string")))).sub_classes()
    return df.where(f"sub != super AND super != '<{inference.RESOURCE}>'")


@query("SELECT p_brand, p_size::BIGINT AS p_size, count(*)::BIGINT AS n_equal FROM part GROUP BY 1, 2")
def node_dedup(spark, sf_dir):
    """Parts of equal brand and size are one node."""
    q = cell_quads(table(spark, sf_dir, "part"), Mapping(("part", "p_partkey"), {}, ("p_brand", "p_size")))
    typed = q.select("s").distinct().select("s", F.lit(T.key(records.RDF_TYPE)).alias("p"), F.lit("<Part>").alias("o"), F.lit(None).cast("string").alias("l"))
    g = GraphStore(q.unionByName(typed))
    n = dedup.equal_nodes(g, iri("Part")).groupBy("keep").agg(F.count("*").alias("n_equal"))
    props = records.load(g, records.Record((records.Prop("p_brand", iri("p_brand")), records.Prop("p_size", iri("p_size"), "bigint"))))
    return n.join(props, F.col("keep") == F.col("id")).select("p_brand", "p_size", "n_equal")


@query("SELECT c_custkey, n_nationkey::BIGINT AS n_nationkey FROM (SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 5 ELSE c_nationkey END AS n_nationkey FROM customer)")
def tx_apply(spark, sf_dir):
    """A transaction that moves all customers of one nation to another."""
    g = graph(spark, sf_dir, "customer")
    old = g.filter_quads(predicates=[iri("c_nationkey")], objects=[iri("nation/3")])
    moves = old.withColumn("action", F.lit(-1)).union(old.withColumn("o", F.lit("<nation/5>")).withColumn("action", F.lit(1)))
    df = g.apply(moves).V().tag("c").out(iri("c_nationkey")).to_df()
    return df.select(number("c").alias("c_custkey"), number("id").alias("n_nationkey"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey != 3")
def remove_node(spark, sf_dir):
    return graph(spark, sf_dir, "customer").remove_node(iri("nation/3")).V().has(iri("c_nationkey")).to_df().select(number("id").alias("c_custkey"))


def _roundtrip(spark, sf_dir, kind):
    scratch = Scratch(spark, "roundtrip")
    formats.write(graph(spark, sf_dir, "part", "events").quads, scratch.path("quads"), kind)
    g = GraphStore(formats.read(spark, scratch.path("quads"), kind))
    a = g.V().tag("x").has(iri("p_size")).out(iri("p_retailprice")).to_df().select(number("x").alias("key"), T.float_value(F.col("id")).alias("v"))
    return a.union(g.V().tag("x").out(iri("value")).to_df().select(number("x"), T.float_value(F.col("id"))))


_ROUNDTRIP_SQL = "SELECT p_partkey AS key, p_retailprice AS v FROM part WHERE p_size IS NOT NULL AND p_retailprice IS NOT NULL UNION ALL SELECT event_id, value FROM events WHERE value IS NOT NULL"


@query(_ROUNDTRIP_SQL)
def nquads_roundtrip(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "nquads")


@query(_ROUNDTRIP_SQL)
def json_roundtrip(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "json")


@query(_ROUNDTRIP_SQL)
def parquet_roundtrip(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "parquet")


@query("SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def jsonld_roundtrip(spark, sf_dir):
    scratch = Scratch(spark, "jsonld")
    q = graph(spark, sf_dir, "nation").quads.withColumn("p", F.concat(F.lit("<http://t/"), F.substring("p", 2, 100)))
    docs = formats.jsonld.documents(q).agg(F.concat(F.lit("["), F.array_join(F.collect_list("doc"), ","), F.lit("]")).alias("value"))  # 25 nations
    docs.write.mode("overwrite").text(scratch.path("docs"))
    g = GraphStore(formats.read(spark, scratch.path("docs"), "jsonld"))
    return g.V().tag("n").out(iri("http://t/n_name")).to_df().select(number("n").alias("n_nationkey"), T.text(F.col("id")).alias("n_name"))


@query("SELECT 'dot' AS kind, count(*)::BIGINT + 2 AS n FROM (SELECT n_regionkey FROM nation UNION ALL SELECT n_nationkey FROM nation) UNION ALL SELECT 'gml', 2 + 1 + 50 + (SELECT count(*) FROM (SELECT DISTINCT n_regionkey FROM nation)) + 25 + 25 UNION ALL SELECT 'graphml', 4 + 2 + 50 + (SELECT count(*) FROM (SELECT DISTINCT n_regionkey FROM nation)) + 25 + 25")
def export_lines(spark, sf_dir):
    """Lines of the export formats: nodes, edges, heads and feet."""
    q = graph(spark, sf_dir, "nation").quads
    out = [f(q).select(F.lit(name).alias("kind"), F.explode(F.split("value", "\n")).alias("line")) for name, f in (("dot", formats.dot_lines), ("gml", formats.gml_lines), ("graphml", formats.graphml_lines))]
    return reduce(DataFrame.unionByName, out).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT 'an' AS kind, (SELECT count(*) FROM nation) + (SELECT count(DISTINCT n_regionkey) FROM nation) AS n UNION ALL SELECT 'ae', (SELECT count(*) FROM nation)")
def visual_events(spark, sf_dir):
    events = graph_stream.node_events(graph(spark, sf_dir, "nation"), -1)
    return events.groupBy(F.regexp_extract("event", r'^\{"(\w+)"', 1).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT 's_nationkey' AS predicate, count(*)::BIGINT AS n FROM supplier UNION ALL SELECT 's_name', count(*)::BIGINT FROM supplier UNION ALL SELECT 's_acctbal', count(*)::BIGINT FROM supplier")
def stream_append(spark, sf_dir):
    """Quad files as a stream into a stored graph."""
    scratch = Scratch(spark, "stream")
    nquads.write(graph(spark, sf_dir, "supplier").quads, scratch.path("in"))
    deltas.appended(spark, scratch.path("in"), scratch.path("graph"), scratch.path("checkpoint")).awaitTermination()
    g = deltas.stored(spark, scratch.path("graph"))
    return g.quads.groupBy(T.text(F.col("p")).alias("predicate")).agg(F.count("*").alias("n"))
