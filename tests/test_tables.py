"""Tables as graphs: conditions on terms reach the columns, and paths over columns give what paths over plain quads give."""

from collections import Counter

import pytest

from quadloom import queries
from quadloom.functions.terms import IRI, BNode, Lang, key
from quadloom.plans.path import Path
from quadloom.sources import tables
from quadloom.sources.tables import Cell, Mapping, Node, Value
from quadloom.store import GraphStore

i = IRI
M = Path.morphism()
ITEMS = Mapping(("item", "k"), {"maker": "firm", "owner": "person"}, ("size", "weight", "name", "sold", "day"), label="src")
FIRMS = Mapping(("firm", "f"), {"at": "town"}, ("title",))
SCHEMA = "k bigint, maker int, owner string, size int, weight double, name string, sold boolean, day date, src string"
ROWS = [
    (1, 7, "ann", 3, 0.5, "a", True, None, "x"), (2, 7, "b/c", 3, -0.0, 'q"\\n\n', False, None, "x"), (3, 8, None, -4, 0.0, "7", None, None, "y"),
    (4, None, "ann", None, float("nan"), "", True, None, None), (None, 8, "ann", 3, 1.0, "lost", True, None, "x"), (3, 8, "ann", -4, 1e20, "7", False, None, "y"),
]


@pytest.fixture(scope="module")
def stores(spark):
    items, firms = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([(7, 1, "seven"), (8, 1, "eight"), (9, 2, "a")], "f bigint, at smallint, title string")
    mapped = GraphStore.of_cells([*tables.cells(items, ITEMS), *tables.cells(firms, FIRMS)])
    plain = GraphStore(spark.createDataFrame(mapped.quads.collect(), "s string, p string, o string, l string"))
    return mapped, plain


PATHS = {
    "fixed": lambda g: g.V(i("firm/7")).in_(i("maker")),
    "fixed by text": lambda g: g.V(i("person/b/c"), i("person/ann")).in_(i("owner")),
    "fixed literal": lambda g: g.V(3, "7", True, 0.0, -0.0, float("nan"), 1e20, 'q"\\n\n').in_(),
    "other forms": lambda g: g.V(i("firm/07"), i("firm/x"), i("firm/7/1"), BNode("7"), Lang("a", "en"), 2**70).in_(),
    "existing": lambda g: g.V(i("firm/7"), i("firm/77"), i("maker"), i("x"), "a", 3, i("item/1"), i("town/1")),
    "any": lambda g: g.V(i("item/3")).out(),
    "two hops": lambda g: g.V().out(i("maker")).out(i("at")),
    "two hops back": lambda g: g.V(i("town/1")).in_(i("at")).in_(i("maker")).out(i("name")),
    "mixed ends": lambda g: g.V().out(i("maker"), i("owner")).out(),
    "both": lambda g: g.V(i("firm/7")).both(),
    "tags": lambda g: g.V().tag("a").out(i("maker")).tag("b").out(i("at"), tags=["via"]).unique(),
    "back": lambda g: g.V().out(i("maker")).tag("f").out(i("at")).back("f").out(i("title")),
    "has": lambda g: g.V().has(i("size"), 3, -4).has(i("sold"), True).out(i("maker")),
    "has reverse": lambda g: g.V().has_reverse(i("maker"), i("item/1"), i("item/3")).out(i("at")),
    "and": lambda g: g.V().out(i("maker")).and_(g.V().has(i("title"), "seven")).out(i("at")),
    "and other class": lambda g: g.V().out(i("maker")).and_(g.V().has(i("size"), 3)),
    "or": lambda g: g.V().out(i("maker")).or_(g.V().out(i("at"))).in_(),
    "except": lambda g: g.V().out(i("at")).in_(i("at")).except_(M.in_(i("maker"))),
    "unique": lambda g: g.V().out(i("maker")).unique().out(i("title")),
    "optional": lambda g: g.V().out(i("maker")).optional(M.out(i("at")).tag("t")).out(i("title")),
    "save optional": lambda g: g.V().has(i("size")).save_optional(i("owner"), "o").save(i("maker"), "m").out(i("maker")),
    "has path": lambda g: g.V().out(i("maker")).has_path(M.out(i("at")).is_(i("town/1"))).out(i("title")),
    "labels": lambda g: g.V().label_context(i("y")).out(i("maker")),
    "label of nothing": lambda g: g.V().label_context("y").out(i("maker")),
    "recursive": lambda g: g.V(i("item/1")).follow_recursive(M.out(i("maker"), i("at"))),
    "follow back": lambda g: g.V(i("town/1")).follow_reverse(M.out(i("maker")).out(i("at"))),
    "predicates": lambda g: g.V(i("item/1")).out_predicates(),
    "nothing": lambda g: g.V(i("none/1")).out(i("maker")).out(i("none")).unique(),
}


def rows(p):
    return sorted(repr(sorted(r.asDict().items())) for r in p.to_df().collect())


@pytest.mark.parametrize("name", PATHS)
def test_same_as_plain_quads(stores, name):
    mapped, plain = stores
    assert rows(PATHS[name](mapped)) == rows(PATHS[name](plain))


def test_scans(stores):
    mapped, plain = stores
    for wanted in ({}, {"p": ["<name>"]}, {"s": ["<item/3>"], "p": ["<size>", "<maker>"]}, {"l": ["<x>"]}, {"o": [key("a")]}, {"p": ["<none>"]}, {"l": ['"x"']}, {"s": []}):
        assert sorted(map(repr, mapped.scan(**wanted).collect())) == sorted(map(repr, plain.scan(**wanted).collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_conditions_reach_the_files(spark, data):
    items = spark.read.parquet(f"{data}/lineitem.parquet")
    part = Node("part", ("l_partkey",))
    g = GraphStore.of_cells([Cell(items, "<has_part>", Node("order", ("l_orderkey",)), part), Cell(items, "<flag>", part, Value("l_returnflag"))])
    assert "EqualTo(l_partkey,7)" in plan(g.V(i("part/7")).in_(i("has_part")).to_df())
    assert "EqualTo(l_returnflag,A)" in plan(g.V("A").in_(i("flag")).to_df())
    assert "In(l_partkey, [7,8])" in plan(g.V().has(i("has_part"), i("part/7"), i("part/8")).to_df())
    walk = plan(g.V().out(i("has_part")).out(i("flag")).to_df())
    join = next(line for line in walk.splitlines() if "Join" in line)
    assert "_n#" in join and "id#" not in join  # numbers meet, not keys


@pytest.mark.parametrize("name", PATHS)
def test_counted_is_the_bag(stores, name):
    for g in stores:
        p = PATHS[name](g)
        got = p.counted().collect()
        assert len(got) == len({r["id"] for r in got})
        assert {r["id"]: r["n"] for r in got} == Counter(r["id"] for r in p.ids().collect())


def test_paths_through_a_hub_are_not_listed(spark):
    """1.6e9 paths, which would be as many rows."""
    df, n = spark.range(40_000).selectExpr("id AS k", "0L AS hub"), 40_000
    g = GraphStore.of_cells([Cell(df, "<to>", Node("a", ("k",)), Node("hub", ("hub",))), Cell(df, "<from>", Node("hub", ("hub",)), Node("b", ("k",)))])
    counted = g.V().out(i("to")).out(i("from")).counted()
    assert "sum(_paths" in plan(counted)
    assert {tuple(r) for r in counted.groupBy("n").count().collect()} == {(n, n)}


def test_four_hops_adds_up(spark, data):
    assert "sum(_paths" in plan(queries.four_hops(spark, data))
