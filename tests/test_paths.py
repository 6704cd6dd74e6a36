import pytest

from quadloom.functions import filters as FF
from quadloom.functions.terms import IRI, Raw
from quadloom.plans.path import Path
from quadloom.store import GraphStore
from tests.graphs import i, names, social


@pytest.fixture(scope="module")
def g(spark):
    s = social(spark)
    s.quads.cache().count()
    return s


M = Path.morphism()
follows, status, cool, smart = i("follows"), i("status"), "cool_person", "smart_person"
two = M.out().out()

CASES = {
    "out": (lambda g: g.V(i("alice")).out(follows), ["bob"]),
    "out any": (lambda g: g.V(i("bob")).out(), ["cool_person", "fred"]),
    "in": (lambda g: g.V(i("bob")).in_(follows), ["alice", "charlie", "dani"]),
    "both": (lambda g: g.V(i("fred")).both(follows), ["bob", "emily", "greg"]),
    "filter iri": (lambda g: g.V().filters(FF.gt(i("p"))), ["predicates", "smart_graph", "status"]),
    "in filter": (lambda g: g.V(i("bob")).in_(follows).filters(FF.gt(i("c"))), ["charlie", "dani"]),
    "regex": (lambda g: g.V(i("bob")).in_(follows).regex("ar?li.*e"), []),
    "regex refs": (lambda g: g.V(i("bob")).in_(follows).regex_with_refs("ar?li.*e"), ["alice", "charlie"]),
    "via path": (lambda g: g.V(i("bob")).out(M.start(i("predicates")).out(i("are"))), ["cool_person", "fred"]),
    "and": (lambda g: g.V(i("dani")).out(follows).and_(g.V(i("charlie")).out(follows)), ["bob"]),
    "or": (lambda g: g.V(i("fred")).out(follows).or_(g.V(i("alice")).out(follows)), ["bob", "greg"]),
    "follow": (lambda g: g.V(i("charlie")).follow(M.out(follows).out(follows)).unique(), ["bob", "fred", "greg"]),
    "follow reverse": (lambda g: g.V(i("fred")).follow_reverse(M.out(follows).out(follows)).unique(), ["alice", "charlie", "dani"]),
    "is follow": (lambda g: g.V(i("alice")).out(follows).is_(i("bob")), ["bob"]),
    "except": (lambda g: g.V(i("alice"), i("bob")).except_(g.V(i("alice"))), ["bob"]),
    "except path": (lambda g: g.V(i("alice"), i("bob"), i("emily")).except_(M.has(status)), ["alice"]),
    "unique": (lambda g: g.V(i("alice"), i("bob"), i("charlie")).out(follows).unique(), ["bob", "dani", "fred"]),
    "bag": (lambda g: g.V(i("alice"), i("bob"), i("charlie")).out(follows), ["bob", "bob", "dani", "fred"]),
    "has": (lambda g: g.V().has(status, cool), ["bob", "dani", "greg"]),
    "has bag": (lambda g: g.V().has(status), ["bob", "dani", "emily", "greg", "greg"]),
    "has filter": (lambda g: g.V().has_filter(follows, False, FF.gt(i("f"))).unique(), ["bob", "dani", "emily", "fred"]),
    "has path": (lambda g: g.V().has_path(M.out(status).is_(cool)), ["bob", "dani", "greg"]),
    "has reverse": (lambda g: g.V().has_reverse(status, i("bob")), ["cool_person"]),
    "like %": (lambda g: g.V().like("bo%"), ["bob"]),
    "like ?": (lambda g: g.V().like("???").filters(FF.gt(i("b"))), ["bob"]),
    "like both": (lambda g: g.V().like("%ed%"), ["fred", "predicates"]),
    "like nothing": (lambda g: g.V().like(""), []),
    "back": (lambda g: g.V(i("bob")).in_(follows).tag("foo").out(status).is_(cool).back("foo"), ["dani"]),
    "back to start": (lambda g: g.V(i("bob")).in_(follows).back(""), ["bob", "bob", "bob"]),
    "labels": (lambda g: g.V(i("greg")).labels(), ["smart_graph"]),
    "in predicates": (lambda g: g.V(i("bob")).in_predicates(), ["follows"]),
    "out predicates": (lambda g: g.V(i("bob")).out_predicates(), ["follows", "status"]),
    "label context": (lambda g: g.V(i("greg")).label_context(i("smart_graph")).out(status), ["smart_person"]),
    "label context reset": (lambda g: g.V(i("greg")).label_context(i("smart_graph")).label_context().out(status), ["cool_person", "smart_person"]),
    "label context path": (lambda g: g.V(i("greg")).label_context(M.start(i("greg")).labels()).out(status), ["smart_person"]),
    "recursive": (lambda g: g.V(i("charlie")).follow_recursive(follows), ["bob", "dani", "fred", "greg"]),
    "recursive loop": (lambda g: g.V(i("charlie")).follow_recursive(follows, -1), ["bob", "dani", "fred", "greg"]),
    "recursive 1": (lambda g: g.V(i("charlie")).follow_recursive(follows, 1), ["bob", "dani"]),
    "order": (lambda g: g.V().has(status, cool).order().skip(1).limit(1), ["dani"]),
    "all nodes": (lambda g: g.V(), names(["alice", "bob", "fred", "dani", "charlie", "greg", "emily", "follows", "status", "predicates", "are", "smart_graph", cool, smart])),
    "unknown node": (lambda g: g.V(i("nobody")), []),
}


@pytest.mark.parametrize("name", CASES)
def test_nodes(g, name):
    path, expected = CASES[name]
    assert names(path(g).to_list()) == sorted(expected)


TAGS = {
    "save": (lambda g: g.V().save(status, "t"), [cool] * 3 + [smart] * 2),
    "save reverse": (lambda g: g.V(cool).save_reverse(status, "t"), ["bob", "dani", "greg"]),
    "save target": (lambda g: g.V(i("dani"), i("bob")).save(follows, "t"), ["bob", "fred", "greg"]),
    "save in predicates": (lambda g: g.V(i("bob")).save_predicates(True, "t"), ["follows"] * 3),
    "save optional": (lambda g: g.V(i("bob"), i("charlie")).out(follows).save_optional(status, "t"), [cool, cool]),
    "optional": (lambda g: g.V(i("bob"), i("dani"), i("fred")).optional(M.save(status, "t")), [cool, cool]),
    "out tags": (lambda g: g.V(i("bob")).out(tags=("t",)), ["follows", "status"]),
    "depth": (lambda g: g.V(i("charlie")).follow_recursive(follows, 0, ("t",)), ["1", "1", "2", "2"]),
    "tags survive": (lambda g: g.V(i("bob")).tag("t").in_(follows).follow_recursive(M.in_(follows)), ["bob"]),
}


@pytest.mark.parametrize("name", TAGS)
def test_tags(g, name):
    path, expected = TAGS[name]
    assert names(r["t"] for r in path(g).tag_list() if "t" in r) == sorted(expected)


def test_optional_keeps_rows(g):
    assert names(g.V(i("bob"), i("dani"), i("fred")).optional(M.save(status, "t")).to_list()) == ["bob", "dani", "fred"]


def test_counts(g):
    assert g.V().has(status).count().first() == 5
    assert g.V().count().first() == 14
    assert g.V().has(status).size() == 5


def test_back_keeps_label_context(spark):
    from tests.graphs import SOCIAL

    g = GraphStore.of(spark, [*SOCIAL, (i("fred"), status, smart, i("other_graph"))])
    got = g.V(i("greg")).label_context(i("smart_graph")).tag("base").out(status).tag("st").back("base").out(status).tag_list()
    assert [str(r["id"]) for r in got] == [smart]


def test_recursion_inside(spark):
    chain = GraphStore.of(spark, [(i("a"), i("parent"), i("b")), (i("b"), i("parent"), i("c")), (i("c"), i("parent"), i("d")), (i("d"), i("parent"), i("e")), (i("c"), i("labels"), i("x")), (i("d"), i("labels"), i("x"))])
    assert names(chain.V(i("a")).follow_recursive(i("parent"), 0).has(i("labels")).to_list()) == ["c", "d"]
    loop = GraphStore.of(spark, [(i("1"), i("knows"), i("2")), (i("2"), i("knows"), i("3")), (i("2"), i("knows"), i("1")), (i("1"), i("relatesTo"), i("2"))])
    for depth in (0, 3):
        rows = loop.V(i("1")).follow_recursive(M.tag("pid").out(i("knows")), depth).tag_list()
        assert sorted((r["id"].value, r["pid"].value) for r in rows) == [("1", "2"), ("2", "1"), ("3", "2")]


def test_misuse(g):
    with pytest.raises(ValueError, match="morphism"):
        M.out().to_df()
    with pytest.raises(ValueError, match="mixed"):
        g.V().out(M.out(), follows)
    with pytest.raises(ValueError, match="reverse"):
        M.labels().reverse()
    assert isinstance(g.V(Raw("<alice>")).first(), IRI)


def test_plan_is_pruned(spark):
    """A filter on the predicate reaches the scan, and no dictionary of nodes is joined."""
    from quadloom.store import quad_rows
    from tests.graphs import SOCIAL

    plan = GraphStore(quad_rows(spark, SOCIAL)).V(i("alice")).out(follows).to_df()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
