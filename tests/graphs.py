"""Small graphs of the tests."""

from quadloom.functions.terms import IRI
from quadloom.store import GraphStore


def i(x):
    return IRI(x)


_F = [("alice", "bob"), ("bob", "fred"), ("dani", "bob"), ("charlie", "bob"), ("charlie", "dani"), ("dani", "greg"), ("emily", "fred"), ("fred", "greg")]
SOCIAL = [(i(a), i("follows"), i(b), None) for a, b in _F]
SOCIAL += [(i(a), i("status"), "cool_person", None) for a in ("bob", "dani", "greg")]
SOCIAL += [(i("predicates"), i("are"), i(p), None) for p in ("follows", "status")]
SOCIAL += [(i(a), i("status"), "smart_person", i("smart_graph")) for a in ("emily", "greg")]


def social(spark):
    return GraphStore.of(spark, SOCIAL)


def names(values):
    return sorted(v.value if hasattr(v, "value") else str(v) for v in values)
