"""The JSON-LD step language: nested objects whose @type names a step, such as

    {"@context": {"@vocab": "..."}, "@type": "Visit", "from": {"@type": "Match", "pattern": {}}, "properties": "http://example.com/likes"}

Steps are known by the last part of their type's IRI, whatever the vocabulary's address. Each lowers to steps of one path.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions import filters as FF
from quadloom.functions import terms as T
from quadloom.plans.path import Path
from quadloom.sources import jsonld

FIRST, REST = jsonld.FIRST.value, jsonld.REST.value


class StepError(ValueError):
    pass


def _local(name: str) -> str:
    return name.replace("#", "/").rsplit("/", 1)[-1]


class Builder:
    def __init__(self, context=None):
        self.context = jsonld.Context().extended(context or {})

    # Values

    def iri(self, text: str) -> T.IRI:
        prefix, colon, rest = text.strip("<>").partition(":")
        if colon and prefix in self.context.terms and not rest.startswith("//"):
            return T.IRI(self.context.expand(text.strip("<>"), False))
        return T.IRI(text.strip("<>"))

    def term(self, v):
        if isinstance(v, dict):
            if "@id" in v:
                return T.BNode(v["@id"][2:]) if v["@id"].startswith("_:") else self.iri(v["@id"])
            if "@value" in v:
                if v.get("@language"):
                    return T.Lang(v["@value"], v["@language"])
                if v.get("@type"):
                    return T.parse(f'"{T.escape(v["@value"] if isinstance(v["@value"], str) else json.dumps(v["@value"]))}"^^<{self.iri(v["@type"]).value}>')
                return v["@value"]
            raise StepError(f"not a value: {v}")
        if isinstance(v, float) and v.is_integer():
            return int(v)
        if isinstance(v, (str, bool, int, float)):
            return v
        raise StepError(f"not a value: {v!r}")

    def terms(self, values) -> list:
        return [self.term(v) for v in (values if isinstance(values, list) else [] if values is None else [values])]

    def predicates(self, p) -> tuple:
        """A property path: an IRI, a list of them, or a step that gives them."""
        if p is None:
            return ()
        if isinstance(p, str):
            return (self.iri(p),)
        if isinstance(p, list):
            return tuple(self.predicates(x)[0] for x in p)
        if "@id" in p and "@type" not in p:
            return (self.iri(p["@id"]),)
        return (self.path(p),)

    def via(self, p):
        found = self.predicates(p)
        return found[0] if len(found) == 1 else list(found) or None

    # Steps

    def path(self, step: dict) -> Path:
        if not isinstance(step, dict) or "@type" not in step:
            raise StepError(f"a step is an object with a type, not {step!r}")
        kind = _local(step["@type"])
        build = getattr(self, "step_" + kind, None)
        if build is None:
            raise StepError(f"no step is called {kind}")
        return build(step)

    def source(self, step: dict) -> Path:
        if "from" not in step:
            raise StepError(f"{_local(step['@type'])} needs from")
        return self.path(step["from"])

    def step_Vertex(self, s):  # noqa: N802
        return Path().start(*self.terms(s.get("values")))

    def step_Placeholder(self, s):  # noqa: N802
        return Path()

    def step_Match(self, s):  # noqa: N802
        base = self.path(s["from"]) if s.get("from") else Path()
        pattern = s.get("pattern") or {}
        if not pattern:
            return base
        contexts = [{"@vocab": None} | self.context.terms, *([pattern["@context"]] if isinstance(pattern, dict) and "@context" in pattern else [])]
        document = {"@context": contexts} | {k: v for k, v in pattern.items() if k != "@context"} if isinstance(pattern, dict) else pattern
        held: dict = {}
        referenced = set()
        for q in jsonld.quads_of(document):
            held.setdefault(q[0], []).append((q[1], q[2]))
            if isinstance(q[2], T.BNode):
                referenced.add(q[2])
        if not held and isinstance(pattern, dict) and "@id" in pattern:
            return base.is_(self.iri(pattern["@id"]))

        def constrained(path: Path, entity) -> Path:
            path = path.is_(entity) if isinstance(entity, T.IRI) else path
            for p, o in held.get(entity, ()):
                path = path.has_path(constrained(Path().out(p), o)) if isinstance(o, T.BNode) else path.has(p, o)
            return path

        for entity in held:
            if entity not in referenced:
                base = constrained(base, entity)
        return base

    def step_Visit(self, s):  # noqa: N802
        return self.source(s).out(*self.predicates(s.get("properties")))

    def step_VisitReverse(self, s):  # noqa: N802
        return self.source(s).in_(*self.predicates(s.get("properties")))

    step_Out, step_In = step_Visit, step_VisitReverse

    def step_Both(self, s):  # noqa: N802
        return self.source(s).both(*self.predicates(s.get("properties")))

    def step_Has(self, s):  # noqa: N802
        return self.source(s).has(self.via(s.get("property")), *self.terms(s.get("values")))

    def step_HasReverse(self, s):  # noqa: N802
        return self.source(s).has_reverse(self.via(s.get("property")), *self.terms(s.get("values")))

    def step_Where(self, s):  # noqa: N802
        return self.source(s).has_path(self.path(s["condition"] if "condition" in s else s["step"]))

    def step_Optional(self, s):  # noqa: N802
        return self.source(s).optional(self.path(s["step"]))

    def _each(self, s, how: str) -> Path:
        path = self.source(s)
        for x in s.get("steps") or []:
            path = getattr(path, how)(self.path(x))
        return path

    def step_Intersect(self, s):  # noqa: N802
        return self._each(s, "and_")

    def step_Union(self, s):  # noqa: N802
        return self._each(s, "or_")

    def step_Difference(self, s):  # noqa: N802
        return self._each(s, "except_")

    def step_As(self, s):  # noqa: N802
        return self.source(s).tag(s["name"])

    def step_Back(self, s):  # noqa: N802
        return self.source(s).back(s.get("name", ""))

    def step_Unique(self, s):  # noqa: N802
        return self.source(s).unique()

    def step_Order(self, s):  # noqa: N802
        return self.source(s).order()

    def step_Limit(self, s):  # noqa: N802
        return self.source(s).limit(int(s["limit"]))

    def step_Skip(self, s):  # noqa: N802
        return self.source(s).skip(int(s["offset"]))

    def step_Count(self, s):  # noqa: N802
        return self.source(s).count()

    def step_Labels(self, s):  # noqa: N802
        return self.source(s).labels()

    def step_PropertyNames(self, s):  # noqa: N802
        return self.source(s).out_predicates()

    def step_ReversePropertyNames(self, s):  # noqa: N802
        return self.source(s).in_predicates()

    def step_PropertyNamesAs(self, s):  # noqa: N802
        return self.source(s).save_predicates(False, s["tag"])

    def step_ReversePropertyNamesAs(self, s):  # noqa: N802
        return self.source(s).save_predicates(True, s["tag"])

    def _names(self, s) -> list[T.IRI]:
        names = s.get("names")
        if not names:
            raise StepError(f"{_local(s['@type'])} needs names")
        return [self.iri(n["@id"] if isinstance(n, dict) else n) for n in (names if isinstance(names, list) else [names])]

    def step_Properties(self, s):  # noqa: N802
        path = self.source(s)
        for n in self._names(s):
            path = path.save(n, n.value)
        return path

    def step_ReverseProperties(self, s):  # noqa: N802
        path = self.source(s)
        for n in self._names(s):
            path = path.save_reverse(n, n.value)
        return path

    def step_Collect(self, s):  # noqa: N802
        """The cells of RDF lists, with what they hold and what follows, and the nodes that have the lists."""
        source, name = self.source(s), self.iri(s["name"]["@id"] if isinstance(s["name"], dict) else s["name"])
        cell = lambda p: p.save(jsonld.FIRST, FIRST).save(jsonld.REST, REST)
        return cell(source.out(name)).or_(cell(source.out(name).follow_recursive(jsonld.REST, -1))).or_(source.save(name, name.value))

    def _compare(self, s, op):
        return self.source(s).filters(FF.Compare(op, self.term(s["value"])))

    def step_LessThan(self, s):  # noqa: N802
        return self._compare(s, "<")

    def step_LessThanEquals(self, s):  # noqa: N802
        return self._compare(s, "<=")

    def step_GreaterThan(self, s):  # noqa: N802
        return self._compare(s, ">")

    def step_GreaterThanEquals(self, s):  # noqa: N802
        return self._compare(s, ">=")

    def step_RegExp(self, s):  # noqa: N802
        return self.source(s).filters(FF.Regex(s["expression"], bool(s.get("includeIRIs", False))))

    def step_Like(self, s):  # noqa: N802
        return self.source(s).like(s["likePattern"])


FINAL = ("Select", "Documents")


def parse(query) -> tuple[str, Path, list[str]]:
    """Kind of the results (values, Select or Documents), the path, and the tags that are asked for (none: all)."""
    q = json.loads(query) if isinstance(query, (str, bytes)) else query
    kind = _local(q.get("@type", ""))
    builder = Builder(q.get("@context"))
    if kind in FINAL:
        return kind, builder.source(q), list(q.get("tags") or q.get("properties") or [])
    return "values", builder.path(q), []


def frame(store, query) -> DataFrame:
    """The plan: id, and a column per tag for Select and Documents."""
    kind, path, tags = parse(query)
    df = path.on(store).to_df(kind != "values")
    return df.select("id", *(F.col(f"`{t}`") for t in tags)) if tags else df


def documents_frame(store, query) -> DataFrame:
    """For Documents: one row per node; a list of keys per tag."""
    df = frame(store, query)
    return df.groupBy("id").agg(*(F.sort_array(F.collect_set(F.col(f"`{c}`"))).alias(c) for c in df.columns if c != "id"))


def execute(store, query) -> list:
    """values: JSON-LD values. Select: an object of tags per row. Documents: a node object per node, lists closed up."""
    kind, path, tags = parse(query)
    if kind == "values":
        return [jsonld.value_of(v) for v in path.on(store).to_list()]
    if kind == "Select":
        rows = (r.asDict() for r in frame(store, query).toLocalIterator())
        return [{k: jsonld.value_of(T.parse(v)) for k, v in r.items() if k != "id" and v is not None} for r in rows]
    nodes = {}
    for r in documents_frame(store, query).toLocalIterator():
        nodes[r["id"]] = {k: [T.parse(v) for v in vs] for k, vs in r.asDict().items() if k != "id" and vs}
    return _closed(nodes)


def _closed(nodes: dict[str, dict]) -> list[dict]:
    """Node objects; chains of first and rest become @list."""
    cells = {k: v for k, v in nodes.items() if FIRST in v and REST in v}

    def value(term):
        at, items = T.key(term), []
        while at in cells:
            items.append(jsonld.value_of(cells[at][FIRST][0]))
            at = T.key(cells[at][REST][0])
            if at == T.key(jsonld.NIL):
                return {"@list": items}
        return jsonld.value_of(term)

    return [{"@id": jsonld.value_of(T.parse(k))["@id"]} | {p: [value(t) for t in ts] for p, ts in v.items()} for k, v in nodes.items() if k not in cells and k[0] in "<_"]


#: Parameters of each step, for the exported vocabulary.
PARAMETERS = {
    "Vertex": "values", "Placeholder": "", "Match": "from pattern", "Visit": "from properties", "Out": "from properties", "VisitReverse": "from properties", "In": "from properties", "Both": "from properties", "Has": "from property values",
    "HasReverse": "from property values", "Where": "from condition", "Optional": "from step", "Intersect": "from steps", "Union": "from steps", "Difference": "from steps", "As": "from name", "Back": "from name", "Unique": "from", "Order": "from",
    "Limit": "from limit", "Skip": "from offset", "Count": "from", "Labels": "from", "PropertyNames": "from", "ReversePropertyNames": "from", "PropertyNamesAs": "from tag", "ReversePropertyNamesAs": "from tag", "Properties": "from names",
    "ReverseProperties": "from names", "Collect": "from name", "LessThan": "from value", "LessThanEquals": "from value", "GreaterThan": "from value", "GreaterThanEquals": "from value", "RegExp": "from expression includeIRIs", "Like": "from likePattern",
    "Select": "from tags", "Documents": "from",
}


def vocabulary(namespace: str) -> list[tuple]:
    """The step language as an OWL/RDFS vocabulary, in quads."""
    rdfs, owl = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
    name = lambda x: T.IRI(namespace + x)
    out = [(name("Step"), jsonld.TYPE, T.IRI(rdfs + "Class"), None)]
    for step, parameters in PARAMETERS.items():
        out += [(name(step), jsonld.TYPE, T.IRI(rdfs + "Class"), None), (name(step), T.IRI(rdfs + "subClassOf"), name("Step"), None)]
        for p in parameters.split():
            out += [(name(p), jsonld.TYPE, T.IRI(owl + ("ObjectProperty" if p in ("from", "condition", "step", "steps") else "DatatypeProperty")), None), (name(p), T.IRI(rdfs + "domain"), name(step), None)]
            if p in ("from", "condition", "step", "steps"):
                out.append((name(p), T.IRI(rdfs + "range"), name("Step"), None))
    return list(dict.fromkeys(out))
