"""The traversal language: scripts that chain steps from g.V() and end in all(), toArray(), count() and so on.

Chains build paths; a final runs its one plan. `frames` gives the plans of the emitting finals without running them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quadloom.functions import filters as FF
from quadloom.functions import terms as T
from quadloom.languages.script import Interpreter, ScriptError
from quadloom.plans.path import Path

#: Well-known namespaces.
NAMESPACES = {
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "owl": "http://www.w3.org/2002/07/owl#", "xsd": "http://www.w3.org/2001/XMLSchema#",
    "foaf": "http://xmlns.com/foaf/0.1/", "schema": "http://schema.org/", "skos": "http://www.w3.org/2004/02/skos/core#", "dc": "http://purl.org/dc/terms/",
}


def native(term):
    """A term as scripts and JSON results see it."""
    if isinstance(term, (str, bool, int, float)) or term is None:
        return term
    return T.key(term)


class Session:
    def __init__(self, store, namespaces: dict | None = None, limit: int = -1, lazy: bool = False):
        self.store, self.names, self.limit, self.lazy = store, dict(namespaces or {}), limit, lazy
        self.results: list = []
        self.frames: list[DataFrame] = []

    def run(self, source: str) -> list:
        """Emitted results; the value of the last expression if nothing is emitted."""
        graph = Graph(self)
        make = lambda f: lambda *a: f(*a)
        values = {"iri": self.iri, "bnode": T.BNode, "raw": T.Raw, "str": lambda s: Literal(str(s)), "lang": T.Lang, "typed": lambda s, t: T.parse(f'"{T.escape(s)}"^^<{self.full(t)}>')}
        tests = {"lt": FF.lt, "lte": FF.lte, "gt": FF.gt, "gte": FF.gte}
        tests = {k: lambda v, f=f: f(self.term(v)) for k, f in tests.items()}
        scope = {"graph": graph, "g": graph, **{k: make(f) for k, f in values.items()}, **tests, "regex": self.regex, "like": lambda p: FF.Like(p)}
        last = Interpreter(scope).run(source)
        if not self.results and not self.frames and isinstance(last, (str, int, float, list, dict)):
            self.emit(last)
        return self.results

    def emit(self, v) -> None:
        if self.limit < 0 or len(self.results) < self.limit:
            self.results.append(v)

    # Values

    def full(self, iri: str) -> str:
        prefix, colon, rest = iri.strip("<>").partition(":")
        return self.names[prefix] + rest if colon and prefix in self.names else iri.strip("<>")

    def iri(self, s: str) -> T.IRI:
        return T.IRI(self.full(s))

    def term(self, v):
        if isinstance(v, Literal):
            return v.text
        if isinstance(v, str):
            t = T.text_term(v)
            return self.iri(t.value) if isinstance(t, T.IRI) else t
        if isinstance(v, float) and v.is_integer():
            return int(v)
        if isinstance(v, (bool, int, float, T.IRI, T.BNode, T.Lang, T.Typed, T.Raw)):
            return v
        raise ScriptError(f"not a value: {v!r}")

    def regex(self, pattern, refs=False):
        if isinstance(pattern, T.IRI):
            if not refs:
                raise ScriptError("a pattern that is an IRI needs refs")
            pattern = pattern.value
        return FF.Regex(pattern.text if isinstance(pattern, Literal) else pattern, bool(refs))

    def via(self, v):
        """None, a path, or predicates."""
        if isinstance(v, Chain):
            return (v.path,)
        if isinstance(v, list):
            return tuple(self.via(x)[0] for x in v)
        return () if v is None else (self.term(v),)

    def tags(self, v) -> tuple:
        return () if v is None else tuple(v) if isinstance(v, list) else (v,)


class Literal:
    def __init__(self, text: str):
        self.text = text


class Graph:
    """graph, or g."""

    def __init__(self, session: Session):
        self.s = session

    def js_member(self, name: str):
        s = self.s
        flat = lambda v: [x for y in v for x in (y if isinstance(y, list) else [y])]
        named = {
            "V": lambda *ids: Chain(s, Path().start(*map(s.term, flat(ids))), True), "M": lambda: Chain(s, Path(), False), "IRI": s.iri, "Uri": s.iri,
            "emit": s.emit, "addNamespace": lambda p, iri: s.names.update({p: iri}), "addDefaultNamespaces": lambda: s.names.update({k: v for k, v in NAMESPACES.items() if k not in s.names}),
            "loadNamespaces": self.load,
        }
        aliases = {"Vertex": "V", "Morphism": "M", "Emit": "emit"}
        return named.get(aliases.get(name, name))

    def load(self):
        from quadloom.operators.records import load_namespaces

        self.s.names.update(load_namespaces(self.s.store))


_ALIASES = {"intersect": "and", "union": "or", "as": "tag", "difference": "except", "map": "forEach", "getLimit": "getLimit"}


class Chain:
    """A path in a script. Capitalized names are aliases of all steps."""

    def __init__(self, session: Session, path: Path, bound: bool):
        self.s, self.path, self.bound = session, path, bound

    def js_member(self, name: str):
        name = name[:1].lower() + name[1:]
        step = getattr(self, "do_" + _ALIASES.get(name, name), None)
        if step is None:
            return None
        return lambda *a: Chain(self.s, out, self.bound) if isinstance(out := step(*a), Path) else out

    def _terms(self, args) -> list:
        return [self.s.term(x) for v in args for x in (v if isinstance(v, list) else [v])]

    def _path(self, other) -> Path:
        if not isinstance(other, Chain):
            raise ScriptError("a path is asked for")
        return other.path

    # Steps

    def do_is(self, *nodes):
        return self.path.is_(*self._terms(nodes))

    def do_in(self, via=None, tags=None):
        return self.path.in_(*self.s.via(via), tags=self.s.tags(tags))

    def do_out(self, via=None, tags=None):
        return self.path.out(*self.s.via(via), tags=self.s.tags(tags))

    def do_both(self, via=None, tags=None):
        return self.path.both(*self.s.via(via), tags=self.s.tags(tags))

    def do_follow(self, other):
        return self.path.follow(self._path(other))

    def do_followR(self, other):  # noqa: N802
        return self.path.follow_reverse(self._path(other))

    def do_followRecursive(self, via, *more):  # noqa: N802
        depth = next((int(x) for x in more if isinstance(x, (int, float)) and not isinstance(x, bool)), 0)
        tags = next((self.s.tags(x) for x in more if isinstance(x, (str, list))), ())
        return self.path.follow_recursive(via.path if isinstance(via, Chain) else Path().out(*self.s.via(via)), depth, tags)

    def do_and(self, other):
        return self.path.and_(self._path(other))

    def do_or(self, other):
        return self.path.or_(self._path(other))

    def do_except(self, other):
        return self.path.except_(self._path(other))

    def do_back(self, tag=""):
        return self.path.back(tag)

    def do_tag(self, *tags):
        return self.path.tag(*(t for v in tags for t in self.s.tags(v)))

    def _has(self, via, values, reverse):
        tests = [v for v in values if isinstance(v, (FF.Compare, FF.Regex, FF.Like))]
        via = self.s.via(via)
        via = via[0] if len(via) == 1 else list(via) or None
        if tests:
            if len(tests) < len(values):
                raise ScriptError("filters and values can't be mixed")
            return self.path.has_filter(via, reverse, *tests)
        return (self.path.has_reverse if reverse else self.path.has)(via, *self._terms(v for v in values if v is not None))

    def do_has(self, via=None, *values):
        return self._has(via, values, False)

    def do_hasR(self, via=None, *values):  # noqa: N802
        return self._has(via, values, True)

    def _save(self, via, tag, reverse, optional):
        via = self.s.via(via)
        if tag is None:
            if len(via) != 1 or isinstance(via[0], Path):
                raise ScriptError("a tag is needed for more than one predicate")
            tag = native(via[0])
        via = via[0] if len(via) == 1 else list(via) or None
        return {(False, False): self.path.save, (True, False): self.path.save_reverse, (False, True): self.path.save_optional, (True, True): self.path.save_optional_reverse}[reverse, optional](via, tag)

    def do_save(self, via=None, tag=None):
        return self._save(via, tag, False, False)

    def do_saveR(self, via=None, tag=None):  # noqa: N802
        return self._save(via, tag, True, False)

    def do_saveOpt(self, via=None, tag=None):  # noqa: N802
        return self._save(via, tag, False, True)

    def do_saveOptR(self, via=None, tag=None):  # noqa: N802
        return self._save(via, tag, True, True)

    def do_unique(self):
        return self.path.unique()

    def do_labels(self):
        return self.path.labels()

    def do_inPredicates(self):  # noqa: N802
        return self.path.in_predicates()

    def do_outPredicates(self):  # noqa: N802
        return self.path.out_predicates()

    def do_saveInPredicates(self, tag):  # noqa: N802
        return self.path.save_predicates(True, tag)

    def do_saveOutPredicates(self, tag):  # noqa: N802
        return self.path.save_predicates(False, tag)

    def do_labelContext(self, labels=None, tags=None):  # noqa: N802
        return self.path.label_context(*self.s.via(labels), tags=self.s.tags(tags))

    def do_filter(self, *tests):
        return self.path.filters(*tests)

    def do_limit(self, n):
        return self.path.limit(int(n))

    def do_skip(self, n):
        return self.path.skip(int(n))

    def do_order(self):
        return self.path.order()

    # Finals

    def _bound(self) -> Path:
        if not self.bound:
            raise ScriptError("a morphism can't be run; start from V()")
        return self.path.on(self.s.store)

    def _rows(self, n: int = -1) -> DataFrame:
        df = self._bound().to_df()
        return df if n < 0 else df.limit(int(n))

    def _maps(self, n: int = -1):
        for row in self._rows(n).toLocalIterator():
            yield {k: native(T.parse(v)) for k, v in row.asDict().items() if v is not None}

    def do_all(self):
        return self.do_getLimit(-1)

    def do_getLimit(self, n):  # noqa: N802
        if self.s.lazy:
            self.s.frames.append(self._rows(n))
            return None
        room = self.s.limit - len(self.s.results) if self.s.limit >= 0 else -1
        for m in self._maps(room if n < 0 else min(n, room) if room >= 0 else n):
            self.s.emit(m)
        return None

    def do_toArray(self, n=-1):  # noqa: N802
        return [native(v) for v in self._bound().to_list(int(n))]

    def do_tagArray(self, n=-1):  # noqa: N802
        return list(self._maps(int(n)))

    def do_toValue(self):  # noqa: N802
        return native(self._bound().first())

    def do_tagValue(self):  # noqa: N802
        return next(iter(self._maps(1)), None)

    def do_forEach(self, *args):  # noqa: N802
        n, call = (-1, args[0]) if callable(args[0]) else (int(args[0]), args[1])
        for m in self._maps(n):
            call(m)

    def do_count(self):
        return self._bound().size()


def run(store, source: str, limit: int = -1, namespaces: dict | None = None) -> list:
    """Results of a script."""
    return Session(store, namespaces, limit).run(source)


def frame(store, source: str, namespaces: dict | None = None) -> DataFrame:
    """The plan of a script's last all() or getLimit(): id and a column per tag."""
    s = Session(store, namespaces, lazy=True)
    s.run(source)
    if not s.frames:
        raise ScriptError("the script has no all() or getLimit()")
    return s.frames[-1]
