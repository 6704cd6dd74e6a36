"""JSON-LD documents to and from quads: contexts, nested nodes, lists, graphs, typed and language-tagged values."""

from __future__ import annotations

import json
from collections.abc import Iterator
from urllib.parse import urljoin

from pyspark.sql import DataFrame, SparkSession

from quadloom.functions import terms as T

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
TYPE, FIRST, REST, NIL = T.IRI(RDF + "type"), T.IRI(RDF + "first"), T.IRI(RDF + "rest"), T.IRI(RDF + "nil")
_KEYWORDS = {"@id", "@type", "@graph", "@value", "@language", "@list", "@set", "@reverse", "@context", "@index", "@base", "@vocab"}


class Context:
    def __init__(self, base: str = "", vocab: str | None = None, terms: dict | None = None, language: str | None = None):
        self.base, self.vocab, self.terms, self.language = base, vocab, terms or {}, language

    def extended(self, context) -> Context:
        out = Context(self.base, self.vocab, dict(self.terms), self.language)
        for c in context if isinstance(context, list) else [context]:
            if c is None:
                out = Context()
            elif isinstance(c, dict):
                out.base = c.get("@base", out.base) or ""
                out.vocab = c.get("@vocab", out.vocab)
                out.language = c.get("@language", out.language)
                out.terms |= {k: v for k, v in c.items() if not k.startswith("@")}
            else:
                raise ValueError(f"contexts of other places can't be fetched: {c}")
        return out

    def definition(self, term: str) -> dict:
        d = self.terms.get(term)
        return d if isinstance(d, dict) else {"@id": d} if d else {}

    def expand(self, term: str, vocab: bool) -> str:
        """A keyword, an absolute IRI, a blank node, or what the context makes of a term."""
        if term.startswith(("@", "_:")):
            return term
        if vocab and term in self.terms:
            to = self.definition(term).get("@id", term)
            return self.expand(to, True) if to != term else (self.vocab or "") + term
        prefix, colon, rest = term.partition(":")
        if colon and not rest.startswith("//") and prefix in self.terms:
            return self.expand(self.definition(prefix).get("@id", prefix), True) + rest
        if colon:
            return term
        if vocab:
            return (self.vocab or "") + term
        return urljoin(self.base, term) if self.base else term


class _Reader:
    def __init__(self, prefix: str):
        self.prefix, self.n, self.named = prefix, 0, {}

    def blank(self, name: str | None = None) -> T.BNode:
        if name is not None and name in self.named:
            return self.named[name]
        self.n += 1
        node = T.BNode(f"{self.prefix}b{self.n}")
        if name is not None:
            self.named[name] = node
        return node

    def node_of(self, text: str):
        return self.blank(text[2:]) if text.startswith("_:") else T.IRI(text)

    def value(self, v, ctx: Context, kind: str | None, graph) -> tuple[object, list]:
        """The term of a property's value and the quads around it."""
        if isinstance(v, dict):
            if "@context" in v:
                ctx = ctx.extended(v["@context"])
            keys = {ctx.expand(k, True): k for k in v}
            if "@value" in keys:
                text, lang, datatype = v[keys["@value"]], v.get(keys.get("@language", "")), v.get(keys.get("@type", ""))
                if lang:
                    return T.Lang(str(text), lang), []
                if datatype:
                    return T.parse(f'"{T.escape(text if isinstance(text, str) else json.dumps(text))}"^^<{ctx.expand(datatype, True)}>'), []
                return text, []
            if "@list" in keys:
                return self.list_of(v[keys["@list"]], ctx, kind, graph)
            return self.node(v, ctx, graph)
        if kind in ("@id", "@vocab") and isinstance(v, str):
            return self.node_of(ctx.expand(v, kind == "@vocab")), []
        if kind and kind not in ("@id", "@vocab", "@none"):
            return T.parse(f'"{T.escape(v if isinstance(v, str) else json.dumps(v))}"^^<{ctx.expand(kind, True)}>'), []
        if isinstance(v, str) and ctx.language:
            return T.Lang(v, ctx.language), []
        return v, []

    def list_of(self, items, ctx, kind, graph) -> tuple[object, list]:
        quads, head, last = [], NIL, None
        for item in items if isinstance(items, list) else [items]:
            node = self.blank()
            term, more = self.value(item, ctx, kind, graph)
            quads += [(node, FIRST, term, graph), *more]
            if last is None:
                head = node
            else:
                quads.append((last, REST, node, graph))
            last = node
        if last is not None:
            quads.append((last, REST, NIL, graph))
        return head, quads

    def node(self, doc: dict, ctx: Context, graph) -> tuple[object, list]:
        if "@context" in doc:
            ctx = ctx.extended(doc["@context"])
        keys = {}
        for k in doc:
            keys.setdefault(ctx.expand(k, True), []).append(k)
        name = doc[keys["@id"][0]] if "@id" in keys else None
        subject = self.node_of(ctx.expand(name, False)) if isinstance(name, str) else self.blank()
        quads = []
        for full, written in keys.items():
            for k in written:
                values = doc[k] if isinstance(doc[k], list) else [doc[k]]
                if full == "@type":
                    quads += [(subject, TYPE, self.node_of(ctx.expand(v, True)), graph) for v in values]
                elif full == "@graph":
                    inside = subject if name is not None else graph
                    for v in values:
                        quads += self.node(v, ctx, inside)[1]
                elif full == "@reverse":
                    for p, nodes in doc[k].items():
                        for v in nodes if isinstance(nodes, list) else [nodes]:
                            term, more = self.value(v, ctx, "@id", graph)
                            quads += [(term, T.IRI(ctx.expand(p, True)), subject, graph), *more]
                elif full.startswith("@") or ":" not in full and not ctx.vocab and k not in ctx.terms:
                    continue  # not mapped to an IRI
                else:
                    definition = ctx.definition(k)
                    if definition.get("@container") == "@list":
                        values = [{"@list": values}]
                    for v in values:
                        if v is None:
                            continue
                        for one in v["@set"] if isinstance(v, dict) and "@set" in v else [v]:
                            term, more = self.value(one, ctx, definition.get("@type"), graph)
                            quads += [(subject, T.IRI(full), term, graph), *more]
        return subject, quads


def quads_of(document, prefix: str = "") -> list[tuple]:
    """Quads of one document (text, or parsed JSON). prefix: of its blank nodes' names."""
    doc, reader, out = json.loads(document) if isinstance(document, (str, bytes)) else document, _Reader(prefix), []
    for d in doc if isinstance(doc, list) else [doc]:
        out += reader.node(d, Context(), None)[1]
    return out


def read(spark: SparkSession, path: str) -> DataFrame:
    """Each file is one document, parsed by one task; blank nodes are named apart by file."""

    def run(batches) -> Iterator:
        import zlib

        import pandas as pd

        for b in batches:
            rows = [tuple(None if v is None else T.key(v) for v in q) for name, text in zip(b["name"], b["text"], strict=True) for q in quads_of(text, f"f{zlib.crc32(name.encode()):08x}")]
            yield pd.DataFrame(rows, columns=list("spol"))

    from pyspark.sql import functions as F

    files = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("name"), F.col("value").alias("text"))
    return files.mapInPandas(run, "s string, p string, o string, l string")


def value_of(term):
    """A term as an expanded JSON-LD value."""
    if isinstance(term, T.IRI):
        return {"@id": term.value}
    if isinstance(term, T.BNode):
        return {"@id": f"_:{term.value}"}
    if isinstance(term, T.Lang):
        return {"@value": term.value, "@language": term.lang}
    if isinstance(term, T.Typed):
        return {"@value": term.value, "@type": term.datatype}
    if isinstance(term, (str, bool, int, float)):
        return term
    return {"@value": T.parse('"' + T.key(term).split('"')[1] + '"'), "@type": T.TIME}


def documents(quads: DataFrame) -> DataFrame:
    """(id, doc): one expanded JSON-LD node object per subject and label, as text."""
    from pyspark.sql import functions as F

    grouped = quads.groupBy("s", "l", "p").agg(F.sort_array(F.collect_set("o")).alias("o")).groupBy("s", "l").agg(F.sort_array(F.collect_list(F.struct("p", "o"))).alias("props"))

    def run(batches):
        import pandas as pd

        for b in batches:
            out = []
            for s, label, props in zip(b["s"], b["l"], b["props"], strict=True):
                node = {"@id": value_of(T.parse(s))["@id"]} | {T.parse(x["p"]).value if x["p"].startswith("<") else x["p"]: [value_of(T.parse(o)) for o in x["o"]] for x in props}
                out.append((s, json.dumps({"@id": value_of(T.parse(label))["@id"], "@graph": [node]} if isinstance(label, str) else node, ensure_ascii=False)))
            yield pd.DataFrame(out, columns=["id", "doc"])

    return grouped.mapInPandas(run, "id string, doc string")
