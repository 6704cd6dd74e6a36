"""Records: typed objects from quads and back, by declared fields."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.plans.path import Path

RDF_TYPE = T.IRI("http://www.w3.org/1999/02/22-rdf-syntax-ns#type")
_PREFIX, _FULL = T.IRI("http://quadloom.example/ns#prefix"), T.IRI("http://quadloom.example/ns#namespace")


class RequiredField(ValueError):
    pass


@dataclass(frozen=True)
class Prop:
    """A field over a predicate. kind: a Spark type, "key" for the term itself, or a Record for a nested one."""

    name: str
    predicate: T.IRI
    kind: object = "string"
    many: bool = False
    optional: bool = False
    reverse: bool = False

    @property
    def required(self) -> bool:
        return not (self.optional or self.many)


@dataclass(frozen=True)
class Record:
    """type: objects must be of this class, and are written so. constants: (predicate, object) that hold for all."""

    props: tuple[Prop, ...]
    type: T.IRI | None = None
    constants: tuple = ()
    id_field: str = "id"
    type_predicate: T.IRI = RDF_TYPE


@dataclass
class Registry:
    """Classes by type IRI."""

    records: dict[str, Record] = field(default_factory=dict)

    def register(self, iri: T.IRI, record: Record) -> None:
        if self.records.get(iri.value, record) != record:
            raise ValueError(f"{iri.value} is registered already")
        self.records[iri.value] = record


def path_for(record: Record) -> Path:
    """Nodes with all that a record requires."""
    path = Path()
    if record.type:
        path = path.has(record.type_predicate, record.type)
    for p, o in record.constants:
        path = path.has(p, o)
    for p in record.props:
        if p.required:
            path = path.has_reverse(p.predicate) if p.reverse else path.has(p.predicate)
    return path.unique()


def _value(c: Column, kind) -> Column:
    if kind == "key":
        return c
    if kind == "iri":
        return F.when(c.startswith("<"), F.substring(c, F.lit(2), F.length(c) - 2))
    return T.NATIVE.get(kind, lambda x: T.text(x).try_cast(kind))(c)


def load(store, record: Record, depth: int = 8, ids: Iterable | DataFrame | None = None, check: bool = False) -> DataFrame:
    """One row per node: id, and a column per field: a value, a list of them (many), or structs to `depth` levels (beyond: null).

    A node without a required field isn't one of the record's; with check, ids that are asked for and aren't raise.
    """
    nodes = path_for(record).on(store).ids()
    wanted = None
    if ids is not None:
        wanted = ids if isinstance(ids, DataFrame) else store.spark.createDataFrame([(T.key(i),) for i in ids], "id string")
        nodes = nodes.join(wanted, "id", "left_semi")
    out = nodes.select("id")
    for k, p in enumerate(record.props):
        q = store.scan(p=[T.key(p.predicate)])
        at, to = ("o", "s") if p.reverse else ("s", "o")
        values = q.select(F.col(at).alias("id"), F.col(to).alias("to")).distinct()
        if isinstance(p.kind, Record):
            if depth <= 1:
                continue
            inner = load(store, p.kind, depth - 1)
            inner = inner.select(F.col("id").alias("to"), F.struct("*").alias("v"))
            values = values.join(inner, "to").select("id", "v")
        else:
            values = values.select("id", _value(F.col("to"), p.kind).alias("v")).where("v IS NOT NULL")
        held = values.groupBy("id").agg((F.sort_array(F.collect_list("v")) if p.many else F.min("v")).alias(f"_v{k}"))
        out = out.join(held, "id", "inner" if p.required and not (isinstance(p.kind, Record) and depth <= 1) else "left")
    columns = [F.col("id").alias(record.id_field)]
    for k, p in enumerate(record.props):
        if f"_v{k}" in out.columns:
            columns.append((F.coalesce(f"_v{k}", F.array()) if p.many else F.col(f"_v{k}")).alias(p.name))
    out = out.select(*columns)
    if check and wanted is not None and (lost := wanted.join(out.select(F.col(record.id_field).alias("id")), "id", "left_anti").first()):
        raise RequiredField(f"{lost['id']} lacks what the record requires")
    return out


def to_quads(rows: DataFrame, record: Record, label: T.IRI | None = None) -> DataFrame:
    """(s, p, o, l) of rows as load() gives them; a null required field fails the job; a null id becomes a blank node."""
    l = F.lit(T.key(label) if label else None).cast("string")  # noqa: E741
    kinds = dict(rows.dtypes)
    written = rows.select(F.coalesce(F.col(record.id_field), F.concat(F.lit("_:r"), F.lower(F.hex(F.xxhash64(*rows.columns))))).alias("_s"), "*")
    parts = []
    fixed = ([(record.type_predicate, record.type)] if record.type else []) + list(record.constants)
    for p, o in fixed:
        parts.append(written.select(F.col("_s").alias("s"), F.lit(T.key(p)).alias("p"), F.lit(T.key(o)).alias("o")))
    for p in record.props:
        if p.name not in rows.columns:
            continue
        c = F.col(p.name)
        one = written.select("_s", F.explode(c).alias("v")) if p.many else written.select("_s", c.alias("v"))
        if p.required:
            one = one.select("_s", F.when(F.col("v").isNull(), F.raise_error(F.lit(f"{p.name} is required"))).otherwise(F.col("v")).alias("v"))
        one = one.where("v IS NOT NULL")
        if isinstance(p.kind, Record):
            nested = one.select("v.*")
            parts.append(to_quads(nested, p.kind, None).select("s", "p", "o"))
            object_key = F.col(f"v.{p.kind.id_field}")
        elif p.kind == "iri":
            object_key = T.iri_key(F.col("v"))
        elif p.kind == "key":
            object_key = F.col("v")
        else:
            object_key = T.KEY_OF[kinds[p.name].removeprefix("array<").removesuffix(">") if p.many else kinds[p.name]](F.col("v"))
        s, o = (object_key, F.col("_s")) if p.reverse else (F.col("_s"), object_key)
        parts.append(one.select(s.alias("s"), F.lit(T.key(p.predicate)).alias("p"), o.alias("o")))
    return reduce(DataFrame.unionByName, parts).distinct().withColumn("l", l)


# Namespaces, kept as quads


def write_namespaces(store, names: dict[str, str]):
    quads = [(T.IRI(full), _PREFIX, prefix, None) for prefix, full in names.items()] + [(T.IRI(full), RDF_TYPE, _FULL, None) for full in names.values()]
    return store.add_quads(quads)


def load_namespaces(store) -> dict[str, str]:
    rows = store.quads.where(F.col("p") == T.key(_PREFIX)).select("s", "o").collect()  # as many as there are prefixes
    return {str(T.parse(r["o"])): T.parse(r["s"]).value for r in rows}


def short(c: Column, names: dict[str, str]) -> Column:
    """IRIs by their prefix."""
    out = c
    for prefix, full in names.items():
        out = F.when(c.startswith(f"<{full}"), F.concat(F.lit(f"<{prefix}:"), F.substring(c, F.lit(len(full) + 2), F.length(c)))).otherwise(out)
    return out


def full(c: Column, names: dict[str, str]) -> Column:
    """Prefixed IRIs in full."""
    out = c
    for prefix, whole in names.items():
        out = F.when(c.startswith(f"<{prefix}:"), F.concat(F.lit(f"<{whole}"), F.substring(c, F.lit(len(prefix) + 3), F.length(c)))).otherwise(out)
    return out
