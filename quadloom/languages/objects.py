"""Nested objects as one plan: an object query is a tree of fields, lowered to one join and one aggregation per level.

The GraphQL-like language and the JSON templates both become such trees. A level's frame has one row per (parent, node) with
columns id, a list column per flat field and a list of structs per nested field; nothing is queried row by row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Constraint:
    """Nodes must have (or be reached by) one of the values over the predicate; no values: any."""

    via: str
    values: tuple[str, ...] = ()
    reverse: bool = False
    labels: tuple[str, ...] = ()


@dataclass
class Field:
    """name: of the result. via: predicate key, None for the node itself. fields None: a flat field."""

    name: str
    via: str | None = None
    reverse: bool = False
    optional: bool = False
    labels: tuple[str, ...] = ()
    fields: list[Field] | None = None
    everything: bool = False
    has: list[Constraint] = field(default_factory=list)
    ids: tuple[str, ...] | None = None
    only: tuple[str, ...] | None = None  # of a flat field: these values only
    skip: int = 0
    limit: int = -1
    unnest: bool = False
    repeated: bool = False
    filters: bool = False  # a nested field without objects drops its parent


def _edges(store, via: str, reverse: bool, labels: tuple[str, ...], only: tuple[str, ...] = ()) -> DataFrame:
    """(at, to) over a predicate, to some nodes only if any are named."""
    wanted = {"p": (via,)} | ({"l": labels} if labels else {}) | ({"s" if reverse else "o": only} if only else {})
    q = store.scan(**wanted)
    return q.select(F.col("o").alias("at"), F.col("s").alias("to")) if reverse else q.select(F.col("s").alias("at"), F.col("o").alias("to"))


def level(store, f: Field, base: DataFrame | None) -> DataFrame:
    """base: (pid, id) rows; None: all nodes, as a root without parent. Returns (pid,) id and f0, f1 ... for its fields, as many rows as objects."""
    root = base is None
    keys = ["id"] if root else ["pid", "id"]
    if root:
        base = _root(store, f)
    elif f.ids is not None:
        base = base.where(F.col("id").isin(*f.ids))
    for h in f.has:
        e = _edges(store, h.via, h.reverse, h.labels, h.values)
        base = base.join(e.select(F.col("at").alias("id")).distinct(), "id", "left_semi")
    out = base.select(*keys)
    flat = [(k, x) for k, x in enumerate(f.fields or []) if x.fields is None and not x.everything and x.via is not None]
    for k, x in flat:
        e = _edges(store, x.via, x.reverse, x.labels)
        if x.only is not None:
            e = e.where(F.col("to").isin(*x.only))
        values = e.groupBy(F.col("at").alias("id")).agg(F.sort_array(F.collect_set("to")).alias(f"f{k}"))
        out = out.join(values, "id", "left" if x.optional else "inner")
    if f.skip > 0 or f.limit >= 0:
        if root:
            out = out.orderBy("id").offset(max(0, f.skip))
            out = out.limit(f.limit) if f.limit >= 0 else out
        else:
            place = F.row_number().over(Window.partitionBy("pid").orderBy("id"))
            out = out.withColumn("_n", place).where(F.col("_n") > max(0, f.skip))
            out = (out.where(F.col("_n") <= max(0, f.skip) + f.limit) if f.limit >= 0 else out).drop("_n")
    for k, x in enumerate(f.fields or []):
        if x.fields is None and not x.everything:
            if x.via is None:
                out = out.withColumn(f"f{k}", F.array("id"))
            continue
        e = _edges(store, x.via, x.reverse, x.labels)
        below = level(store, x, e.join(out.select(F.col("id").alias("at")).distinct(), "at", "left_semi").select(F.col("at").alias("pid"), F.col("to").alias("id")).distinct())
        columns = [c for c in below.columns if c != "pid"]
        nested = below.groupBy("pid").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(f"f{k}"))
        out = out.join(nested.withColumnRenamed("pid", "id"), "id", "inner" if x.filters and not x.optional else "left")
    if f.everything:
        last = store.quads.groupBy("s", "p").agg(F.max("o").alias("o")).groupBy(F.col("s").alias("id")).agg(F.sort_array(F.collect_list(F.struct("p", "o"))).alias("all"))
        out = out.join(last, "id", "left")
    return out.select(*keys, *sorted((c for c in out.columns if c[0] == "f" and c[1:].isdigit()), key=lambda c: int(c[1:])), *(["all"] if f.everything else []))


def _root(store, f: Field) -> DataFrame:
    """Nodes to start from: not all of them where a constraint or a required field says more."""
    known = f.has[0] if f.has else next((Constraint(x.via, x.only or (), x.reverse, x.labels) for x in f.fields or [] if x.via and not x.optional and (x.filters or x.fields is None and not x.everything)), None)
    if known:
        ids = _edges(store, known.via, known.reverse, known.labels, known.values).select(F.col("at").alias("id")).distinct()
    else:
        ids = store.ids()
    return ids.where(F.col("id").isin(*f.ids)) if f.ids is not None else ids
