"""Graphs as events for visualizers: one JSON object a line, adding nodes (an) and edges (ae)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions import terms as T

LIMIT = 10_000


def _label(c):
    return F.coalesce(T.text(c), c)


def raw_events(store, limit: int = LIMIT) -> DataFrame:
    """(event): every quad is an edge, every subject and object a node. limit: the feature's bound on quads, -1 for all."""
    q = store.quads.orderBy("s", "p", "o", "l").limit(limit) if limit >= 0 else store.quads
    nodes = q.select(F.explode(F.array("s", "o")).alias("id")).distinct().select(_event("an", F.col("id"), F.struct(_label(F.col("id")).alias("label"))).alias("event"))
    key = F.sha1(F.concat_ws("\u0000", "s", "p", "o", F.coalesce("l", F.lit(""))))
    edge = F.struct(F.col("s").alias("source"), F.col("o").alias("target"), _label(F.col("p")).alias("label"), F.lit(True).alias("directed"), F.col("p").alias("pred"))
    return nodes.union(q.select(_event("ae", key, edge).alias("event")))


def _event(kind: str, key, value):
    return F.to_json(F.struct(F.map_from_arrays(F.array(key), F.array(value)).alias(kind)))


def node_events(store, limit: int = LIMIT) -> DataFrame:
    """(event): nodes that are subjects or link targets, with their literal properties inside; quads between nodes are edges."""
    q = store.quads
    literal = F.col("o").startswith('"')
    props = q.where(literal).groupBy("s", "p").agg(F.max("o").alias("o")).groupBy(F.col("s").alias("id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(_label(F.col("p")), _label(F.col("o")))))).alias("props"))
    ids = q.select(F.col("s").alias("id")).union(q.where(~literal).select("o")).distinct()
    ids = ids.orderBy("id").limit(limit) if limit >= 0 else ids
    nodes = ids.join(props, "id", "left").select(_event("an", F.col("id"), F.struct(_label(F.col("id")).alias("label"), F.col("props"))).alias("event"))
    edges = q.where(~literal).join(ids.withColumnRenamed("id", "s"), "s", "left_semi").join(ids.withColumnRenamed("id", "o"), "o", "left_semi")
    key = F.sha1(F.concat_ws("\u0000", "s", "p", "o", F.coalesce("l", F.lit(""))))
    edge = F.struct(F.col("s").alias("source"), F.col("o").alias("target"), _label(F.col("p")).alias("label"), F.lit(True).alias("directed"))
    return nodes.union(edges.select(_event("ae", key, edge).alias("event")))
