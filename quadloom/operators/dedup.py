"""Nodes of a type that have equal property sets become one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.operators.records import RDF_TYPE


def equal_nodes(store, type_iri, predicate=RDF_TYPE) -> DataFrame:
    """(id, keep): nodes of the type, and the smallest node with the same properties. Properties are compared by digest and count."""
    of_type = store.quads.where((F.col("p") == T.key(predicate)) & (F.col("o") == T.key(type_iri))).select("s").distinct()
    props = store.quads.join(of_type, "s", "left_semi").select("s", "p", "o").distinct()
    # A node's set is summed from digests, so that a node with very many properties isn't collected
    h = F.sha2(F.concat("p", F.lit("\u0000"), "o"), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"h{k}") for k in range(4)]
    sets = props.groupBy("s").agg(F.count("*").alias("n"), *parts)
    keep = sets.groupBy("n", "h0", "h1", "h2", "h3").agg(F.min("s").alias("keep"))
    return sets.join(keep, ["n", "h0", "h1", "h2", "h3"]).select(F.col("s").alias("id"), "keep")


def merged(store, type_iri, predicate=RDF_TYPE):
    """The store without the others' own quads, with links to them led to the node that stays."""
    gone = equal_nodes(store, type_iri, predicate).where("id != keep")
    q = store.quads.join(gone.select(F.col("id").alias("s")), "s", "left_anti")
    q = q.join(gone.select(F.col("id").alias("o"), "keep"), "o", "left").select("s", "p", F.coalesce("keep", "o").alias("o"), "l")
    return store._with(q.distinct())
