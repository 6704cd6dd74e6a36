"""Breadth-first recursion over a step, each node once at its first depth."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.storage import Scratch


def _first(reached: DataFrame, tags: int) -> DataFrame:
    """One row a node, the same on every run: smallest base and tags."""
    cols = ["base", *(f"tag{k}" for k in range(tags))]
    return reached.groupBy("id").agg(F.min(F.struct(*cols)).alias("f")).select("id", *(f"f.{c}" for c in cols))


def followed(starts: DataFrame, step: Callable, depth: int, unrolled: int) -> tuple[DataFrame, dict]:
    """(base, id, depth, tag0 ...) of nodes reached from starts(id) by step, at most `depth` times (-1: until nothing is new).

    A shallow bound gives one plan: levels deduplicate themselves and the smallest depth of a node wins. Deeper, each level is written to the
    shared folder and joined against what was seen; the driver only learns whether a level is empty.
    """
    frontier = starts.select("id", F.col("id").alias("base"))
    if 0 < depth <= unrolled:
        levels = []
        for d in range(1, depth + 1):
            reached, tags = step(frontier)
            level = _first(reached, len(tags)).withColumn("depth", F.lit(d).cast("long"))
            levels.append(level)
            frontier = level.select("id", "base")
        cols = ["depth", "base", *(f"tag{k}" for k in range(len(tags)))]
        each = reduce(DataFrame.unionByName, levels).groupBy("id").agg(F.min(F.struct(*cols)).alias("f"))
        return each.select("id", *(f"f.{c}" for c in cols)), tags
    scratch, d, levels, seen = Scratch(starts.sparkSession, "recursion"), 0, [], None
    while True:
        d += 1
        reached, tags = step(frontier)
        level = _first(reached, len(tags)).withColumn("depth", F.lit(d).cast("long"))
        if seen is not None:
            level = level.join(seen, "id", "left_anti")
        level = scratch.table(level, f"level{d}")
        levels.append(level)
        if d == depth or level.isEmpty():
            break
        frontier = level.select("id", "base")
        seen = frontier.select("id") if seen is None else seen.union(frontier.select("id"))
        if d % 10 == 0:
            seen = scratch.table(seen, f"seen{d}")
    return reduce(DataFrame.unionByName, levels), tags


def closure(edges: DataFrame) -> DataFrame:
    """(a, b) of the transitive closure of (a, b) edges, doubling path lengths until nothing is new."""
    scratch, k = Scratch(edges.sparkSession, "closure"), 0
    now = scratch.table(edges.select("a", "b").distinct(), "step0")
    before = now.count()
    while True:
        k += 1
        longer = now.alias("x").join(now.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        now = scratch.table(now.union(longer).distinct(), f"step{k}")
        scratch.drop(f"step{k - 1}")
        if (after := now.count()) == before:
            return now
        before = after
