"""The graph: a DataFrame of quads, and the writes that give a new one."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.sources import tables

SCHEMA = "s string, p string, o string, l string"
DIRECTIONS = {"subject": "s", "predicate": "p", "object": "o", "label": "l", "s": "s", "p": "p", "o": "o", "l": "l"}


class QuadExists(ValueError):
    pass


class QuadNotExist(ValueError):
    pass


class NodeNotExists(ValueError):
    pass


def quad_rows(spark: SparkSession, quads: Iterable[tuple]) -> DataFrame:
    """Quads of Python terms (or of canonical keys as Raw) as a DataFrame."""
    rows = [tuple(None if v is None else T.key(v) for v in (*q, None)[:4]) for q in quads]
    return spark.createDataFrame(rows, SCHEMA)


class Transaction:
    """An ordered list of changes; adding what is to be removed, or the reverse, cancels out."""

    def __init__(self):
        self.deltas: dict[tuple, int] = {}

    def _put(self, quad: tuple, action: int):
        quad = tuple(None if v is None else T.key(v) for v in (*quad, None)[:4])
        if self.deltas.get(quad) == -action:
            del self.deltas[quad]
        else:
            self.deltas.setdefault(quad, action)
        return self

    def add(self, *quad):
        return self._put(quad, 1)

    def remove(self, *quad):
        return self._put(quad, -1)


class GraphStore:
    """quads(s, p, o, l): canonical term keys, l null for the default graph; a set. Nodes are whatever stands in any direction.

    Stores don't change: a write returns a new one whose plan reads the old.
    """

    def __init__(self, quads: DataFrame, ignore_duplicate: bool = True, ignore_missing: bool = False, cells: Sequence[tables.Cell] = ()):
        """cells: where the quads are those of table columns, how; conditions on terms then reach the columns."""
        self.quads, self.spark, self.cells = quads.select("s", "p", "o", "l"), quads.sparkSession, list(cells)
        self.ignore_duplicate, self.ignore_missing = ignore_duplicate, ignore_missing

    @classmethod
    def of(cls, spark: SparkSession, quads: Iterable[tuple], **options) -> GraphStore:
        return cls(quad_rows(spark, quads).dropDuplicates(), **options)

    @classmethod
    def of_cells(cls, cells: Sequence[tables.Cell], **options) -> GraphStore:
        """Columns of tables as a graph, read where they are. Repeated rows repeat their quads: give distinct ones where it matters."""
        return cls(tables.united(cells), cells=cells, **options)

    def _with(self, quads: DataFrame) -> GraphStore:
        return GraphStore(quads, self.ignore_duplicate, self.ignore_missing)

    # Reading

    def ids(self) -> DataFrame:
        """(id) of every node: terms used in any direction."""
        each = F.explode(F.array_distinct(F.filter(F.array("s", "p", "o", "l"), lambda x: x.isNotNull())))
        return self.quads.select(each.alias("id")).distinct()

    def nodes(self) -> DataFrame:
        """The dictionary: id, kind, str, datatype, lang, i, f, b, ts."""
        c = F.col("id")
        kind = T.kind(c)
        return self.ids().select(
            "id", kind.alias("kind"), T.text(c).alias("str"),
            F.when(kind.isin("typed", "int", "float", "bool", "time"), F.regexp_extract(c, r"(?s)\^\^<([^>]*)>$", 1)).alias("datatype"),
            F.when(kind == "lang", F.regexp_extract(c, r"(?s)@([A-Za-z0-9-]+)$", 1)).alias("lang"),
            T.int_value(c).alias("i"), T.float_value(c).alias("f"), T.bool_value(c).alias("b"), T.time_value(c).alias("ts"),
        )

    def scan(self, **wanted: Iterable[str]) -> DataFrame:
        """Quads with one of the keys in each direction named (s, p, o, l)."""
        wanted = {d: tuple(keys) for d, keys in wanted.items()}
        parts = tables.restricted(self.cells, wanted)
        out = tables.united(parts) if parts else self.quads
        for d, keys in wanted.items():
            out = out.where(F.col(d).isin(*keys))
        return out if parts or not self.cells else out.where(F.lit(False))

    def existing(self, keys: Sequence[str]) -> DataFrame:
        """(id) of the nodes among these keys."""
        each = lambda df, *cs: df.select(F.explode(F.array(*cs)).alias("id")).where(F.col("id").isin(*keys))
        if not self.cells:
            return each(self.quads.where(reduce(Column.__or__, (F.col(c).isin(*keys) for c in "spol"))), *"spol").distinct()
        found = [each(p.quads(), d) for d in "sol" for p in tables.restricted(self.cells, {d: keys})]
        found += [p.quads().limit(1).select(F.col("p").alias("id")) for p in self.cells if p.predicate in keys]
        return reduce(DataFrame.union, found).distinct() if found else self.quads.where(F.lit(False)).select(F.col("s").alias("id"))

    def filter_quads(self, subjects=(), predicates=(), objects=(), labels=()) -> DataFrame:
        """Quads restricted per direction; an empty list restricts nothing."""
        asked = zip("spol", (subjects, predicates, objects, labels), strict=True)
        return self.scan(**{c: [T.key(v) for v in values] for c, values in asked if values})

    def quads_of(self, direction: str, value) -> DataFrame:
        return self.scan(**{DIRECTIONS[direction]: [T.key(value)]})

    def stats(self) -> dict[str, int]:
        return {"nodes": self.ids().count(), "quads": self.quads.count()}

    # Writing

    def apply(self, deltas: DataFrame | Transaction) -> GraphStore:
        """deltas: (s, p, o, l, action), +1 or -1. All adds, then all deletes. Raises unless duplicates or missing quads are ignored."""
        if isinstance(deltas, Transaction):
            deltas = self.spark.createDataFrame([(*q, a) for q, a in deltas.deltas.items()], SCHEMA + ", action int")
        adds = deltas.where("action > 0").select("s", "p", "o", "l").distinct()
        gone = deltas.where("action < 0").select("s", "p", "o", "l").distinct()
        if not self.ignore_duplicate and (old := adds.alias("a").join(self.quads.alias("b"), _pairs("a", "b"), "left_semi").first()):
            raise QuadExists(tuple(old))
        after = self.quads.union(adds.alias("a").join(self.quads.alias("b"), _pairs("a", "b"), "left_anti"))
        if not self.ignore_missing and (lost := gone.alias("a").join(after.alias("b"), _pairs("a", "b"), "left_anti").first()):
            raise QuadNotExist(tuple(lost))
        return self._with(after.alias("a").join(gone.alias("b"), _pairs("a", "b"), "left_anti"))

    def add_quads(self, quads: DataFrame | Iterable[tuple]) -> GraphStore:
        rows = quads if isinstance(quads, DataFrame) else quad_rows(self.spark, quads)
        return self.apply(rows.withColumn("action", F.lit(1)))

    def add_quad(self, *quad) -> GraphStore:
        return self.add_quads([quad])

    def remove_quads(self, quads: DataFrame | Iterable[tuple]) -> GraphStore:
        rows = quads if isinstance(quads, DataFrame) else quad_rows(self.spark, quads)
        return self.apply(rows.withColumn("action", F.lit(-1)))

    def remove_quad(self, *quad) -> GraphStore:
        return self.remove_quads([quad])

    def remove_node(self, node) -> GraphStore:
        """Every quad that holds the node in any direction goes."""
        k = F.lit(T.key(node))
        holds = (F.col("s") == k) | (F.col("p") == k) | (F.col("o") == k) | F.col("l").eqNullSafe(k)
        if self.quads.where(holds).isEmpty():
            raise NodeNotExists(T.key(node))
        return self._with(self.quads.where(~holds))

    # Storage

    def save(self, path: str, files_by_predicate: bool = True) -> None:
        """As Parquet, sorted by predicate and subject, so that row groups are pruned by predicate; hot predicates spread over many files."""
        out = self.quads.repartitionByRange("p", "s").sortWithinPartitions("p", "s") if files_by_predicate else self.quads
        out.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **options) -> GraphStore:
        return cls(spark.read.schema(SCHEMA).parquet(path), **options)

    def V(self, *values):
        from quadloom.plans.path import Path

        return Path(self).start(*values)


def _pairs(a: str, b: str):
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in "spol"))
