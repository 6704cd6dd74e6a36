"""Tables as graphs: one quad per cell, foreign keys as edges."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadloom.functions import terms as T

WHOLE = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}


@dataclass(frozen=True)
class Mapping:
    """subject: (class, key columns). links: column -> class of the node that its value names. values: columns kept as literals."""

    subject: tuple
    links: dict[str, str] = field(default_factory=dict)
    values: tuple[str, ...] = ()
    label: str | None = None  # column whose text names the graph


def node(kind: str, *columns: Column | str) -> Column:
    parts = [F.lit("/"), *(x for c in columns for x in ((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("/")))][:-1]
    return T.iri_key(kind, F.concat(*parts))


@dataclass(frozen=True)
class Node:
    """A term made of a class and key columns."""

    kind: str
    columns: tuple[str, ...]

    def key(self, types: dict[str, str]) -> Column:
        return node(self.kind, *self.columns)

    def number(self, types: dict[str, str]) -> bool:
        """Whether the class and one whole number say which node it is."""
        return len(self.columns) == 1 and types[self.columns[0]] in WHOLE

    def pushed(self, types: dict[str, str], keys: Iterable[str]) -> Column | None:
        """A condition on the columns that every row with one of the keys meets; None if no row can."""
        start, found = f"<{self.kind}/", []
        for k in keys:
            if not (k.startswith(start) and k.endswith(">")):
                continue
            texts = k[len(start) : -1].split("/") if len(self.columns) > 1 else [k[len(start) : -1]]
            if len(texts) != len(self.columns):
                return F.lit(True)  # texts with slashes: left to the condition on keys
            found.append(tuple(_native(types[c], t) for c, t in zip(self.columns, texts, strict=True)))
        return _one_of(self.columns, [f for f in found if NEVER not in f])

    def apart(self, kind: str) -> bool:
        """Whether no node of the class `kind` can be one of these."""
        return not f"{self.kind}/".startswith(f"{kind}/") and not f"{kind}/".startswith(f"{self.kind}/")


@dataclass(frozen=True)
class Value:
    """A literal made of one column."""

    column: str

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.column,)

    def key(self, types: dict[str, str]) -> Column:
        return T.KEY_OF[types[self.column]](F.col(self.column))

    def number(self, types: dict[str, str]) -> bool:
        return False

    def pushed(self, types: dict[str, str], keys: Iterable[str]) -> Column | None:
        kind, found = types[self.column], []
        for k in keys:
            if not k.startswith('"'):
                continue
            value = T.parse(k)
            if kind == "string":
                found.append((value if isinstance(value, str) else NEVER,))
            elif kind in WHOLE:
                found.append((_native(kind, str(value)) if isinstance(value, int) and not isinstance(value, bool) else NEVER,))
            elif kind == "double":
                if value == 0 or value != value:
                    return F.lit(True)  # statistics of files may leave out NaN and signs of zero
                found.append((value if isinstance(value, float) else NEVER,))
            elif kind == "boolean":
                found.append((value if isinstance(value, bool) else NEVER,))
            else:
                return F.lit(True)
        return _one_of((self.column,), [f for f in found if NEVER not in f])

    def apart(self, kind: str) -> bool:
        return True


NEVER, ANY = object(), object()


def _native(kind: str, text: str):
    """The column's value that is cast to this text; NEVER if there is none, ANY if that isn't told here."""
    if kind == "string":
        return text
    if kind not in WHOLE:
        return ANY
    try:
        value = int(text)
    except ValueError:
        return NEVER
    return value if str(value) == text and -(1 << WHOLE[kind]) <= value < 1 << WHOLE[kind] else NEVER


def _one_of(columns: Sequence[str], found: list[tuple]) -> Column | None:
    if not found:
        return None
    each = [F.col(c).isin(*dict.fromkeys(values)) for c, values in zip(columns, zip(*found, strict=True), strict=True) if ANY not in values]
    return reduce(Column.__and__, each, F.lit(True))


@dataclass(frozen=True)
class Cell:
    """The quads of one column: its rows, and how their terms are made. A row with a null in a term's columns gives none."""

    table: DataFrame
    predicate: str
    subject: Node
    object: Node | Value
    label: str | None = None

    def side(self, direction: str) -> Node | Value:
        return self.subject if direction == "s" else self.object

    def restricted(self, wanted: dict[str, Iterable[str]]) -> Cell | None:
        """With conditions on columns that rows must meet to have the wanted keys (by direction); None if none has."""
        types, out = dict(self.table.dtypes), self.table
        for d, keys in wanted.items():
            if d == "p":
                if self.predicate not in keys:
                    return None
                continue
            if d == "l":
                if self.label is None:
                    return None
                if types[self.label] != "string":
                    continue
                condition = _one_of((self.label,), [(k[1:-1],) for k in keys if k.startswith("<")])
            else:
                condition = self.side(d).pushed(types, keys)
            if condition is None:
                return None
            out = out.where(condition)
        return replace(self, table=out)

    def quads(self, numbers: Iterable[str] = ()) -> DataFrame:
        """(s, p, o, l), and for each direction in `numbers` the number of its node, as s_n or o_n."""
        types = dict(self.table.dtypes)
        held = self.table.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in dict.fromkeys((*self.subject.columns, *self.object.columns)))))
        label = T.iri_key(F.col(self.label)) if self.label else F.lit(None).cast("string")
        terms = [self.subject.key(types).alias("s"), F.lit(self.predicate).alias("p"), self.object.key(types).alias("o"), label.alias("l")]
        return held.select(*terms, *(F.col(self.side(d).columns[0]).cast("bigint").alias(f"{d}_n") for d in numbers))

    def class_of(self, direction: str) -> str | None:
        term = self.side(direction)
        return term.kind if term.number(dict(self.table.dtypes)) else None


def cells(table: DataFrame, mapping: Mapping) -> list[Cell]:
    """One for each column of the mapping."""
    subject = Node(mapping.subject[0], tuple(mapping.subject[1:]))
    ends = {**{c: Node(to, (c,)) for c, to in mapping.links.items()}, **{c: Value(c) for c in mapping.values}}
    return [Cell(table, f"<{c}>", subject, o, mapping.label) for c, o in ends.items()]


def restricted(parts: Iterable[Cell], wanted: dict[str, Iterable[str]]) -> list[Cell]:
    return [c for c in (p.restricted(wanted) for p in parts) if c is not None]


def classes(parts: Sequence[Cell]) -> dict[str, str]:
    """direction -> class, where all cells name their nodes by one class and a number."""
    return {d: first for d in "so" if parts and (first := parts[0].class_of(d)) and all(p.class_of(d) == first for p in parts)}


def united(parts: Sequence[Cell], numbers: Iterable[str] = ()) -> DataFrame:
    """The quads of all cells: one scan per column, so that conditions prune columns and files' parts."""
    return reduce(DataFrame.unionByName, (p.quads(numbers) for p in parts))


def quads(table: DataFrame, mapping: Mapping) -> DataFrame:
    """(s, p, o, l) in one scan: each row is exploded once, cells that are null give nothing."""
    parts, types = cells(table, mapping), dict(table.dtypes)
    held = [F.struct(F.lit(p.predicate).alias("p"), p.object.key(types).alias("o")) for p in parts]
    label = T.iri_key(F.col(mapping.label)) if mapping.label else F.lit(None).cast("string")
    out = table.select(node(*mapping.subject).alias("s"), label.alias("l"), F.explode(F.array(*held)).alias("c"))
    return out.select("s", "c.p", "c.o", "l").where("s IS NOT NULL AND o IS NOT NULL")


def cell_quads(table: DataFrame, mapping: Mapping) -> DataFrame:
    """The same as a union of one scan per column."""
    return united(cells(table, mapping))
