"""Value filters on a term column."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadloom.functions import terms as T

_OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


@dataclass(frozen=True)
class Compare:
    """Only terms of the constant's own kind match; constants of other kinds than the six typed ones compare rendered text."""

    op: str
    value: object

    def on(self, c: Column) -> Column:
        kind, compare = T.kind_of(self.value), _OPS[self.op]
        value = T.parse(self.value.text) if isinstance(self.value, T.Raw) else self.value
        match kind:
            case "int":
                out = compare(T.int_value(c), F.lit(value).cast("bigint"))
            case "float":
                out = compare(T.float_value(c), F.lit(value))
            case "time":
                out = compare(T.time_value(c), T.time_value(F.lit(T.key(value))))
            case "str":
                out = F.when(c.startswith('"') & c.endswith('"'), compare(T.text(c), F.lit(value)))
            case "iri":
                out = F.when(c.startswith("<"), compare(T.text(c), F.lit(value.value)))
            case "bnode":
                out = F.when(c.startswith("_:"), compare(T.text(c), F.lit(value.value)))
            case _:
                out = compare(c, F.lit(T.key(value)))
        return F.coalesce(out, F.lit(False))


def _checked(pattern: str) -> str:
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<|\(\?P=", pattern):
        raise ValueError(f"lookaround and back-references are not part of the pattern language: {pattern}")
    return pattern.replace("(?P<", "(?<")


@dataclass(frozen=True)
class Regex:
    """Partial match on the text of strings; on IRIs and blank nodes too if refs."""

    pattern: str
    refs: bool = False

    def on(self, c: Column) -> Column:
        held = c.startswith(chr(34))
        for datatype in (T.INT, T.FLOAT, T.BOOL, T.TIME):
            held = held & ~c.endswith(f'"^^<{datatype}>')
        if self.refs:
            held = held | ~c.startswith('"')
        return held & T.text(c).rlike(_checked(self.pattern))


@dataclass(frozen=True)
class Like:
    """% is any run, ? any character; refs match too. An empty pattern matches nothing, one of % only everything."""

    pattern: str

    def on(self, c: Column) -> Column:
        if not self.pattern:
            return F.lit(False)
        if not self.pattern.strip("%"):
            return F.lit(True)
        return Regex("^" + "".join({"%": ".*", "?": "."}.get(x, re.escape(x)) for x in self.pattern) + "$", True).on(c)


def lt(v):
    return Compare("<", v)


def lte(v):
    return Compare("<=", v)


def gt(v):
    return Compare(">", v)


def gte(v):
    return Compare(">=", v)


def regex(pattern, refs=False):
    return Regex(pattern, refs)


def like(pattern):
    return Like(pattern)
