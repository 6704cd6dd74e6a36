"""RDF terms: Python constructors, canonical N-Quads text (the join key), and Spark expressions that read it."""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
INT, FLOAT, BOOL, TIME = XSD + "integer", XSD + "double", XSD + "boolean", XSD + "dateTime"
_TYPED = {INT: "int", FLOAT: "float", BOOL: "bool", TIME: "time"}
_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^>]*)>)?', re.S)


@dataclass(frozen=True)
class IRI:
    value: str


@dataclass(frozen=True)
class BNode:
    value: str


@dataclass(frozen=True)
class Lang:
    value: str
    lang: str


@dataclass(frozen=True)
class Typed:
    value: str
    datatype: str


@dataclass(frozen=True)
class Raw:
    """A term given by its N-Quads text."""

    text: str


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")


_BACK = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f"}


def unescape(text: str) -> str:
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _BACK.get(m[1], m[1]), text, flags=re.S)


def float_text(x: float) -> str:
    """As the JVM writes doubles, so that constants meet cast columns."""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else "Infinity" if x > 0 else "-Infinity"
    if x == 0 or 1e-3 <= abs(x) < 1e7:
        return repr(x)  # never in exponents in this range
    digits, exponent = _shortest(x)
    return f"{digits}E{exponent}"


def _shortest(x: float) -> tuple[str, int]:
    sign = "-" if x < 0 else ""
    mantissa, _, exp = repr(abs(x)).partition("e")
    whole, _, part = mantissa.partition(".")
    digits = (whole + (part if part != "0" else "")).lstrip("0")
    at = int(exp or 0) + (len(whole) - 1 if whole != "0" else -(len(part) - len(part.lstrip("0"))) - 1)
    digits = digits.rstrip("0") or "0"
    return f"{sign}{digits[0]}.{digits[1:] or '0'}", at


def key(value) -> str:
    """Canonical text of a Python value. Plain strings are String literals; see text_term for front-ends' coercion."""
    if isinstance(value, IRI):
        return f"<{value.value}>"
    if isinstance(value, BNode):
        return f"_:{value.value}"
    if isinstance(value, Raw):
        return key(parse(value.text))
    if isinstance(value, Lang):
        return f'"{escape(value.value)}"@{value.lang}'
    if isinstance(value, Typed):
        return key(parse(f'"{escape(value.value)}"^^<{value.datatype}>')) if value.datatype in _TYPED else f'"{escape(value.value)}"^^<{value.datatype}>'
    if isinstance(value, bool):
        return f'"{str(value).lower()}"^^<{BOOL}>'
    if isinstance(value, int):
        return f'"{value}"^^<{INT}>'
    if isinstance(value, float):
        return f'"{float_text(value)}"^^<{FLOAT}>'
    if isinstance(value, dt.datetime):
        utc = value.astimezone(dt.timezone.utc) if value.tzinfo else value
        return f'"{utc.strftime("%Y-%m-%dT%H:%M:%S.%f")}Z"^^<{TIME}>'
    if isinstance(value, str):
        return f'"{escape(value)}"'
    raise TypeError(f"not a term: {value!r}")


def parse(text: str):
    """A term from its N-Quads text; text that isn't one is a String."""
    if text.startswith("<") and text.endswith(">"):
        return IRI(unescape(text[1:-1]))
    if text.startswith("_:"):
        return BNode(text[2:])
    m = _LITERAL.fullmatch(text)
    if not m:
        return text
    value = unescape(m[1])
    if m[2]:
        return Lang(value, m[2])
    try:
        match _TYPED.get(m[3] or ""):
            case "int":
                return int(value)
            case "float":
                return float(value)
            case "bool":
                return {"true": True, "1": True, "false": False, "0": False}[value]
            case "time":
                return dt.datetime.fromisoformat(value.replace("Z", "+00:00"))
    except (ValueError, KeyError):
        pass
    return Typed(value, m[3]) if m[3] else value


def text_term(text: str):
    """Front-ends' coercion: <x> is an IRI, _:x a blank node, other text a String."""
    if text.startswith("<") and text.endswith(">"):
        return IRI(text[1:-1])
    return BNode(text[2:]) if text.startswith("_:") else text


def kind_of(value) -> str:
    if isinstance(value, Raw):
        value = parse(value.text)
    kinds = ((IRI, "iri"), (BNode, "bnode"), (Lang, "lang"), (Typed, "typed"), (bool, "bool"), (int, "int"), (float, "float"), (dt.datetime, "time"), (str, "str"))
    return next(k for t, k in kinds if isinstance(value, t))


# Spark expressions: from native columns to keys


def iri_key(*parts) -> Column:
    """<parts joined>; strings are literal, columns are cast."""
    return F.concat(F.lit("<"), *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts), F.lit(">"))


def string_key(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), c, F.lit('"'))


def _typed_key(text: Column, datatype: str) -> Column:
    return F.concat(F.lit('"'), text, F.lit(f'"^^<{datatype}>'))


def int_key(c: Column) -> Column:
    return _typed_key(c.cast("bigint").cast("string"), INT)


def float_key(c: Column) -> Column:
    return _typed_key(c.cast("double").cast("string"), FLOAT)


def bool_key(c: Column) -> Column:
    return _typed_key(c.cast("boolean").cast("string"), BOOL)


def time_key(c: Column) -> Column:
    utc = F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone())
    return _typed_key(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), TIME)


def local_time_key(c: Column) -> Column:
    """Of times without a zone, which count as UTC."""
    return _typed_key(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), TIME)


KEY_OF = {"string": string_key, "bigint": int_key, "int": int_key, "smallint": int_key, "tinyint": int_key, "double": float_key, "float": float_key, "boolean": bool_key, "timestamp": time_key, "timestamp_ntz": local_time_key, "date": local_time_key}


# ... and back


def kind(c: Column) -> Column:
    """iri, bnode, str, lang, typed, int, float, bool or time."""
    out = F.when(c.startswith("<"), "iri").when(c.startswith("_:"), "bnode").when(c.endswith('"'), "str")
    for datatype, name in _TYPED.items():
        out = out.when(c.endswith(f'"^^<{datatype}>'), name)
    return out.when(c.endswith(">"), "typed").otherwise("lang")


def text(c: Column) -> Column:
    """The text inside a term: without brackets, quotes, language or datatype, unescaped."""
    lexical = F.regexp_extract(c, r'(?s)^"((?:[^"\\]|\\.)*+)"', 1)
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ('\\"', '"')):
        # A backslash that is itself escaped is set aside first
        lexical = F.replace(lexical if a != "\\n" else F.replace(lexical, F.lit("\\\\"), F.lit("\u0000")), F.lit(a), F.lit(b))
    lexical = F.replace(lexical, F.lit("\u0000"), F.lit("\\"))
    plain = F.substring(c, F.lit(2), F.length(c) - 2)
    return F.when(c.startswith("<"), plain).when(c.startswith("_:"), F.substring(c, F.lit(3), F.length(c))).when(c.endswith('"') & ~c.contains("\\"), plain).otherwise(lexical)


def _lexical(c: Column, datatype: str) -> Column:
    tail = f'"^^<{datatype}>'
    return F.when(c.endswith(tail), F.substring(c, F.lit(2), F.length(c) - 1 - len(tail)))


def int_value(c: Column) -> Column:
    return _lexical(c, INT).try_cast("bigint")


def float_value(c: Column) -> Column:
    return _lexical(c, FLOAT).try_cast("double")


def bool_value(c: Column) -> Column:
    return _lexical(c, BOOL).try_cast("boolean")


def time_value(c: Column) -> Column:
    return _lexical(c, TIME).try_cast("timestamp")


NATIVE = {"string": text, "bigint": int_value, "int": lambda c: int_value(c).cast("int"), "double": float_value, "boolean": bool_value, "timestamp": time_value}
