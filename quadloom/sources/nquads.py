"""N-Quads lines, read and written by column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import terms as T

_TERM = r'<[^>\s]*>|_:\S*[^\s.]|"(?:[^"\\]|\\.)*+"(?:@[A-Za-z0-9-]+|\^\^<[^>\s]*>)?'
_MARK = "\u0001"  # stands between terms once a line is split
_LINE = rf"^\s*({_TERM})\s+({_TERM})\s+({_TERM})\s*({_TERM})?\s*\.?\s*(?:#.*)?$"


def unescaped(c: Column) -> Column:
    """\\uXXXX and \\UXXXXXXXX become characters; other escapes stay."""
    c = F.replace(c, F.lit("\\\\"), F.lit("\u0000"))
    for mark, digits, charset in (("u", 4, "UTF-16BE"), ("U", 8, "UTF-32")):
        first, rest = F.get(F.split(c, r"\\" + mark), 0), F.split(c, r"\\" + mark)
        more = F.transform(F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))), lambda x: F.concat(F.decode(F.unhex(F.substring(x, 1, digits)), charset), F.substring(x, F.lit(digits + 1), F.length(x))))  # noqa: B023
        c = F.when(c.contains("\\" + mark), F.concat(first, F.array_join(more, ""))).otherwise(c)
    return F.replace(c, F.lit("\u0000"), F.lit("\\\\"))


def _bound(c: Column, f) -> Column:
    """f(c) with c computed once. Spark calls lambdas instead of writing them out: long expressions would become methods that the JVM never compiles."""
    return F.transform(F.array(c), f)[0]


def _typed(plain: Column) -> Column:
    lexical = T.text(plain)
    out = F.when(plain.startswith('"') & plain.contains("\\") & plain.endswith('"'), T.string_key(lexical))
    for datatype, to, key in ((T.INT, "bigint", T.int_key), (T.FLOAT, "double", T.float_key), (T.BOOL, "boolean", T.bool_key), (T.TIME, "timestamp", T.time_key)):
        out = out.when(plain.endswith(f'"^^<{datatype}>'), F.coalesce(key(lexical.try_cast(to)), plain))
    return out.otherwise(plain)


def canonical(c: Column) -> Column:
    """The key of a term written in N-Quads: numbers, booleans and times in one form, escapes too."""
    escaped = c.contains("\\")
    return F.when(~escaped & ~c.endswith(">"), c).when(~escaped & c.startswith("<"), c).otherwise(_bound(F.when(escaped, _bound(c, unescaped)).otherwise(c), _typed))


def parsed(lines: DataFrame, column: str = "value", on_error: str = "fail") -> DataFrame:
    """(s, p, o, l) of lines; blank lines and comments are skipped, others that aren't quads fail or are skipped."""
    lines = lines.select(F.col(column).alias("line")).where(~F.col("line").rlike(r"^\s*(?:#.*)?$"))
    # One match a line, whatever is asked of its terms: conditions do not go below a generator, so they meet ready terms
    split = F.when(F.col("line").contains(_MARK), F.when(F.col("line").rlike(_LINE), F.array(*(F.regexp_extract("line", _LINE, i) for i in (1, 2, 3, 4)))).otherwise(F.array("line")))
    split = split.otherwise(F.split(F.regexp_replace("line", _LINE + "(?s:.*)", _MARK.join(("$1", "$2", "$3", "$4"))), _MARK))
    lines = lines.select("line", F.posexplode(F.array(split)).alias("_", "t"))
    good = F.size("t") == 4
    if on_error == "skip":
        lines = lines.where(good)
    elif on_error == "fail":
        lines = lines.select(F.when(good, F.col("t")).otherwise(F.raise_error(F.concat(F.lit("not a quad: "), F.col("line"))).cast("array<string>")).alias("t"))
    else:
        raise ValueError(f"on_error is fail or skip, not {on_error}")
    part = lambda i: F.col("t")[i]
    return lines.select(canonical(part(0)).alias("s"), canonical(part(1)).alias("p"), canonical(part(2)).alias("o"), F.when(part(3) != "", canonical(part(3))).alias("l"))


def read(spark: SparkSession, path: str, on_error: str = "fail") -> DataFrame:
    """Files may be compressed, by extension."""
    return parsed(spark.read.text(path), on_error=on_error)


def lines(quads: DataFrame) -> DataFrame:
    return quads.select(F.concat(F.concat_ws(" ", "s", "p", "o", "l"), F.lit(" .")).alias("value"))


def write(quads: DataFrame, path: str, compression: str = "none") -> None:
    lines(quads).write.mode("overwrite").option("compression", compression).text(path)
