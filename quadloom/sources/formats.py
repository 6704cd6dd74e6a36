"""Formats by name or extension: N-Quads, JSON quads, JSON-LD, Parquet in and out; DOT, GML and GraphML out.

Text formats with a head and a foot are written as sorted parts: the files of the folder, in the order of their names, are one document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.functions import terms as T
from quadloom.sources import jsonld, nquads

EXTENSIONS = {"nq": "nquads", "nt": "nquads", "json": "json", "jsonl": "json", "jsonld": "jsonld", "parquet": "parquet", "dot": "dot", "gv": "dot", "gml": "gml", "graphml": "graphml"}
READABLE, WRITABLE = ("nquads", "json", "jsonld", "parquet"), ("nquads", "json", "jsonld", "parquet", "dot", "gml", "graphml")
_SCHEMA = "s string, p string, o string, l string"


def format_of(path: str, format: str | None = None) -> str:
    """By extension, compression's aside; N-Quads if there is none that is known."""
    if format:
        return format
    parts = [p for p in path.rstrip("/").lower().rsplit("/", 1)[-1].split(".")[1:] if p not in ("gz", "bz2", "zst")]
    return EXTENSIONS.get(parts[-1] if parts else "", "nquads")


def read(spark: SparkSession, path: str, format: str | None = None, **options) -> DataFrame:
    kind = format_of(path, format)
    if kind == "nquads":
        return nquads.read(spark, path, **options)
    if kind == "json":
        return json_quads(spark.read.schema("subject string, predicate string, object string, label string").option("multiLine", options.get("multi_line", False)).json(path))
    if kind == "jsonld":
        return jsonld.read(spark, path)
    if kind == "parquet":
        return spark.read.schema(_SCHEMA).parquet(path)
    raise ValueError(f"{kind} can't be read; {', '.join(READABLE)} can")


def json_quads(rows: DataFrame) -> DataFrame:
    """(subject, predicate, object, label) texts: <x> is an IRI, _:x a blank node, a quoted literal itself, other text a String."""

    def term(name: str) -> Column:
        c = F.col(name)
        written = c.rlike(r'^(<.*>|_:.*|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)$')
        return F.when(written, nquads.canonical(c)).otherwise(T.string_key(c))

    return rows.select(term("subject").alias("s"), term("predicate").alias("p"), term("object").alias("o"), F.when(F.col("label") != "", term("label")).alias("l"))


def convert(spark: SparkSession, sources: list[str], to: str, source_format: str | None = None, format: str | None = None, **options) -> None:
    """Many files into one place, without a store."""
    write(reduce(DataFrame.unionByName, (read(spark, p, source_format) for p in sources)), to, format, **options)


def write(quads: DataFrame, path: str, format: str | None = None, compression: str = "none") -> None:
    kind = format_of(path, format)
    if kind == "nquads":
        nquads.write(quads, path, compression)
    elif kind == "json":
        quads.select(F.col("s").alias("subject"), F.col("p").alias("predicate"), F.col("o").alias("object"), F.col("l").alias("label")).write.mode("overwrite").option("compression", compression).json(path)
    elif kind == "jsonld":
        jsonld.documents(quads).select(F.col("doc").alias("value")).write.mode("overwrite").option("compression", compression).text(path)
    elif kind == "parquet":
        quads.select("s", "p", "o", "l").write.mode("overwrite").parquet(path)
    elif kind in WRITABLE:
        lines = {"dot": dot_lines, "gml": gml_lines, "graphml": graphml_lines}[kind](quads)
        lines.repartitionByRange("place", "value").sortWithinPartitions("place", "value").select("value").write.mode("overwrite").option("compression", compression).text(path)
    else:
        raise ValueError(f"{kind} can't be written; {', '.join(WRITABLE)} can")


def _lines(quads: DataFrame, head: list[str], nodes: DataFrame | None, edges: Column, foot: list[str]) -> DataFrame:
    """(place, value): head, nodes, edges and foot."""
    spark = quads.sparkSession
    fixed = spark.createDataFrame([(0, "\n".join(head)), (3, "\n".join(foot))], "place int, value string")
    out = fixed.unionByName(quads.select(F.lit(2).alias("place"), edges.alias("value")))
    return out.unionByName(nodes) if nodes is not None else out


def _nodes(quads: DataFrame) -> DataFrame:
    return quads.select(F.explode(F.array("s", "o")).alias("id")).distinct()


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def dot_lines(quads: DataFrame) -> DataFrame:
    edge = F.concat(F.lit("\t"), _quoted(F.col("s")), F.lit(" -> "), _quoted(F.col("o")), F.lit(" [ label = "), _quoted(F.col("p")), F.lit(" ]"))
    return _lines(quads, ["digraph quads {"], None, edge, ["}"])


def gml_lines(quads: DataFrame) -> DataFrame:
    """Node numbers are hashes of the terms, so that no node list is counted through."""
    number = lambda c: F.shiftrightunsigned(F.xxhash64(c), 1).cast("string")
    text = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))
    nodes = _nodes(quads).select(F.lit(1).alias("place"), F.concat(F.lit("  node [ id "), number(F.col("id")), F.lit(" label "), text(F.col("id")), F.lit(" ]")).alias("value"))
    edge = F.concat(F.lit("  edge [ source "), number(F.col("s")), F.lit(" target "), number(F.col("o")), F.lit(" label "), text(F.col("p")), F.lit(" ]"))
    return _lines(quads, ["graph [", "  directed 1"], nodes, edge, ["]"])


def graphml_lines(quads: DataFrame) -> DataFrame:
    nodes = _nodes(quads).select(F.lit(1).alias("place"), F.concat(F.lit('    <node id="'), _xml(F.col("id")), F.lit('"/>')).alias("value"))
    edge = F.concat(F.lit('    <edge source="'), _xml(F.col("s")), F.lit('" target="'), _xml(F.col("o")), F.lit('"><data key="predicate">'), _xml(F.col("p")), F.lit("</data></edge>"))
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '  <key id="predicate" for="edge" attr.name="predicate" attr.type="string"/>', '  <graph edgedefault="directed">']
    return _lines(quads, head, nodes, edge, ["  </graph>", "</graphml>"])
