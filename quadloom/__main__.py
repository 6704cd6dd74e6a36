"""python -m quadloom: load, dump, convert, query, repl, dedup, schema and health over a graph stored as Parquet."""

from __future__ import annotations

import argparse
import json
import sys


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quadloom", description=__doc__)
    p.add_argument("--master", default=None, help="Spark master; the environment's if left out")
    sub = p.add_subparsers(dest="command", required=True)
    x = sub.add_parser("init", help="an empty graph")
    x.add_argument("graph")
    x = sub.add_parser("load", help="files into a graph")
    x.add_argument("graph")
    x.add_argument("files", nargs="+")
    x.add_argument("--format")
    x.add_argument("--append", action="store_true")
    x = sub.add_parser("dump", help="a graph into a file format")
    x.add_argument("graph")
    x.add_argument("to")
    x.add_argument("--format")
    x.add_argument("--compression", default="none")
    x = sub.add_parser("convert", help="files into another format")
    x.add_argument("to")
    x.add_argument("files", nargs="+")
    x.add_argument("--source-format")
    x.add_argument("--format")
    for name in ("query", "repl"):
        x = sub.add_parser(name)
        x.add_argument("graph")
        x.add_argument("--lang", default="chains", choices=("chains", "graphql", "templates", "sexp", "steps"))
        x.add_argument("--limit", type=int, default=100)
        if name == "query":
            x.add_argument("text", help="the query, or - for standard input")
    x = sub.add_parser("dedup", help="nodes of a type with equal properties become one")
    x.add_argument("graph")
    x.add_argument("to")
    x.add_argument("type")
    x.add_argument("--predicate", default=None)
    x = sub.add_parser("schema", help="the step language's vocabulary in N-Quads")
    x.add_argument("--namespace", default="http://quadloom.example/steps#")
    x = sub.add_parser("health", help="can the graph be read")
    x.add_argument("graph")
    return p


def answer(store, lang: str, text: str, limit: int = 100) -> list:
    """Results of a query as JSON values."""
    from quadloom.languages import chains, graphql, sexp, steps, templates

    if lang == "chains":
        return chains.run(store, text, limit)
    if lang == "graphql":
        return [graphql.response(store, text)]
    if lang == "templates":
        return templates.execute(store, text, limit)
    if lang == "sexp":
        return [{k: chains.native(v) for k, v in r.items()} for r in sexp.execute(store, text, limit)]
    return steps.execute(store, text)[: limit if limit >= 0 else None]


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "schema":
        from quadloom.functions import terms as T
        from quadloom.languages.steps import vocabulary

        for q in vocabulary(args.namespace):
            print(" ".join(T.key(v) for v in q if v is not None), ".")
        return 0
    from pyspark.sql import SparkSession

    from quadloom.sources import formats
    from quadloom.store import SCHEMA, GraphStore

    builder = SparkSession.builder.appName("quadloom")
    spark = (builder.master(args.master) if args.master else builder).getOrCreate()
    if args.command == "init":
        GraphStore(spark.createDataFrame([], SCHEMA)).save(args.graph)
    elif args.command == "load":
        new = None
        for f in args.files:
            q = formats.read(spark, f, args.format)
            new = q if new is None else new.unionByName(q)
        if args.append:
            new = new.exceptAll(GraphStore.load(spark, args.graph).quads).distinct()
            new.write.mode("append").parquet(args.graph)
        else:
            GraphStore(new.distinct()).save(args.graph)
    elif args.command == "dump":
        formats.write(GraphStore.load(spark, args.graph).quads, args.to, args.format, args.compression)
    elif args.command == "convert":
        formats.convert(spark, args.files, args.to, args.source_format, args.format)
    elif args.command == "dedup":
        from quadloom.functions import terms as T
        from quadloom.operators import dedup, records

        predicate = T.text_term(args.predicate) if args.predicate else records.RDF_TYPE
        dedup.merged(GraphStore.load(spark, args.graph), T.text_term(args.type), predicate).save(args.to)
    elif args.command == "health":
        print(json.dumps(GraphStore.load(spark, args.graph).stats()))
    elif args.command == "query":
        text = sys.stdin.read() if args.text == "-" else args.text
        for r in answer(GraphStore.load(spark, args.graph), args.lang, text, args.limit):
            print(json.dumps(r, ensure_ascii=False, default=str))
    else:
        store = GraphStore.load(spark, args.graph)
        while True:
            try:
                line = input(f"{args.lang}> ")
            except EOFError:
                return 0
            if not line.strip():
                continue
            try:
                for r in answer(store, args.lang, line, args.limit):
                    print(json.dumps(r, ensure_ascii=False, default=str))
            except ValueError as e:
                print(f"error: {e}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
