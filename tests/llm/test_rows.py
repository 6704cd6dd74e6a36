"""Rows, not ids: repeated and null ids, generated rows, clashing names, tables without rows, for the row-keeping operators and stages."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quadloom.llm import exact_dedup, near_dedup
from quadloom.llm.common import Scratch
from tests.llm.fixtures import words

CLASH = ["_file", "_at", "_ql_file", "_ql_at", "file", "at", "id", "norm", "digest", "node", "key", "row", "n", "salt", "best"]


def table(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(c).alias(c) for c in CLASH)) if clash else df


def full(rows):
    return [(i, t, "en", "a", len(t or "")) for i, t in rows]


A, B = words(1, 60), words(2, 60)
ROWS = full([(1, A), (2, A + " end"), (2, B), (None, A + " other"), (None, words(3, 40)), (5, None), (6, ""), (7, A), (7, A)])


@pytest.mark.parametrize("clash", [False, True])
def test_near_keeps_each_text(spark, clash):
    df = table(spark, ROWS, clash)
    got = near_dedup.deduplicated(df, width=5)
    assert got.columns == df.columns
    texts = sorted((r["doc_id"], r["text"]) for r in got.collect() if r["doc_id"] is not None)
    assert texts == [(1, A), (2, B), (5, None), (6, "")]
    assert [r["text"] for r in got.where("doc_id IS NULL").collect()] == [words(3, 40)]


@pytest.mark.parametrize("clash", [False, True])
def test_exact_keeps_each_text(spark, clash):
    df = table(spark, ROWS, clash)
    got = exact_dedup.deduplicated(df)
    assert got.columns == df.columns
    kept = [r["text"] or "" for r in got.collect()]
    assert sorted(kept) == sorted({r[1] or "" for r in ROWS})
    assert exact_dedup.decided(df).count() == len(ROWS)
    assert near_dedup.grouped(df).count() == len(ROWS)


@pytest.mark.parametrize("kind", ["explode", "join", "union", "twice", "filter"])
def test_rows_of_one_place(spark, tmp_path, kind):
    """Several rows from one place of a file are still rows of their own."""
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "x y", ["x y", "z y"]), (2, "x  y", ["v w", "u v"])], "doc_id long, text string, many array<string>").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    made = {
        "explode": lambda: df.select("doc_id", F.explode("many").alias("text")),
        "join": lambda: df.select("doc_id").crossJoin(df.select("text")),
        "union": lambda: df.select("doc_id", "text").union(df.select("doc_id", F.lit("other").alias("text"))),
        "twice": lambda: spark.read.parquet(path, path).select("doc_id", "text"),
        "filter": lambda: df.where("doc_id > 0").select("doc_id", "text"),
    }[kind]()
    got = sorted(r["text"].replace(" ", "") for r in exact_dedup.deduplicated(made).collect())
    assert got == sorted({r["text"].replace(" ", "") for r in made.collect()})


def test_deliveries(spark, tmp_path):
    """State is kept between deliveries, also by another process's object; a repeated name counts once."""
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    key = lambda df: sorted(map(tuple, df.collect()))
    folder = f"file://{tmp_path}/kept"
    first = exact_dedup.Deduplicator(spark, folder)
    assert key(first.deliver(make([(1, "a b"), (2, "c"), (3, "ab")]), "one")) == [(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False)]
    second = exact_dedup.Deduplicator(spark, folder)
    more = make([(4, "ab"), (5, "a  b "), (6, "new"), (7, "c")])
    want = [(4, 5, 4, False), (5, 5, 4, True), (6, 6, 1, True), (7, 2, 2, False)]
    assert key(second.deliver(more, "two")) == want
    assert key(second.deliver(more, "two")) == want
    assert key(second.deliver(make([]), "three")) == []
    assert key(second.deliver(make([(8, "new")]), "four")) == [(8, 6, 2, False)]


def test_hot_digest(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 10**9)
    rows = [(k, "same") for k in range(2500)] + [(k, f"own {k}") for k in range(2500, 2600)]
    got = exact_dedup.decided(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got.where("kept").count() == 101
    assert got.where("doc_id < 2500").agg(F.min("group_size"), F.max("keep_id")).first()[:] == (2500, 0)


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
@pytest.mark.parametrize("rows", [[], full([(None, None), (1, ""), (1, " "), (2, words(4, 30)), (2, words(4, 30)), (3, "x" * 5000)])])
def test_stages_on_odd_rows(spark, data, tmp_path, k, rows):
    path = str(tmp_path / "docs")
    table(spark, rows, True).write.parquet(path)
    docs = spark.read.parquet(path)
    got = corpus_pipeline.STAGES[k][1](spark, docs, data)
    assert got.count() <= max(len(rows) * 50, 0)
    if k < len(corpus_pipeline.STAGES) - 1:
        assert got.columns == docs.columns


def test_plain_scans_are_read_where_they_are(spark, tmp_path):
    path = str(tmp_path / "plain")
    table(spark, ROWS).write.parquet(path)
    df = spark.read.parquet(path)
    scratch = Scratch(spark, "plain")
    for docs in (df, df.where("doc_id > 0").select("doc_id", "text")):
        assert {f.rsplit("/", 2)[-2] for f in exact_dedup.located(docs, scratch)[0].inputFiles()} == {"plain"}
    for docs in (df.union(df), spark.read.parquet(path, path), df.select(F.explode(F.array("text", "text")).alias("text"))):
        assert {f.rsplit("/", 2)[-2] for f in exact_dedup.located(docs, scratch)[0].inputFiles()} == {"stored"}
