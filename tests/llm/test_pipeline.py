import re

import pytest

import corpus_pipeline
from quadloom.llm import queries


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        f(spark, docs, data).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns_and_counts(stages, spark, data):
    columns = spark.read.parquet(f"{data}/documents.parquet").columns
    counts = [stages[0][0].count()]
    for _, after in stages[:-1]:
        assert after.columns == columns
        counts.append(after.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0


def test_decisions(stages):
    texts = lambda df: {r["doc_id"]: re.sub(r"\s", "", r["text"] or "") for r in df.collect()}
    before, after = map(texts, stages[1])
    assert sorted(after.values()) == sorted(set(before.values()))
    near = stages[2][1]
    from quadloom.llm import near_dedup

    assert near_dedup.grouped(near).where("NOT kept").count() == 0
    packed = stages[3][1]
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(texts(near))


def test_run_is_the_stages(stages, spark, data):
    key = lambda df: sorted((r["doc_id"], r["start"], tuple(r["ids"])) for r in df.collect())
    assert key(corpus_pipeline.run(spark, data)) == key(stages[-1][1])


def test_quality_held_out(spark, data):
    """Half of the labels fit, the other half judge."""
    from quadloom.llm import quality

    labels, docs = spark.read.parquet(f"{data}/labels.parquet"), spark.read.parquet(f"{data}/documents.parquet")
    kept = {r["doc_id"]: r["kept"] for r in quality.classified(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = [(kept[r["doc_id"]], r["quality"] > 0) for r in labels.where("doc_id % 2 = 1").collect() if r["doc_id"] in kept]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_on_whole_tables(spark, data, name):
    rows = queries.QUERIES[name](spark, data).count()
    table = {"op2": "pages", "op3": "pages", "op7": "conversations", "op9": "embeddings"}.get(name.split("_")[0], "documents")
    whole = spark.read.parquet(f"{data}/{table}.parquet")
    if table == "conversations":
        assert rows == whole.select("conv_id").distinct().count() + 1
    elif name.startswith("op9"):
        assert rows == 5 * whole.where("vec_id % 50 = 0").count()
    elif name.startswith("op5"):
        assert rows >= whole.count()
    else:
        assert rows == whole.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, data, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, data)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
