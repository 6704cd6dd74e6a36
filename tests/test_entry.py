"""Every registered query against its SQL on the same tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from quadloom import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}/*.parquet')" if os.path.isdir(p) else f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def rows(df):
    def plain(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return tuple(plain(x) for x in v)
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 9) if isinstance(v, float) else v.item() if hasattr(v, "item") else v

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, con, name):
    got = queries.QUERIES[name](spark, data).toPandas()
    want = con.execute(queries.ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark, data):
    assert set(queries.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
