import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadloom.llm import ann


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "vec_id long, embedding array<float>, id string, v string, q string").repartition(3)


def brute(rows, is_query, k):
    """By all pairs."""
    good = {i: [float(np.float32(x)) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)}
    out = {}
    for i, v in good.items():
        if is_query(i):
            near = sorted((-ann.cosine(v, w), j) for j, w in good.items() if j != i and len(w) == len(v))[:k]
            out[i] = [(j, -s) for s, j in near]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(got, want):
    return np.mean([len({j for j, _ in got.get(q, [])} & {j for j, _ in w}) / max(1, len(w)) for q, w in want.items()])


@pytest.mark.parametrize("kind", ["noise", "clusters"])
def test_recall(spark, kind):
    r = np.random.default_rng(1)
    v = r.standard_normal((1500, 32)) if kind == "noise" else r.standard_normal((30, 32))[r.integers(0, 30, 1500)] + 0.3 * r.standard_normal((1500, 32))
    rows = [(k, v[k].astype(np.float32).tolist()) for k in range(1500)]
    for shard in (4096, 400):
        df = table(spark, rows)
        got = found(ann.neighbours(df, F.col("vec_id") % 10 == 0, 5, shard_rows=shard, block_rows=64))
        want = brute(rows, lambda i: i % 10 == 0, 5)
        assert recall(got, want) >= 0.9
        for q, near in got.items():
            assert len(near) == 5 and all(s == ann.cosine(rows[q][1], rows[j][1]) for j, s in near)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 0.0]), (None, [1.0, 1.0]), (10, [1.0, 0.1]), (11, [2.0, 0.2]), (12, [1.0, 0.1]), (13, [1.0, 0.0, 0.0]), (20, [1e30, 1e30]), (30, [1e-30, 1e-30])]
    got = found(ann.neighbours(table(spark, rows), F.col("vec_id") % 10 == 0, 5))
    want = brute(rows, lambda i: i % 10 == 0, 5)
    assert {q: [j for j, _ in n] for q, n in got.items()} == {q: [j for j, _ in n] for q, n in want.items()}
    assert ann.neighbours(table(spark, []), F.col("vec_id") % 10 == 0).count() == 0


def test_ties_and_copies(spark):
    """A third of all vectors are one; ties go to the smaller ids."""
    r = np.random.default_rng(2)
    rows = [(k, [1.0, 2.0, 3.0] if k % 3 == 0 else r.standard_normal(3).tolist()) for k in range(300)]
    got = found(ann.neighbours(table(spark, rows), F.col("vec_id") == 30, 5, shard_rows=50))
    assert [j for j, _ in got[30]] == [0, 3, 6, 9, 12]


def test_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.5]), (1, [1.0, 0.5]), (1, [5.0, 0.0]), (0, [1.0, 0.0])]
    got = found(ann.neighbours(table(spark, rows), F.col("vec_id") == 0, 5))
    assert [j for j, _ in got[0]] == [1]


def test_chi_square():
    assert ann.chi_square(np.array([7.344]), 8)[0] == pytest.approx(0.5, abs=1e-3)
    assert ann.chi_square(np.array([15.507]), 8)[0] == pytest.approx(0.95, abs=1e-3)


def test_few_cells_are_visited(spark):
    """On clustered data queries leave after a few cells, and find what an exact search finds."""
    r = np.random.default_rng(5)
    v = r.standard_normal((60, 32))[r.integers(0, 60, 6000)] + 0.05 * r.standard_normal((6000, 32))
    rows, visits = [(k, v[k].tolist()) for k in range(6000)], []
    got = found(ann.neighbours(table(spark, rows), F.col("vec_id") % 20 == 0, 5, shard_rows=100, visits=visits))
    unit = np.array([r[1] for r in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosines = unit[::20] @ unit.T
    cosines[np.arange(300), np.arange(0, 6000, 20)] = -2
    want = {20 * q: [(j, 0) for j in np.argsort(-c)[:5].tolist()] for q, c in enumerate(cosines)}
    assert recall(got, want) >= 0.9
    cells = visits[0][1]
    assert cells >= 50 and sum(n for n, _ in visits) < 0.35 * 300 * cells


def test_tiny_and_huge_numbers(spark):
    df = spark.createDataFrame([(0, [1e-170, 2e-170]), (1, [1e160, 2e160]), (2, [3.0, -1.0]), (3, [1e-300, 2.1e-300]), (4, [1e308, -1e308])], "vec_id long, embedding array<double>")
    got = found(ann.neighbours(df, F.col("vec_id") == 0, 5))
    assert [j for j, _ in got[0]] == [1, 3, 2, 4] and got[0][0][1] == pytest.approx(1.0) and all(abs(s) <= 1.000001 for _, s in got[0])
