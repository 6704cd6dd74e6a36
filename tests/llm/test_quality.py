import math

import numpy as np
import pytest

from quadloom.llm import quality
from tests.llm.fixtures import ODD, documents, words


def corpus(spark):
    rows = [(k, words(k, 40) + " the river and the town") for k in range(200)] + [(1000 + k, " ".join(["$$$ CLICK!!! 9999 >>"] * 10) + f" {k}") for k in range(100)]
    labels = spark.createDataFrame([(k, 1, 0, "x") for k in range(0, 200, 2)] + [(1000 + k, 0, 0, "x") for k in range(0, 100, 2)], "doc_id long, quality int, toxic int, key string")
    return documents(spark, rows), labels


def test_held_out(spark):
    docs, labels = corpus(spark)
    kept = {r["doc_id"]: r["kept"] for r in quality.classified(docs, labels).collect()}
    good = [kept[k] for k in range(1, 200, 2)]
    bad = [kept[1000 + k] for k in range(1, 100, 2)]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.05


def test_same_rows_as_kept(spark):
    docs, labels = corpus(spark)
    kept = sorted(r["doc_id"] for r in quality.classified(docs, labels).collect() if r["kept"])
    out = quality.kept(docs, labels)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == kept


def test_against_brute_force(spark):
    docs, labels = corpus(spark)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["l_id"]: r["good"] and r["counts"] for r in quality.halves(quality.labelled(labels)).collect()}
    b = quality.bits(sum(len((t or "").encode()) for t in texts.values()))
    parts = quality.parts(b)
    size = parts[-1].stop
    raw, target = np.zeros(size), np.zeros(size)
    for k, t in texts.items():
        n = np.bincount(quality.features(t.encode(), b), minlength=size)
        raw += n
        target += n * good.get(k, False)
    weight = {}
    for k, t in texts.items():
        f = quality.features(t.encode(), b)
        ratio = sum(math.log((target[x] + 1) / (target[part].sum() + part.stop - part.start)) - math.log((raw[x] + 1) / (raw[part].sum() + part.stop - part.start)) for x in f for part in parts if part.start <= x < part.stop)
        weight[k] = ratio * min(1, quality.EFFECTIVE / max(1, len(f)))
    rows = quality.classified(docs, labels).collect()
    for r in rows:
        assert r["log_weight"] == pytest.approx(weight[r["doc_id"]], abs=1e-6)
        assert r["key"] == pytest.approx(weight[r["doc_id"]] + quality.gumbel(r["doc_id"]), abs=1e-6)
    k = sum(r["kept"] for r in rows)
    assert sorted((r["key"] for r in rows if r["kept"])) == sorted(r["key"] for r in rows)[-k:]


def test_halves(spark):
    _, labels = corpus(spark)
    rows = quality.halves(quality.labelled(labels)).collect()
    assert len(rows) == 150 and all(r["counts"] != r["divides"] for r in rows) and 40 < sum(r["counts"] for r in rows) < 110
    few = quality.halves(quality.labelled(labels.where("doc_id IN (0, 1000)"))).collect()
    assert len(few) == 2 and all(r["counts"] and r["divides"] for r in few)


def test_features():
    """Three n-grams a word but for the first; whole words and whole shapes count; tables grow with the corpus."""
    f = lambda t: quality.features(t.encode(), 15)
    assert [len(f(t)) for t in ("", " ", "a", "a b", "a b c")] == [0, 0, 1, 4, 7]
    one, two = f("x a-b-c-d-e-f-g-1"), f("x a-b-c-d-e-f-g-,")  # shapes that differ after their first characters
    assert one[2] != two[2] and f("the Cat")[3] == f("The cat")[3] and f("the cat")[3] != f("cat the")[3]
    assert all(part.start <= x < part.stop for part, k in zip(quality.parts(15), ([0, 1, 2], [3, 4], [5, 6]), strict=True) for x in f("one two three")[k])
    assert [quality.bits(n) for n in (0, 500_000_000, 30_000_000_000, 10**14)] == [10, 17, 19, 23]


def test_kth_largest(spark):
    import random

    r = random.Random(1)
    values = [r.choice([r.gauss(0, 1), float(r.randint(0, 3)), r.expovariate(1e-6)]) for _ in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 10, 4097, 19_999, 20_000, 30_000):
        assert quality.kth_largest(df, "x", k) == sorted(values, reverse=True)[min(k, 20_000) - 1]
    assert quality.kth_largest(df, "x", 0) == math.inf


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([(4, 1), (4, 0), (7, 1), (None, 1), (99, 1), (8, None)], "doc_id long, quality int")
    assert quality.classified(docs, labels).count() == len(ODD)
    assert quality.classified(docs, labels.limit(0)).where("kept").count() == len(ODD)
    assert quality.kept(docs, labels.where("quality = 0")).count() == len(ODD)
    assert quality.classified(docs.limit(0), labels).count() == 0 and quality.kept(docs.limit(0), labels).count() == 0
    strangers = labels.union(spark.createDataFrame([(k, k % 2) for k in range(5000, 5100)], "doc_id long, quality int"))
    assert sorted(map(str, quality.classified(docs, strangers).collect())) == sorted(map(str, quality.classified(docs, labels).collect()))
    rows = quality.classified(docs, labels).where("doc_id = 4").collect()
    assert len({(r["key"], r["kept"]) for r in rows}) == 1
