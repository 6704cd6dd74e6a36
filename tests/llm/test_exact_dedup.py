import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quadloom.llm import exact_dedup as X
from tests.llm.fixtures import ODD, documents, words

ROWS = [*ODD, *((100 + k, words(k % 7, 30).replace(" ", " " * (k % 3 + 1))) for k in range(60)), (None, "short"), (500, "sh or t"), (501, "s\x0bhort\r\n\t "), (502, "short\u3000")]


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = {}
    for k, n in enumerate(norm):
        groups.setdefault(n, []).append(k)
    out = []
    for k, (i, _) in enumerate(rows):
        g = groups[norm[k]]
        best = min(g, key=lambda j: (-len(rows[j][1] or ""), rows[j][0] is None, rows[j][0] or 0))
        out.append((i, rows[best][0], len(g), hashlib.sha256(norm[k].encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("files", [1000, 1])
def test_against_brute_force(spark, tmp_path, files):
    docs = documents(spark, ROWS)
    docs.write.parquet(str(tmp_path / "d"))
    for source in (docs, spark.read.parquet(str(tmp_path / "d"))):
        got = X.decided(source, files_per_batch=files).collect()
        assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute(ROWS)
        kept = [r for r in got if r["kept"]]
        assert len(kept) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in kept})
        assert all(r["doc_id"] == r["keep_id"] for r in kept)


def test_digests_are_not_believed(spark, tmp_path):
    """With a digest of three values, whole texts decide."""
    documents(spark, ROWS).write.parquet(str(tmp_path / "d"))
    got = X.decided(spark.read.parquet(str(tmp_path / "d")), digest=lambda t: F.substring(F.encode(F.pmod(F.hash(t), F.lit(3)).cast("string"), "utf-8"), 1, 1)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute(ROWS)


def test_deduplicated(spark, tmp_path):
    documents(spark, ROWS).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = X.deduplicated(docs)
    assert out.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({n[3] for n in brute(ROWS)})


def test_empty(spark):
    assert X.decided(documents(spark, [])).count() == 0 and X.deduplicated(documents(spark, [])).count() == 0
