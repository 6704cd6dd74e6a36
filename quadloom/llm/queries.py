"""Registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadloom.llm import ann, bpe, chat, exact_dedup, html_extract, licenses, near_dedup, packing, quality, url_filter

BASE_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scans(spark, sf_dir):
    return licenses.scanned(_table(spark, sf_dir, "documents")).drop("matches")


def op2_html_extraction(spark, sf_dir):
    return html_extract.extracted(_table(spark, sf_dir, "pages"))


def op3_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(BASE_RULES, "host string, path string, verdict string")
    return url_filter.judged(_table(spark, sf_dir, "pages"), rules)


def op4_quality_classifier(spark, sf_dir):
    return quality.classified(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_packing(spark, sf_dir):
    return packing.packed_digests(_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark, sf_dir):
    return near_dedup.grouped(_table(spark, sf_dir, "documents"))


def op7_chat_formatting(spark, sf_dir):
    asked = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "human", asked), (-7, 1, "gpt", asked)], "conversation_id long, index long, `from` string, value string")
    return chat.conversation_digests(chat.turns_of_rows(_table(spark, sf_dir, "conversations").unionByName(more, allowMissingColumns=True)))


def op8_bpe(spark, sf_dir):
    return bpe.digests(_table(spark, sf_dir, "documents"))


def op9_nearest_neighbours(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings")
    return ann.neighbours(vectors, vectors["vec_id"] % 50 == 0)


def op10_exact_dedup(spark, sf_dir):
    return exact_dedup.decided(_table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
"""

OP6_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS h FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 80 * (x.n + y.n - p.c)),
r(doc, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc, e.b FROM r JOIN e ON r.root = e.a)
SELECT r.doc AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id, r.doc = min(r.root) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc GROUP BY r.doc
"""

def _op7_sql() -> str:
    """The digests of op7; formatted_chars with the template's escapes, which are put in until no control string is left (here 6 times)."""

    def escaped(x):
        out = rf"replace({x}, '\', '\\')"
        for _ in range(6):
            out = f"regexp_replace({out}, '{chat.control_pattern()}', '\\1\\\\\\2', 'g')"
        return out

    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
 VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum({len(chat.OPEN) + len(chat.CLOSE) + 2} + length({escaped('role')}) + length({escaped('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


OP3_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (SELECT page_id, host, path, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS n FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1
"""

QUERIES = {f.__name__: f for f in (op1_license_scans, op2_html_extraction, op3_url_filters, op4_quality_classifier, op5_packing, op6_minhash_near_dedup, op7_chat_formatting, op8_bpe, op9_nearest_neighbours, op10_exact_dedup)}
ORACLES = {"op1_license_scans": licenses.oracle(), "op3_url_filters": OP3_SQL, "op6_minhash_near_dedup": OP6_SQL, "op7_chat_formatting": _op7_sql(), "op10_exact_dedup": OP10_SQL}
