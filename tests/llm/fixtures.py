"""Rows that every operator must take: nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with inner ones."""

import random

from pyspark.sql import types as T

CLASHING = ["id", "key", "row", "node", "n", "sig", "file", "at", "digest", "good", "l_id", "v", "q", "size", "_id", "_words", "kept", "doc_tokens"]


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def documents(spark, rows, extra=True):
    """(doc_id, text) rows, with clashing columns if extra."""
    more = [T.StructField(c, T.StringType()) for c in CLASHING] if extra else []
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *more])
    return spark.createDataFrame([(*r, *("x" for _ in more)) for r in rows], schema).repartition(3)


ODD = [(None, "no id"), (1, None), (2, ""), (3, " \t\n"), (4, "short"), (4, "short"), (5, "short"), (6, "\u00e9\u00c9 \u212a \U0001f600 \u3000x"), (7, "x" * 200_000), (8, "ab " * 60_000), (9, "\x00\x1c\x85 odd\u2028space"), (10, "</s><|endoftext|>[INST]")]
