"""License scans: an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z in lower case. Two things are reported:

* base phrases: every place where a phrase's words stand consecutively;
* templates: a block meets a template if it holds at least `threshold` of the template's distinct words. Blocks are lines, two neighbouring lines,
  and all runs of `STRETCH` times as many words as the template's sentence has, over any number of line ends and lines without words.

Method. Template words are ordered by how many lines of all documents hold them, rare first. A block that shares t of a
template's m words holds one of its m - t + 1 rarest: those are posted in an inverted index, word -> (template, place), and a block
meets only the templates posted under its words (prefix filter). A block with fewer than t template words meets none (length
filter). The same filters, with the words of the whole document for a block, tell for which templates its runs are looked at: those
that start at a template's word, as far as they stand on three lines or more (others are inside blocks of two). Where a block's j-th word is a template's i-th and the first they share, they share at most 1 + min(m - i - 1,
|block| - j - 1) words (positional filter). Survivors are counted in full, so the filters lose nothing and the result doesn't
depend on the order.

The template table is part of the program; word counts are collected to the driver for template words only (at most
`len(vocabulary)` rows, whatever the corpus), so both sides that meet a block are bounded, and no document text is shuffled.

Cases: null text counts as empty: no words, no labels, score 0; repeated rows give repeated results; ties don't arise; further
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: label -> sentence whose distinct words are the template.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
)
THRESHOLD = 0.85
STRETCH = 2
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """array<string>: the words of a text, A-Z in lower case; in what isn't ASCII, case may go too, but nothing becomes or leaves ASCII."""
    spaced = F.regexp_replace(F.replace(text, F.lit("\u212a"), F.lit("\u24d0")), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " ")
    return F.array_remove(F.split(F.lower(spaced), " "), "")


def _literal(values) -> Column:
    return F.array(*map(F.lit, values))


def _places(of: Column, phrase: list[str]) -> Column:
    """Starts of a phrase in an array of words."""
    hit = lambda i: F.lit(True) if not phrase[1:] else _all(F.get(of, i + k) == w for k, w in enumerate(phrase[1:], 1))
    at = F.transform(F.filter(F.transform(of, lambda w, i: F.when(w == phrase[0], i)), lambda i: i.isNotNull()), lambda i: i)
    return F.filter(at, lambda i: F.coalesce(hit(i), F.lit(False)))


def _all(terms) -> Column:
    out = None
    for t in terms:
        out = t if out is None else out & t
    return out


def _templates(templates) -> list[tuple[str, list[str]]]:
    return [(label, sorted(set(sentence.split()))) for label, sentence in templates]


def word_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """In how many lines of all documents each of the given words stands; at most len(vocabulary) rows reach the driver."""
    known = set(vocabulary)
    lines = docs.select(F.explode(F.split(docs[text_col], r"\n")).alias("line"))
    held = lines.select(F.explode(F.array_intersect(_literal(vocabulary), words(F.col("line")))).alias("w"))
    return dict.fromkeys(known, 0) | {r["w"]: r["n"] for r in held.groupBy("w").agg(F.count("*").alias("n")).collect()}


def scanned(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score, and matches: (label, containment, the block's first line) of every template met; of a template's runs the best."""
    sets = _templates(templates)
    vocabulary = sorted({w for _, ws in sets for w in ws})
    often = word_frequencies(docs, vocabulary, text_col)
    order = sorted(vocabulary, key=lambda w: (often[w], w))
    rank = {w: i for i, w in enumerate(order)}
    posted: dict[str, list] = {}
    rows = []
    for k, (label, ws) in enumerate(sets):
        ws, m = sorted(ws, key=rank.get), len(ws)
        t = max(1, ceil(threshold * m - 1e-9))
        rows.append(F.struct(F.lit(label).alias("label"), _literal(ws).alias("words"), F.lit(m).alias("m"), F.lit(t).alias("t"), F.lit(STRETCH * len(templates[k][1].split())).alias("run")))
        for i, w in enumerate(ws[: m - t + 1]):
            posted.setdefault(w, []).append(F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(m).alias("m"), F.lit(t).alias("t")))
    index = F.create_map(*(x for w, hits in sorted(posted.items()) for x in (F.lit(w), F.array(*hits))))
    table = F.array(*rows)

    # A line is cut into words once; all else works on short arrays
    text = F.coalesce(docs[text_col], F.lit(""))
    lines = docs.select(docs[id_col].alias(id_col), F.split(text, r"\n").alias("_lines")).withColumn("_words", F.transform("_lines", words))
    known = lines.withColumn("_known", F.transform("_words", lambda ws: F.array_intersect(_literal(order), ws)))  # in the global order
    near = lambda i: F.array_intersect(_literal(order), F.concat(F.get("_known", i), F.coalesce(F.get("_known", i + 1), F.array().cast("array<string>"))))
    blocks = F.filter(
        F.transform("_known", lambda own, i: F.when(F.size(own) > 0, F.struct(i.alias("at"), near(i).alias("x")))), lambda b: F.coalesce(F.arrays_overlap(b["x"], _literal(sorted(posted))), F.lit(False))
    )

    def candidates(b):
        """(k, i, j) of the first shared word of each template posted under the block's words."""
        hits = F.array_sort(F.flatten(F.transform(b["x"], lambda w, j: F.transform(F.coalesce(F.element_at(index, w), F.array().cast("array<struct<k:int,i:int,m:int,t:int>>")), lambda p: F.struct(p["k"], p["i"], j.alias("j"), p["m"], p["t"])))))
        return F.transform(F.array_distinct(F.transform(hits, lambda h: h["k"])), lambda k: F.element_at(F.filter(hits, lambda h: h["k"] == k), 1))

    def met(b):
        """Templates of which a block holds enough words: k, n, m, t."""
        possible = F.filter(candidates(b), lambda h: (F.size(b["x"]) >= h["t"]) & (F.lit(1) + F.least(h["m"] - h["i"] - 1, F.size(b["x"]) - h["j"] - 1) >= h["t"]))
        counted = F.transform(possible, lambda h: F.struct(h["k"].alias("k"), F.size(F.array_intersect(b["x"], F.element_at(table, h["k"] + 1)["words"])).alias("n"), h["m"].alias("m"), h["t"].alias("t")))
        return F.filter(counted, lambda c: c["n"] >= c["t"])

    def match(c, n, line):
        return F.struct(F.element_at(table, c["k"] + 1)["label"].alias("label"), (n / c["m"]).alias("containment"), line.alias("line"))

    def runs(c):
        """The best run over three lines or more of a template that the document holds: an array of one match or none."""
        template = F.element_at(table, c["k"] + 1)
        held = F.filter("_placed", lambda p: F.array_contains(template["words"], p["w"]))
        near = F.transform(held, lambda h, j: F.filter(F.slice(held, j + 1, template["run"]), lambda p: p["at"] < h["at"] + template["run"]))  # of as many words, as many are held at most
        counted = F.transform(near, lambda ps: F.struct(F.size(F.array_distinct(ps["w"])).alias("n"), (-F.get(ps, 0)["line"]).alias("line"), F.element_at(ps, -1)["line"].alias("last")))
        best = F.array_max(F.filter(counted, lambda r: (r["n"] >= c["t"]) & (r["last"] + r["line"] >= 2)))
        return F.when(best.isNotNull(), F.array(match(c, best["n"], -best["line"]))).otherwise(F.array().cast("array<struct<label:string,containment:double,line:int>>"))

    whole = F.struct(F.array_intersect(_literal(order), F.flatten("_known")).alias("x"))
    long = (F.size(F.filter("_known", lambda ws: F.size(ws) > 0)) > 1) & F.arrays_overlap(F.flatten("_known"), _literal(sorted(posted)))
    placed = F.flatten(F.transform("_words", lambda ws, i: F.transform(ws, lambda w: F.struct(w.alias("w"), i.alias("line")))))
    placed = F.filter(F.transform(placed, lambda p, i: F.struct(p["w"].alias("w"), p["line"].alias("line"), i.alias("at"))), lambda p: F.array_contains(_literal(order), p["w"]))
    matched = known.withColumn("_blocks", blocks).withColumn("_met", F.when(long, met(whole)).otherwise(F.array().cast("array<struct<k:int,n:int,m:int,t:int>>")))
    matched = matched.withColumn("_placed", F.when(F.size("_met") > 0, placed))
    inside = F.flatten(F.transform("_blocks", lambda b: F.transform(met(b), lambda c: match(c, c["n"], b["at"]))))
    matched = matched.withColumn("matches", F.concat(inside, F.flatten(F.transform("_met", runs))))
    counts = matched.select(id_col, "matches", F.aggregate("_words", F.lit(0).cast("long"), lambda n, ws: n + F.size(ws)).alias("n_words"), F.flatten("_words").alias("_all"))
    for k, (p, _) in enumerate(phrases):
        first = p.split()
        counts = counts.withColumn(f"_p{k}", F.when(F.arrays_overlap("_all", _literal([first[-1]])), _places(F.col("_all"), first)).otherwise(F.array().cast("array<int>")))
    places = F.concat(*(F.col(f"_p{k}") for k in range(len(phrases))))
    base_labels = F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(F.size(f"_p{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(phrases))), lambda x: x.isNotNull())))
    labels = F.array_sort(F.array_distinct(F.concat(base_labels, F.transform("matches", lambda x: x["label"]))))
    score = F.when(F.size(places) > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("matches", lambda x: x["containment"])), F.lit(0.0)))
    return counts.select(
        id_col, "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "matches",
    )


def oracle(templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> str:
    """The same by counting every template in every block, for DuckDB."""
    split = lambda x: f"regexp_extract_all(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')"
    sets = [(label, ws, max(1, ceil(threshold * len(ws) - 1e-9))) for label, ws in _templates(templates)]
    table = ", ".join(f"('{label}', {ws!r}, {len(ws)}, {t})" for label, ws, t in sets)
    places = [f"list_filter(range(0, len(ws)), lambda i: {' AND '.join(f'ws[i + {k + 1}] = {w!r}' for k, w in enumerate(p.split()))})" for p, _ in phrases]
    return f"""
WITH t AS (SELECT * FROM (VALUES {table}) AS t(label, words, m, t)),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
b AS (SELECT doc_id, pos, {split("ln")} AS ws FROM l),
w AS (SELECT doc_id, pos, list_concat(ws, lead(ws, 1, []) OVER (PARTITION BY doc_id ORDER BY pos)) AS x, ws FROM b),
c AS (SELECT doc_id, label, t.m, t.t, len(list_intersect(list_distinct(x), words)) AS n FROM w, t WHERE len(list_intersect(ws, {sorted({x for _, ws, _ in sets for x in ws})!r})) > 0),
h AS (SELECT doc_id, list(label) AS labels, max(n / m) AS score FROM c WHERE n >= t GROUP BY doc_id),
a AS (SELECT doc_id, {split("text")} AS ws FROM d),
p AS (SELECT doc_id, len(ws) AS n_words, {', '.join(f'{x} AS p{k}' for k, x in enumerate(places))} FROM a)
SELECT p.doc_id, n_words::BIGINT AS n_words, len(pl)::BIGINT AS n_base, list_min(pl)::BIGINT AS first_word, list_max(pl)::BIGINT AS last_word,
array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, [])))), ',') AS labels,
CASE WHEN len(pl) > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM (SELECT *, list_concat({', '.join(f'p{k}' for k in range(len(phrases)))}) AS pl, list_filter([{', '.join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(phrases))}], lambda x: x IS NOT NULL) AS base FROM p) p LEFT JOIN h USING (doc_id)
"""
