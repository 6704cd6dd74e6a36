import re
from math import ceil

import duckdb
import pytest

from quadloom.llm import licenses
from tests.llm.fixtures import ODD, documents, words

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GPL = "This work is licensed under the GNU General Public License version 3."
ROWS = [
    *ODD, (20, "All rights reserved. all RIGHTS  reserved"), (21, "licensed under CC BY-NC 4.0"), (22, f"{words(1, 50)}\n{GPL}\n{words(2, 50)}"), (23, "This work is licensed under the GNU\nGeneral Public License version 3"), (24, "Released under the MIT"),
    (25, "permission to use copy modify and/or distribute this software for any purpose with or without fee is granted"), (26, "allrights reserved all rights, reserved"), (27, "cc by cc by"), (28, "Licensed under the Apache License, Version 2.0"), (29, "\u212aELVIN all rights reserved"), (30, "cc\nby"),
]


def lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


def brute(text):
    text = text or ""
    ws = SPLIT.findall(lower(text))
    starts, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        at = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
        starts += at
        base |= {label} if at else set()
    lines = [SPLIT.findall(lower(x)) for x in text.split("\n")]
    vocabulary = {w for _, s in licenses.TEMPLATES for w in s.split()}
    best, labels = 0.0, set(base)
    for a, b in zip(lines, [*lines[1:], []], strict=True):
        if not vocabulary & set(a):
            continue
        for label, s in licenses.TEMPLATES:
            t = set(s.split())
            n = len(t & (set(a) | set(b)))
            if n >= max(1, ceil(licenses.THRESHOLD * len(t) - 1e-9)):
                best, labels = max(best, n / len(t)), labels | {label}
    return (len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if starts else best)


def test_against_brute_force(spark):
    got = sorted(((r["doc_id"], tuple(r)[1:8]) for r in licenses.scanned(documents(spark, ROWS)).collect()), key=repr)
    assert got == sorted(((i, brute(t)) for i, t in ROWS), key=repr)


def test_oracle_agrees(spark, tmp_path):
    documents(spark, [r for r in ROWS if r[0] not in (9,)]).write.parquet(str(tmp_path / "d"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = sorted(con.execute(licenses.oracle()).fetchall(), key=repr)
    got = licenses.scanned(spark.read.parquet(str(tmp_path / "d"))).drop("matches")
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_filters_lose_nothing_with_other_thresholds(spark):
    templates = (("a", "one two three four five"), ("b", "four five six"), ("c", "seven"))
    texts = [(k, " ".join(w for j, w in enumerate("one two three four five six seven".split()) if k >> j & 1)) for k in range(128)]
    for threshold in (0.3, 0.6, 1.0):
        got = {r["doc_id"]: {m["label"] for m in r["matches"]} for r in licenses.scanned(documents(spark, texts), templates, licenses.PHRASES, threshold).collect()}
        for k, text in texts:
            assert got[k] == {label for label, s in templates if len(set(s.split()) & set(text.split())) >= max(1, ceil(threshold * len(s.split()) - 1e-9))}


def test_no_python_in_plan(spark):
    plan = licenses.scanned(documents(spark, ROWS, extra=False))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert licenses.scanned(documents(spark, [])).count() == 0


@pytest.mark.parametrize("word", ["\u212a", "\u0130", "\u03a3"])
def test_only_ascii_case_matters(spark, word):
    assert licenses.scanned(documents(spark, [(1, word + " all rights reserved")])).first()["n_words"] == 4


BSD = "Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that the\nfollowing conditions are met:"
WRAPPED = {
    1: (BSD, "bsd"),
    2: (f"{words(1, 300)} {BSD} {words(2, 300)}", "bsd"),
    3: ("\n".join(BSD.split()), "bsd"),
    4: ("# " + BSD.replace("\n", "\n#\n# "), "bsd"),
    5: ("Released under\n\nthe MIT License", "mit"),
    6: ("Released\n//\nunder\nthe\n\nMIT\nLicense", "mit"),
    7: (BSD.replace("with or\nwithout modification", f"\n{words(3, 60)}\n"), ""),
    8: (f"Released under\n{words(4, 20)}\nthe MIT License", ""),
}


def test_notices_over_many_lines(spark):
    got = {r["doc_id"]: r for r in licenses.scanned(documents(spark, [(k, t) for k, (t, _) in WRAPPED.items()])).collect()}
    assert {k: r["labels"] for k, r in got.items()} == {k: label for k, (_, label) in WRAPPED.items()}
    assert all((r["score"] == 1.0) == (r["labels"] != "") for r in got.values())
    assert [m["line"] for m in got[2]["matches"]] == [0]


def test_runs_against_every_window(spark):
    import random

    r = random.Random(5)
    templates = (("a", "one two three four"), ("b", "four five six two six"), ("c", "seven one"))
    texts = [(k, "".join(r.choice("one two three four five six seven x y z".split()) + r.choice([" ", "\n", "\n", "\n\n"]) for _ in range(r.randint(0, 30)))) for k in range(150)]
    got = {r["doc_id"]: set(r["labels"].split(",")) - {""} for r in licenses.scanned(documents(spark, texts), templates, licenses.PHRASES, 0.75).collect()}
    for k, text in texts:
        ws, lines = text.split(), [x.split() for x in text.split("\n")]
        for label, s in templates:
            t, n = set(s.split()), licenses.STRETCH * len(s.split())
            blocks = [ws[i : i + n] for i in range(len(ws))] + [a + b for a, b in zip(lines, [*lines[1:], []], strict=True)]
            assert (label in got[k]) == any(len(t & set(b)) >= ceil(0.75 * len(t)) for b in blocks), (label, text)
