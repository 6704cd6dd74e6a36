import random
import re

import pytest

from quadloom.llm import near_dedup as N
from tests.llm.fixtures import ODD, documents, words


def shingles(text, width=4):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return frozenset()
    return frozenset({tuple(ws)} if len(ws) < width else {tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)})


def brute(rows):
    """(id, set size, component, kept) by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                root[find(a)] = find(b)
    out = []
    for k, (i, _) in enumerate(rows):
        if not sets[k]:
            out.append((i, 0, i, True))
            continue
        ids = [rows[j][0] for j in range(len(rows)) if sets[j] and find(j) == find(k)]
        low = min((x for x in ids if x is not None), default=None)
        out.append((i, len(sets[k]), low, i == low))
    return sorted(out, key=repr)


def changed(text, n, seed):
    r, ws = random.Random(seed), text.split()
    for _ in range(n):
        ws[r.randrange(len(ws))] = f"new{r.randrange(10**6)}"
    return " ".join(ws)


def check(spark, rows):
    got = sorted((tuple(r)[:4] for r in N.grouped(documents(spark, rows)).collect()), key=repr)
    assert got == brute(rows)


def test_groups(spark):
    rows, n = list(ODD), 100
    for g in range(12):
        base = words(g, 20 + 60 * (g % 4))
        for k in range(g % 6 + 1):
            rows.append((n, changed(base, k % 4, n)))
            n += 1
    base = words(99, 100)  # a chain: each like the next, the ends unlike
    for k in range(15):
        rows.append((n, base))
        base = changed(base, 1, n)
        n += 1
    rows += [(n, words(5, 80).upper()), (n + 1, words(5, 80).replace(" ", "\n\t"))]
    check(spark, rows)


def test_hot_group(spark):
    """Many near copies, and lines that all documents share."""
    base = words(1, 120)
    rows = [(k, changed(base, k % 5, k)) for k in range(90)] + [(200 + k, f"{words(7, 10)} {words(1000 + k, 25)}") for k in range(40)] + [(400 + k, base) for k in range(30)]
    check(spark, rows)


def test_collapsed_copies_are_not_counted(spark, monkeypatch):
    """Only classes of lists that the pivots left open have all their shingles dealt out."""
    rows, counted, count = [], [], N._shingled
    for g in range(20):
        base = words(700 + g, 100)
        rows += [(10 * g + k, changed(base, min(k, 1), 10 * g + k)) for k in range(6)]
    monkeypatch.setattr(N, "_shingled", lambda texts, width: counted.append(texts.count()) or count(texts, width))
    check(spark, rows)
    assert sum(counted) < len(rows) // 4


def test_around_the_threshold(spark):
    """Sets of similarity just at and just below 0.8."""
    rows = []
    for g in range(10):
        ws = words(500 + g, 75).split()
        rows.append((10 * g, " ".join(ws)))
        for k in range(1, 8):
            rows.append((10 * g + k, " ".join(ws + [f"z{g}{k}{j}" for j in range(2 * k + 9)])))
    check(spark, rows)


def test_empty(spark):
    assert N.grouped(documents(spark, [])).count() == 0
    assert N.grouped(documents(spark, [(1, None), (2, " ")])).where("kept").count() == 2


@pytest.mark.parametrize("percent,same", [(80, True), (81, False)])
def test_exact_boundary(percent, same):
    import numpy as np

    a, b = np.arange(0, 90, dtype=np.uint64), np.arange(10, 100, dtype=np.uint64)  # 80 of 100
    assert N.linked(a, b, percent) is same
