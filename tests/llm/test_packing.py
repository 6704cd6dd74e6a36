import zlib
from collections import defaultdict

import pytest
from tokenizers import Tokenizer

from quadloom.llm import packing
from quadloom.llm.common import vocabulary
from tests.llm.fixtures import ODD, documents, words

ROWS = [*ODD, *((100 + k, words(k, 1 + k * 37 % 900)) for k in range(60)), (300, words(300, 20_000))]


@pytest.mark.parametrize("capacity", [1024, 64, 1])
def test_pieces(spark, capacity):
    rows = ROWS if capacity > 1 else ROWS[:4] + ROWS[-20:-10]
    docs = documents(spark, rows)
    got = packing.packed(docs, capacity=capacity).collect()
    tok = Tokenizer.from_file(vocabulary())
    want = sorted([(i, [*tok.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows], key=repr)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert len(r["ids"]) == r["length"] > 0
    for i, ids in want:
        held = by_doc[i]
        if sum(x == i for x, _ in rows) > 1:
            continue
        back = []
        for r in sorted(held, key=lambda r: r["start"]):
            assert r["start"] == len(back) and r["doc_tokens"] == len(ids)
            back += r["ids"]
        assert back == ids
    assert sum(r["length"] for r in got) == sum(len(ids) for _, ids in want)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity and at & (at - 1) == 0  # nothing to pad
    digests = {(r["doc_id"], r["start"], r["sequence_id"], r["offset"]): r["ids_crc32"] for r in packing.packed_digests(docs, capacity=capacity).collect()}
    for r in got:
        assert digests[r["doc_id"], r["start"], r["sequence_id"], r["offset"]] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in r["ids"]))


def test_cuts():
    for n in range(1, 300):
        assert sum(packing.cuts(n, 64)) == n and all(c & (c - 1) == 0 for c in packing.cuts(n, 64))


def test_bins():
    """Any lengths: every id in one piece, full bins but for the last ones, few pieces a document."""
    import random

    r = random.Random(4)
    for lengths in ([r.randint(1, 900) for _ in range(2000)], [1] * 3000, [300, 5, 1, 700, 64], [64] * 9, []):
        bins, docs = packing.Bins(0, 256), [bytes(4 * n) for n in lengths]
        got = [p for k, d in enumerate(docs) for p in bins.add(k, d)]
        assert sum(len(v) <= 256 for v in bins.open.values()) <= 256
        got += bins.close()
        held, used = defaultdict(list), defaultdict(list)
        for doc, start, data, n, sequence, at in got:
            held[doc].append((start, len(data) // 4))
            used[sequence].append((at, len(data) // 4))
            assert n == lengths[doc] and data
        for doc, n in enumerate(lengths):
            assert sum(k for _, k in held[doc]) == n and all(a + k == b for (a, k), (b, _) in zip(sorted(held[doc]), sorted(held[doc])[1:], strict=False))
        full = [sum(k for _, k in v) for v in used.values()]
        assert all(n & (n - 1) == 0 and n <= 256 for n in full) and sum(n < 256 for n in full) <= 8
        assert all(a + k == b for v in used.values() for (a, k), (b, _) in zip(sorted(v), sorted(v)[1:], strict=False))
        if len(lengths) == 2000:
            assert len(got) < 2000 * (900 / 2 / 256 + 1.7)


def test_misuse_and_empty(spark):
    with pytest.raises(ValueError):
        packing.packed(documents(spark, []), capacity=1000)
    assert packing.packed(documents(spark, [])).count() == 0
