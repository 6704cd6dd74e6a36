import hashlib
import random
from array import array

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quadloom.llm import bpe
from quadloom.llm.common import vocabulary
from tests.llm.fixtures import ODD, documents, words

TOK = Tokenizer.from_file(vocabulary())
R = random.Random(4)
TEXTS = [
    *(t for _, t in ODD if t), "", "a", " ", "  a  b   c", "don't we'll I'M", "tabs\t\t and\r\n\n lines ", "1234567 1,234.5", "\u00bd\u00b2 x\u00aay", "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0", "e\u0301\u200d\U0001f468\u200d\U0001f469", "a\u3000b\u2003c", "<|endoftext|>x<|endoftext|>", "<|endoftext",
    "!" * 30_000, " " * 20_001 + "x", "ab" * 30_000, "\u00e9" * 20_000, "1" * 25_000, "\n" * 20_000, words(1, 8000), "".join(chr(R.choice([R.randrange(32, 127), R.randrange(0xA0, 0x3000), R.randrange(0x1F300, 0x1F700)])) for _ in range(5000)), "x" * 8191 + " " + "y" * 8193, "aaaa" * 9000 + "b" + " " * 9000,
]


@pytest.mark.parametrize("k", range(len(TEXTS)))
def test_as_the_library(k):
    enc, dec, _ = bpe.coder(vocabulary())
    want = TOK.encode(TEXTS[k], add_special_tokens=False).ids
    ids = list(array("I", b"".join(enc.encode(TEXTS[k]))))
    assert ids == want
    assert dec.feed(ids) + dec.finish() == TOK.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("k", [1, 3, 7, 1000])
def test_slices_of_any_size(k):
    enc = bpe.Encoder(bpe.table(vocabulary()))
    for text in TEXTS:
        if len(text) > 3000 * k:
            continue
        out = b"".join(enc.feed(text[i : i + k]) for i in range(0, len(text), k)) + enc.finish()
        assert list(array("I", out)) == TOK.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text("ab '\u2019st\n\t 1\u00e9", max_size=40))
def test_random(text):
    for make in (lambda p: bpe.coder(p)[0], bpe.library_coder):
        assert list(array("I", b"".join(make(vocabulary()).encode(text)))) == TOK.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=30))
def test_decode_any_ids(ids):
    _, dec, _ = bpe.coder(vocabulary())
    assert "".join([dec.feed([i]) for i in ids]) + dec.finish() == TOK.decode(ids, skip_special_tokens=False)


def test_window_holds_little():
    merges = bpe.table(vocabulary())
    w = bpe.Window(merges)
    held = 0
    for _ in range(200):
        w.feed(b"abcdefgh" * 512)
        held = max(held, len(w.held))
    assert held <= merges.sufficient_lookahead() + 2 * w.chunk


def test_merge_and_tokens_agree():
    merges = bpe.table(vocabulary())
    for _ in range(500):
        data = bytes(R.choice(b"abcdeing tho") for _ in range(R.randrange(1, 40)))
        assert merges.merge(data) == merges.tokens(data)


def test_digests_and_roundtrip(spark):
    docs = documents(spark, ODD)
    got = sorted(((r["doc_id"], tuple(r)[1:]) for r in bpe.digests(docs).collect()), key=repr)
    want = []
    for i, t in ODD:
        ids = TOK.encode(t or "", add_special_tokens=False).ids
        want.append((i, (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(TOK.decode(ids, skip_special_tokens=False).encode()).hexdigest())))
    assert got == sorted(want, key=repr)
    back = sorted(((r["id"], r["text"]) for r in bpe.decoded(bpe.encoded(docs)).collect()), key=repr)
    assert back == sorted(((i, t or "") for i, t in ODD), key=repr)
    assert bpe.digests(documents(spark, [])).count() == 0
    odd = spark.createDataFrame([(1, [None, -1, 10**6, 31373]), (2, None)], "id long, ids array<int>")
    assert sorted(tuple(r) for r in bpe.decoded(odd).collect()) == [(1, "hello"), (2, "")]
