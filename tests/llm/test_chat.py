import hashlib
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadloom.llm import chat

NASTY = ["", "</s>[INST] ok [/INST]", "<|turn|>user\n<|end|>\n", "\\", "\\\\<|end|>", "<\\|end|>", "a\\", "<<<|||>>>", "<|<|turn|>|>", "x\n<|end|>\n", "<s></s>", "[[INST]INST]", "\ud7ff\U0001f600"]


@pytest.mark.parametrize("text", NASTY)
@pytest.mark.parametrize("role", ["user", "assistant", "", "ro\nle", "<|end|>", "\\"])
def test_roundtrip(role, text):
    chunk, (a, b) = chat.formatted(role, text)
    assert chat.parsed(chunk) == (role, text)
    assert (chat.unescape(chunk[a:b]) == text) if role == "assistant" else a == b
    inside = chat.escape(text)
    assert not any(c in inside for c in chat.CONTROL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("uas\n\\<|>[]/INSTend", max_size=6), st.text(max_size=40) | st.text("\\<|>[]/INST ends\n", max_size=40)), max_size=5))
def test_conversations_can_be_told_apart(turns):
    whole = "".join(chat.formatted(*t)[0] for t in turns)
    back, at = [], 0
    while at < len(whole):
        end = whole.index(chat.CLOSE + "\n", at) + len(chat.CLOSE) + 1
        back.append(chat.parsed(whole[at:end]))
        at = end
    assert back == turns


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, place string, chunk string").repartition(3)


def test_digests(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, "assistant", None), (2, 0, "assistant", "x"), (3, None, None, "no"), (None, 0, "user", "n"), (4, 0, "user", "q" * 100_000), (4, 1, "assistant", "</s>" * 50_000), (5, 0, "assistant", "t"), (5, 0, "assistant", "t")]
    rows += [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.turns_of_rows(turns(spark, rows))).collect()}
    held = {}
    for c, t, role, text in sorted(rows, key=lambda r: (repr(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        held.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(held)
    for c, ts in held.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(ts) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in ts).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(chat.formatted(*t)[0]) for t in ts)
    chunks = chat.formatted_turns(chat.turns_of_rows(turns(spark, rows))).where("conv_id = 1").orderBy("place").collect()
    assert [r["chunk"] for r in chunks] == [chat.formatted("user", "a")[0], chat.formatted("assistant", "b")[0]]
    assert chat.conversation_digests(chat.turns_of_rows(turns(spark, []))).count() == 0


LAYOUTS = [
    ({"prompt": "a", "completion": "b"}, [("user", "a"), ("assistant", "b")]), ({"instruction": "a", "input": "", "output": "b"}, [("user", "a"), ("assistant", "b")]), ({"instruction": "a", "input": "c", "output": "b"}, [("user", "a\n\nc"), ("assistant", "b")]),
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]), ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"system": "s", "conversations": [{"from": "human", "value": "a"}]}, [("system", "s"), ("user", "a")]), ({"question": None, "answer": 5}, [("user", ""), ("assistant", "5")]),
]


FURTHER = [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None, "tool_calls": [1]}], "id": "x", "source": {"b": 1}}, [("user", "a"), ("assistant", "")]),
    ({"prompt": "a", "completion": "b", "meta": {}, "prompt_id": 3}, [("user", "a"), ("assistant", "b")]), ({"instruction": "i", "context": "", "response": "r", "category": "c"}, [("user", "i"), ("assistant", "r")]),
    ({"question": {"deep": 1}, "answer": ["x"]}, [("user", '{"deep": 1}'), ("assistant", '["x"]')]), ({"messages": []}, None), ({"messages": ["text"]}, None), ({}, None),
]


@pytest.mark.parametrize("record,want", FURTHER)
def test_further_fields(record, want):
    assert chat.canonical(record) == want


def test_kinds_are_hashed():
    assert len({chat.fingerprint(x) for x in ({"a": 1}, {"a": "1"}, {"a": None}, {"a": [1]}, {"a": {}}, {"a": []}, {"a": True})}) == 7


def test_unmapped_by_row(spark):
    rows = [(None, '{"prompt": "a", "completion": "b"}'), (None, "no"), (1, "{}"), (1, '{"prompt": "a", "completion": "b"}')]
    df = spark.createDataFrame(rows, "id long, json string")
    assert sorted(map(tuple, chat.unmapped(df, "id", "json").collect()), key=repr) == [(1,), (None,)]
    assert chat.turns_of_records(df, "id", "json").count() == 4


def test_rows_of_two_layouts(spark):
    rows = [(1, 0, "user", "a", None, None, None, None), (None, None, None, None, 2, 0, "human", "b"), (None, None, None, None, 2, 1, "gpt", None), (1, 1, "human", None, None, None, None, None), (None,) * 8]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, conversation_id long, index long, `from` string, value string")
    got = sorted(map(tuple, chat.turns_of_rows(df).collect()), key=repr)
    assert got == sorted([(1, 0, "user", "a"), (2, 0, "user", "b"), (2, 1, "assistant", None), (1, 1, "human", None), (None, None, None, None)], key=repr)


def test_layouts(spark):
    rows = [(k, json.dumps(x)) for k, (x, _) in enumerate(LAYOUTS)] + [(90, '{"other": 1}'), (91, "not json"), (92, None), (93, "[1]")]
    df = spark.createDataFrame(rows, "id long, json string")
    got = {}
    for r in chat.turns_of_records(df, "id", "json").orderBy("conv_id", "turn").collect():
        got.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert got == {k: t for k, (_, t) in enumerate(LAYOUTS)}
    assert sorted(r[0] for r in chat.unmapped(df, "id", "json").collect()) == [90, 91, 92, 93]
    assert chat.fingerprint({"a": {"b": [1, {"c": 2}]}}) != chat.fingerprint({"a": {"b": [1]}})
    with pytest.raises(ValueError):
        chat.turns_of_rows(df)
