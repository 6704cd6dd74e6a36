"""Chat formatting by schema fingerprints.

Method. Records come in many layouts. The fingerprint of a record is a hash of its sorted nested field paths with the kinds of their values (arrays
as []), and selects a declarative mapping: which paths hold prompt, instruction, input, answer, or which array holds messages and under
which names. A fingerprint that is met first is resolved once: of the mappings whose paths it has, the one that needs most; further fields are
allowed. In tables of one row a turn each row is a record: the fingerprint of its filled columns selects the mapping in the plan, so that one table
may hold several layouts. Mappings turn any layout into canonical turns (conv_id, turn, role, text), and turns into one template:

    <|turn|>role\\n text <|end|>\\n

Reversible escapes: inside role and text a backslash is doubled and every control string gets a backslash after its first
character, so that no control string is left; in a role a line break gets one too. Taking a backslash away before any character
gives the text back. The loss mask covers the (escaped) text of assistant turns.

Turns of a conversation are brought together by a hash of its key and sorted inside the partition; each is formatted, and read
back, as it streams past, so that a conversation of any length needs the memory of one turn (and of its running digests).

Cases: null text, role or turn counts as empty text, empty role, first; ties of turn are ordered by role, then text; repeated rows
are turns of their own; a null conversation key is one conversation; an empty table gives an empty result; further columns are
ignored. A record whose paths no mapping finds, or that isn't a JSON object, gives no turns and is
returned by `unmapped`, by row, whatever its id; one with an empty array of messages has no turns to give and is returned too.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import ship

OPEN, CLOSE, TRAINED = "<|turn|>", "<|end|>", "assistant"
#: What templates in public use give a meaning; ours among them.
CONTROL = (OPEN, CLOSE, "<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>", "<unk>")
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.S)
_BODY = re.compile(r"<\|turn\|>((?:\\.|[^\\\n])*)\n(.*)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    while True:  # control strings may overlap: until none is left
        out = _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)
        if out == text:
            return out
        text = out


def control_pattern() -> str:
    """CONTROL as a pattern of two groups for SQL: the first character and the others, the longest first."""
    first = "".join(sorted({re.escape(c[0]) for c in CONTROL}))
    return f"([{first}])({'|'.join(re.escape(c[1:]) for c in sorted(CONTROL, key=len, reverse=True))})"


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, tuple[int, int]]:
    """One turn in the template, and the span in it that the loss covers (empty unless the role is trained)."""
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + CLOSE + "\n", (len(head), len(head) + len(body) * (role == TRAINED))


def parsed(turn: str) -> tuple[str, str]:
    """Role and text, from the template."""
    m = _BODY.fullmatch(turn)
    if not m:
        raise ValueError("not a turn of the template")
    return unescape(m[1]), unescape(m[2])


# Layouts

ROLES = {"human": "user", "user": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "assistant": "assistant", "chatgpt": "assistant", "system": "system"}


def paths(value, at: str = "") -> set[str]:
    """Nested field paths of a JSON value, each with the kind of its value; arrays count as one step."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}") for k, v in value.items())) if value else {at + ":{}"}
    if isinstance(value, list):
        return set().union(*(paths(v, at + "[]") for v in value)) if value else {at + "[]:"}
    return {f"{at}:{'null' if value is None else type(value).__name__}"}


def fingerprint(value) -> str:
    return hashlib.sha256("\n".join(sorted(paths(value))).encode()).hexdigest()[:16]


#: Mappings: {turns: [(role, fields joined by a blank line)]}, {each: array, role, text} with a first turn or none, or {rows: columns}.
REGISTRY: list[dict] = [
    {"turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"turns": [("user", ["question"]), ("assistant", ["answer"])]},
    {"turns": [("system", ["system"]), ("user", ["question"]), ("assistant", ["response"])]},
    {"turns": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"turns": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    {"turns": [("user", ["instruction", "context"]), ("assistant", ["response"])]},
    {"each": "messages", "role": "role", "text": "content"},
    {"each": "messages", "role": "role", "text": "text"},
    {"each": "conversations", "role": "from", "text": "value"},
    {"first": ("system", "system"), "each": "conversations", "role": "from", "text": "value"},
    #: Tables of one row a turn, by their columns: conversation, turn, role, text.
    {"rows": ("conv_id", "turn", "role", "text")},
    {"rows": ("conversation_id", "index", "from", "value")},
]


def needs(mapping: dict) -> frozenset[str]:
    """The field paths without which a mapping can't be used."""
    if "turns" in mapping:
        return frozenset(f".{f}" for _, fields in mapping["turns"] for f in fields)
    first = {f".{mapping['first'][1]}"} if "first" in mapping else set()
    return frozenset(first | {f".{mapping['each']}[].{mapping[k]}" for k in ("role", "text")})


class Mappings:
    """fingerprint -> mapping, resolved when a fingerprint is met first; the number kept is bounded."""

    def __init__(self, registry: list[dict] | None = None):
        known = [m for m in (REGISTRY if registry is None else registry) if "rows" not in m]
        self.known = sorted(((needs(m), m) for m in known), key=lambda x: -len(x[0]))
        self.held: dict[str, dict | None] = {}

    def of(self, record: dict) -> dict | None:
        key = fingerprint(record)
        if key not in self.held:
            if len(self.held) >= 10_000:
                self.held.clear()
            there = {p.rsplit(":", 1)[0] for p in paths(record)}
            self.held[key] = next((m for need, m in self.known if all(any(p == n or p.startswith((f"{n}.", f"{n}[")) for p in there) for n in need)), None)
        return self.held[key]


def canonical(record, mappings: Mappings | None = None) -> list[tuple[str, str]] | None:
    """Turns of one record, or None if no mapping fits it."""
    mapping = (mappings or Mappings()).of(record) if isinstance(record, dict) else None
    if mapping is None:
        return None
    said = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if "turns" in mapping:
        return [(role, "\n\n".join(filter(None, (said(record[p]) for p in names)))) for role, names in mapping["turns"]]
    first = [(mapping["first"][0], said(record[mapping["first"][1]]))] if "first" in mapping else []
    name = lambda m: said(m.get(mapping["role"]))
    return first + [(ROLES.get(name(m).lower(), name(m)), said(m.get(mapping["text"]))) for m in record[mapping["each"]] if isinstance(m, dict)]


def _record(line: bytes):
    try:
        return json.loads(line)
    except ValueError:
        return None


def turns_of_records(records: DataFrame, id_col: str, json_col: str, registry: list[dict] | None = None) -> DataFrame:
    """(conv_id, turn, role, text) of JSON records in any layout that the registry knows."""
    return _told(records, id_col, json_col, registry, True)


def unmapped(records: DataFrame, id_col: str, json_col: str, registry: list[dict] | None = None) -> DataFrame:
    """conv_id of each row that gives no turns."""
    return _told(records, id_col, json_col, registry, False).select("conv_id")


def _told(records, id_col, json_col, registry, found: bool) -> DataFrame:
    ship(records.sparkSession)
    schema = T.StructType([T.StructField("conv_id", records.schema[id_col].dataType), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches):
        import pyarrow as pa

        from quadloom.llm.common import utf8

        mappings = Mappings(registry)
        for b in batches:
            rows = []
            for i, line in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                turns = canonical(_record(line), mappings)
                if found:
                    rows += [(i, k, role, text) for k, (role, text) in enumerate(turns or [])]
                elif not turns:
                    rows.append((i, None, None, None))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [b.schema.field(0).type, pa.int64(), pa.string(), pa.string()], strict=True)], names=schema.names)

    return records.select(records[id_col].alias("id"), records[json_col].alias("json")).mapInArrow(run, schema)


def turns_of_rows(rows: DataFrame, registry: list[dict] | None = None) -> DataFrame:
    """(conv_id, turn, role, text) of a table of one row a turn, which may hold rows of several layouts.

    A row's fingerprint, the hash of the paths of its filled columns, selects the mapping with most of its own columns filled; of
    equal ones the first, which also takes rows without any.
    """
    known = [m["rows"] for m in (REGISTRY if registry is None else registry) if "rows" in m and set(m["rows"]) <= set(rows.columns)]
    if not known:
        raise ValueError(f"no mapping knows a table of {rows.columns}")
    fields = sorted({c for m in known for c in m})
    hashed = lambda there: hashlib.sha256("\n".join(there).encode()).hexdigest()
    every = [[c for k, c in enumerate(fields) if bits >> k & 1] for bits in range(1 << len(fields))]
    choice = {hashed(there): max(range(len(known)), key=lambda m: (len(set(known[m]) & set(there)), -m)) for there in every}
    print_ = F.sha2(F.concat_ws("\n", *(F.when(rows[c].isNotNull(), F.lit(c)) for c in fields)), 256)
    chosen = F.create_map(*(F.lit(x) for pair in choice.items() for x in pair))[print_] if len(known) > 1 else F.lit(0)

    def of(at, kind=None):
        columns = [rows[m[at]] if kind is None else rows[m[at]].cast(kind) for m in known]
        return F.coalesce(*(F.when(chosen == k, c) for k, c in enumerate(columns)))

    role = of(2, "string")
    named = F.coalesce(F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))[F.lower(role)], role)
    foreign = F.lit(False) if known[0][2] == "role" and len(known) == 1 else F.element_at(F.array(*(F.lit(m[2] != "role") for m in known)), chosen + 1)
    return rows.select(of(0).alias("conv_id"), of(1, "long").alias("turn"), F.when(foreign, named).otherwise(role).alias("role"), of(3, "string").alias("text"))


# Formatting


def _in_order(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _streamed(batches) -> Iterator[tuple]:
    for b in batches:
        for i in range(0, b.num_rows, 512):
            yield from zip(*(c.to_pylist() for c in b.slice(i, 512).columns), strict=True)


def formatted_turns(turns: DataFrame) -> DataFrame:
    """Per turn: conv_id, place, chunk (its part of the formatted conversation), loss_start, loss_end (a span of the chunk)."""
    ship(turns.sparkSession)
    long = T.LongType()
    schema = T.StructType([turns.schema["conv_id"], T.StructField("place", long), T.StructField("chunk", T.StringType()), T.StructField("loss_start", long), T.StructField("loss_end", long)])

    def run(batches):
        import pyarrow as pa

        last, place = object(), 0
        for b in batches:
            rows = []
            for conv, _, role, text in _streamed([b]):
                last, place = (last, place + 1) if conv == last else (conv, 0)
                chunk, (start, end) = formatted(role, text)
                rows.append((conv, place, chunk, start, end))
            types = [b.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 5, types, strict=True)], names=schema.names)

    return _in_order(turns).mapInArrow(run, schema)


def conversation_digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from the formatted chunks: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    ship(turns.sparkSession)
    long, text_type = T.LongType(), T.StringType()
    schema = T.StructType([turns.schema["conv_id"], T.StructField("n_turns", long), T.StructField("turns_sha256", text_type), T.StructField("loss_chars", long), T.StructField("loss_sha256", text_type), T.StructField("formatted_chars", long)])

    def run(batches):
        import pyarrow as pa

        kind, done, now, at = None, [], None, object()

        def batch():
            out = [(c, n, a.hexdigest(), k, b.hexdigest(), m) for c, n, a, k, b, m in done]
            done.clear()
            types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=schema.names)

        for b in batches:
            kind = b.schema.field(0).type
            for conv, _, role, text in _streamed([b]):
                if now is None or conv != at:
                    at, now = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    done.append(now)
                    if len(done) > 4096:
                        done.pop()
                        yield batch()
                        done.append(now)
                chunk, (start, end) = formatted(role, text)
                role_back, text_back = parsed(chunk)
                masked = unescape(chunk[start:end])
                now[1] += 1
                now[2].update(f"{role_back}\n{text_back}\n".encode())
                now[3] += len(masked)
                now[4].update(masked.encode())
                now[5] += len(chunk)
        if done:
            yield batch()

    return _in_order(turns).mapInArrow(run, schema)
