"""Byte-level BPE as a streaming transducer with bounded lookahead, and its inverse.

Method. Text is cut into pretokens by a pattern that needs at most three characters of lookahead; merges never cross a
pretoken. Inside a pretoken too long to hold, bytes pass a window: BPE of a prefix may differ from BPE of the whole only near
the prefix's end, because a merge at some rank is blocked from the right only by a merge of *smaller* rank that takes the
right edge of its right part. `sufficient_lookahead` walks the merge list in rank order and sums the longest such chain, so a
token that ends at least that many bytes before the end of the window is final and is emitted; the bytes before it are
forgotten. (A boundary of the final tokenization is crossed by no merge, so what follows can be tokenized by itself.)
Memory is the window, one slice of text and a cache of bounded size, whatever the length of the text.

Decoding is a byte-to-text state machine: each token's bytes go to an incremental UTF-8 decoder that holds at most three bytes
of an unfinished character; bytes that can't be text become U+FFFD one maximal subpart at a time.

Cases: null text counts as empty and gives no ids; a special token's string in a text is that token, as in the tokenizers
library's default; invalid UTF-8 is read with U+FFFD; repeated rows give repeated results; columns beyond the two named ones
are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quadloom.llm.common import ship, utf8, vocabulary

#: Characters a feed takes at once, and a piece's length from which it goes through the window.
SLICE, LONG = 1 << 16, 8192
#: Entries of a piece cache generation; two generations are kept.
CACHE = 300_000

_LATIN = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_²³¹¼½¾]+| ?[\d²³¹¼½¾]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_BEYOND_LATIN = re.compile("[\x1c-\x1fɐ-\U0010ffff]")
#: A space that surely starts a pretoken.
_BREAK = re.compile(r"(?<=\S) (?=\S)")
_SPACE_RUN = re.compile(r"[ \t-\r\x85\xa0]{2}|[ \t-\r\x85\xa0]$")


#: Letters and numbers of Unicode 16 that Python 3.13 doesn't know.
_UNICODE_16 = {
    "L": [(0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0)],
    "N": [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)],
}


@lru_cache(1)
def _classes() -> tuple[str, str]:
    """Letters and numbers as ranges, by this Python's Unicode tables, with what the tokenizers library has beyond them."""
    found = {"L": [], "N": []}
    for c in range(0x110000):
        if ranges := found.get(unicodedata.category(chr(c))[0]):
            if ranges[-1][1] == c - 1:
                ranges[-1][1] = c
                continue
        elif ranges is None:
            continue
        ranges.append([c, c])
    return tuple("".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in [*found[k], *_UNICODE_16[k]]) for k in "LN")


_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@lru_cache(1)
def _runs() -> list[re.Pattern]:
    """What may follow in a pretoken of letters, numbers, other characters or white space."""
    letters, numbers = _classes()
    return [re.compile(p) for p in (f"[{letters}]+", f"[{numbers}]+", f"[^{_WHITE}{letters}{numbers}]+", f"[{_WHITE}]+")]


@lru_cache(1)
def _wide() -> re.Pattern:
    letters, numbers, other, white = (r.pattern for r in _runs())
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?{letters}| ?{numbers}| ?{other}|{white}(?![^{_WHITE}])|{white}")


def pieces(text: str) -> list[str]:
    """The pretokens of a text."""
    return (_wide() if _BEYOND_LATIN.search(text) else _LATIN).findall(text)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeTable:
    """A vocabulary file of the tokenizers library, of kind byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path} isn't a byte-level BPE")
        stand_in, vocab = byte_alphabet(), spec["model"]["vocab"]
        self.bytes: dict[int, bytes] = {i: bytes(stand_in[c] for c in s) for s, i in vocab.items()}
        self.start = [0] * 256
        for s, i in vocab.items():
            if len(s) == 1:
                self.start[stand_in[s]] = i
        self.pairs: dict[int, tuple[int, int]] = {}
        self.rules: list[tuple[int, int, int]] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i, j, k = vocab[a], vocab[b], vocab[a + b]
            self.pairs[i << 20 | j] = (rank, k)
            self.rules.append((i, j, k))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self._lookahead: int | None = None
        self._prefixes()

    def merge(self, data: bytes) -> list[int]:
        """BPE of one short pretoken, merge by merge."""
        ids = [self.start[b] for b in data]
        pairs = self.pairs.get
        while len(ids) > 1:
            best, at, new, left = 1 << 30, -1, 0, ids[0]
            for i in range(1, len(ids)):
                right = ids[i]
                if (p := pairs(left << 20 | right)) is not None and p[0] < best:
                    best, new = p
                    at = i
                left = right
            if at < 0:
                break
            ids[at - 1 : at + 1] = [new]
        return ids

    def _prefixes(self) -> None:
        """For each token its longest proper prefix that is a token, and for each four first bytes the lengths of longer tokens."""
        self.ids = {t: i for i, t in self.bytes.items() if i not in set(self.special.values())}
        lengths: dict[bytes, set[int]] = {}
        self.shorter: dict[int, int] = {}
        for t, i in self.ids.items():
            if len(t) > 4:
                lengths.setdefault(t[:4], set()).add(len(t))
            self.shorter[i] = next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1)
        self.lengths = {k: sorted(v, reverse=True) for k, v in lengths.items()}
        self.fits: dict[int, bool] = {}

    def _fit(self, a: int, b: int) -> bool:
        """Do two tokens stay apart when their bytes stand side by side?"""
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[a << 20 | b] = ok = self.merge(self.bytes[a] + self.bytes[b]) == [a, b]
        return ok

    def tokens(self, data: bytes) -> list[int]:
        """As merge(), in time about linear: the tokenization is the one sequence of tokens of which any two neighbours stay apart."""
        ids, lengths, n, fits, dead = self.ids.get, self.lengths.get, len(data), self.fits.get, set()
        shorter, sizes = self.shorter, self.bytes
        out: list[int] = []
        i = 0
        while i < n:
            head = data[i : i + 4]
            for size in lengths(head, ()):
                if i + size <= n and (t := ids(data[i : i + size])) is not None:
                    break
            else:
                size = len(head)
                while (t := ids(head)) is None:
                    size -= 1
                    head = head[:size]
            j = i + size
            while True:
                if j not in dead:
                    ok = True
                    if out and (ok := fits(out[-1] << 20 | t)) is None:
                        ok = self._fit(out[-1], t)
                else:
                    ok = False
                if ok:
                    out.append(t)
                    i = j
                    break
                if (t := shorter[t]) < 0:
                    dead.add(i)
                    t = out.pop()
                    j = i
                    i -= len(sizes[t])
                    continue
                j = i + len(sizes[t])
        return out

    def sufficient_lookahead(self) -> int:
        """Bytes after a token's end that decide whether it is final.

        reach(r), for rule r = (a, b): how far beyond the start of b the text can decide whether r fires there. It is b's length,
        or more if some right edge x of b can be taken away by an earlier rule (x, y) before b has absorbed it.
        """
        if self._lookahead is None:
            made = {k: (rank, j) for rank, (_, j, k) in enumerate(self.rules)}
            by_left: dict[int, tuple[list[int], list[int]]] = {}  # ranks, and the largest reach up to each
            most = 0
            for rank, (a, b, _) in enumerate(self.rules):
                reach, x, until = len(self.bytes[b]), b, rank
                size = reach
                while True:
                    ranks, best = by_left.get(x, ((), ()))
                    if i := bisect_left(ranks, until):
                        reach = max(reach, size + best[i - 1])
                    if x not in made:
                        break
                    until, x = made[x]
                    until = min(until, rank)
                ranks, best = by_left.setdefault(a, ([], []))
                ranks.append(rank)
                best.append(max(reach, best[-1] if best else 0))
                most = max(most, reach)
            self._lookahead = most + max(map(len, self.bytes.values()))
        return self._lookahead


@lru_cache(4)
def table(path: str) -> MergeTable:
    return MergeTable(path)


class _Cache(dict):
    """Text unit -> its ids as packed unsigned 32-bit numbers; two generations, so that its size is bounded."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, unit):
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        if (ids := self.old.get(unit)) is None:
            ids = self.make(unit)
        self[unit] = ids
        return ids


class Window:
    """The bounded-lookahead transducer for one pretoken of any length."""

    def __init__(self, merges: MergeTable, chunk: int = 2048):
        self.merges, self.chunk, self.ahead, self.held = merges, chunk, merges.sufficient_lookahead(), b""

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        for i in range(0, len(data), self.chunk):
            self.held += data[i : i + self.chunk]
            if len(self.held) < self.ahead + self.chunk:
                continue
            end, stable = 0, len(self.held) - self.ahead
            for t in self.merges.tokens(self.held):
                if end + len(self.merges.bytes[t]) > stable:
                    break
                end += len(self.merges.bytes[t])
                out.append(t)
            self.held = self.held[end:]
        return out

    def finish(self) -> list[int]:
        out, self.held = self.merges.tokens(self.held) if self.held else [], b""
        return out


class Encoder:
    """feed() text in slices of any size, then finish(); both return ids that are final, packed as unsigned 32-bit numbers."""

    def __init__(self, merges: MergeTable, outside=None, outside_piece=None):
        """outside, outside_piece: another implementation of the same merges, for short units and pretokens not seen before."""
        self.merges, self.held, self.window, self.run = merges, "", None, None
        self.piece = _Cache(lambda s: array("I", merges.tokens(s.encode())).tobytes())
        #: What stands between two single spaces, the first of them counted in: a space before a non-space always starts a pretoken.
        self.unit = _Cache(lambda s: b"".join(map(self.piece.__getitem__, pieces(" " + s))))
        if outside:
            self.piece = _Cache(lambda s: array("I", outside_piece(s.encode()) if len(s) < 64 else merges.tokens(s.encode())).tobytes())
            self.unit = _Cache(lambda s: array("I", outside(" " + s)).tobytes())
        self.stop = re.compile("|".join(map(re.escape, merges.special))) if merges.special else None
        self.longest = max(map(len, merges.special), default=1)

    def _whole(self, text: str) -> bytes:
        """A text, or a part of one that starts and ends between pretokens."""
        if _SPACE_RUN.search(text):
            return b"".join(map(self.piece.__getitem__, pieces(text)))
        first, *rest = text.split(" ")
        return (b"".join(map(self.piece.__getitem__, pieces(first))) if first else b"") + b"".join(map(self.unit.__getitem__, rest))

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a whole text, slice by slice."""
        at = 0
        if not (self.stop and self.stop.search(text)):
            while len(text) - at > LONG and (m := _BREAK.search(text, at + LONG - 512, at + 2 * LONG)):
                yield self._whole(text[at : m.start()])
                at = m.start()
            if len(text) - at <= LONG:
                yield self._whole(text[at:])
                return
        for i in range(at, len(text), SLICE):
            yield self.feed(text[i : i + SLICE])
        yield self.finish()

    def feed(self, text: str) -> bytes:
        self.held += text
        out = []
        while self.stop and (m := self.stop.search(self.held)):
            rest = self.held[m.end() :]
            self.held = self.held[: m.start()]
            out += [self._advance(True), array("I", [self.merges.special[m[0]]]).tobytes()]
            self.held = rest
        out.append(self._advance(False))
        return b"".join(out)

    def finish(self) -> bytes:
        return self._advance(True)

    def _tail(self) -> int:
        """Characters at the end that may start a special token."""
        if self.stop:
            for n in range(min(self.longest - 1, len(self.held)), 0, -1):
                if any(s.startswith(self.held[-n:]) for s in self.merges.special):
                    return n
        return 0

    def _advance(self, last: bool) -> bytes:
        out, keep = [], 0 if last else self._tail()
        text, tail = (self.held[: len(self.held) - keep], self.held[len(self.held) - keep :]) if keep else (self.held, "")
        if self.window:
            m = self.run.match(text) if text else None
            end = m.end() if m else 0
            if end == len(text) and not last:
                cut = max(0, end - 1)
                out.append(array("I", self.window.feed(text[:cut].encode())).tobytes())
                self.held = text[cut:] + tail
                return b"".join(out)
            if end < len(text) and end and self.run is _runs()[3]:
                end -= 1  # the last white space goes with what follows, or stands alone
            out.append(array("I", self.window.feed(text[:end].encode()) + self.window.finish()).tobytes())
            text, self.window = text[end:], None
        found = pieces(text)
        back = 0
        while not last and found and back < 3:
            back += len(found.pop())
        out.append(b"".join(map(self.piece.__getitem__, found)))
        rest = text[len(text) - back :]
        if not last and len(rest) > LONG:
            for run in _runs():
                if (m := run.match(rest, int(rest[0] == " " and run is not _runs()[3]))) and m.end() == len(rest):
                    self.run, self.window = run, Window(self.merges)
                    out.append(array("I", self.window.feed(rest[:-1].encode())).tobytes())
                    rest = rest[-1:]
                    break
        self.held = rest + tail
        return b"".join(out)


class Decoder:
    """feed() ids, then finish(); both return text."""

    def __init__(self, merges: MergeTable):
        self.bytes = [merges.bytes.get(i, b"") for i in range(max(merges.bytes) + 1)]
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        return self.state.decode(b"".join(map(self.bytes.__getitem__, ids)))

    def finish(self) -> str:
        text = self.state.decode(b"", True)
        self.state.reset()
        return text


@lru_cache(2)
def coder(path: str) -> tuple[Encoder, Decoder, list[bytes]]:
    merges = table(path)
    return Encoder(merges), Decoder(merges), [b"%d" % i for i in range(max(merges.bytes) + 1)]


@lru_cache(2)
def library_coder(path: str) -> Encoder:
    """As coder()'s encoder, with tiktoken's compiled merges for unseen units where ranks and ids go in the same order; the ids are the same."""
    import public_tokenizers
    import tiktoken

    merges = table(path)
    made = [k for _, _, k in merges.rules]
    if made != sorted(made):
        return Encoder(merges)
    ranks = {b: i for i, b in merges.bytes.items() if i not in set(merges.special.values())}
    library = tiktoken.Encoding("same", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return Encoder(merges, library.encode_ordinary, library._encode_single_piece)


def encoded(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>): the token ids of each whole text."""
    path = path or vocabulary()
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches):
        import pyarrow as pa

        enc = coder(path)[0]
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = [list(array("I", b"".join(enc.encode(str(t, "utf-8", "replace"))))) for t in utf8(part.column(1))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)


def decoded(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(id, text) of (id, ids array<int>); null or unknown ids decode to nothing."""
    path = path or vocabulary()
    ship(tokens.sparkSession)
    schema = T.StructType([T.StructField("id", tokens.schema["id"].dataType), T.StructField("text", T.StringType())])

    def run(batches):
        import pyarrow as pa

        dec = coder(path)[1]
        for b in batches:
            texts = []
            for ids in b.column(1).to_pylist():
                text = [dec.feed([i for i in (ids or [])[k : k + SLICE] if i is not None and 0 <= i < len(dec.bytes)]) for k in range(0, len(ids or []), SLICE)]
                texts.append("".join(text) + dec.finish())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return tokens.select("id", "ids").mapInArrow(run, schema)


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, n_tokens, and digests of its ids and of the text decoded from them; no row's ids are held beyond a slice."""
    path = path or vocabulary()
    ship(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def run(batches):
        import pyarrow as pa

        enc, dec, decimal = coder(path)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                counts, of_ids, of_text = [], [], []
                for raw in utf8(part.column(1)):
                    n, sha, back = 0, hashlib.sha256(), hashlib.sha256()
                    for packed in enc.encode(str(raw, "utf-8", "replace")):
                        if packed:
                            ids = array("I", packed)
                            sha.update((b"," if n else b"") + b",".join(map(decimal.__getitem__, ids)))
                            back.update(dec.feed(ids).encode())
                            n += len(ids)
                    back.update(dec.finish().encode())
                    counts.append(n)
                    of_ids.append(sha.hexdigest())
                    of_text.append(back.hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_text)], names=schema.names)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
