"""Packing token sequences by the harmonic method.

Method. Of a document, whole capacities are sequences of their own; the rest, its tail of t ids, falls in the reciprocal-capacity class
k = capacity // t, lengths in (capacity / (k + 1), capacity / k]. A bin of class k takes k tails, a count fixed beforehand, and each worker
fills the bins of its own rows: no row moves. What a full bin leaves open (less than a tail) is filled from the start of the documents that
follow, since documents may be cut freely, so a full bin has no padding and a document has a piece per capacity, a tail, and now and then
a filler. When a worker ends, the tails in its open bins are laid end to end and cut into sequences, the last ones of lengths that are
powers of two (for a capacity that is one), which are not padded. So padding is zero at any size and for any number of workers.

Memory per worker: one document's ids and the open bins: of class k fewer than k tails, that is less than the capacity for each class met.

Cases: null text counts as empty and gives the closing id alone; repeated rows are packed once each; an empty table gives an
empty result; columns beyond the two named ones are ignored. sequence_id is the task's number times 2**40 plus a counter; a task
run again after a loss gives the same rows as long as its input partition does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quadloom.llm.bpe import library_coder
from quadloom.llm.common import ship, utf8, vocabulary

CAPACITY = 1024


def cuts(n: int, capacity: int) -> Iterator[int]:
    """Lengths of the pieces of n ids: whole capacities, then falling powers of two."""
    for _ in range(n // capacity):
        yield capacity
    size, n = capacity >> 1, n % capacity
    while n:
        if n >= size:
            yield size
            n -= size
        size >>= 1


class Bins:
    """Open bins of one worker. add(), which takes a document's name and its ids as 4 bytes each, and close() give (document, start, ids, number of the
    document's ids, sequence, offset) of pieces once their bin is settled."""

    def __init__(self, first: int, capacity: int):
        self.next, self.capacity = first, capacity
        self.open: dict[int, list[tuple]] = {}
        self.short: list[tuple] = []  # a bin with its count of tails and still a gap
        self.gap = 0

    def _settle(self, pieces: list[tuple]) -> Iterator[tuple]:
        at = 0
        for doc, start, data, n in pieces:
            yield doc, start, data, n, self.next, at
            at += len(data) // 4
        self.next += 1

    def add(self, doc, data: bytes) -> Iterator[tuple]:
        n, start, capacity = len(data) // 4, 0, self.capacity
        if self.gap:
            start = min(n, self.gap)
            self.short.append((doc, 0, data[: 4 * start], n))
            self.gap -= start
            if not self.gap:
                yield from self._settle(self.short)
        while n - start >= capacity:
            yield from self._settle([(doc, start, data[4 * start : 4 * (start + capacity)], n)])
            start += capacity
        if start < n:
            k = capacity // (n - start)
            held = self.open.setdefault(k, [])
            held.append((doc, start, data[4 * start :], n))
            if len(held) == k:
                del self.open[k]
                if gap := capacity - sum(len(p[2]) // 4 for p in held):
                    self.short, self.gap = held, gap  # no other is short: this document was longer than the last gap
                else:
                    yield from self._settle(held)

    def close(self) -> Iterator[tuple]:
        left = [*(self.short if self.gap else ()), *(p for k in sorted(self.open) for p in self.open[k])]
        total, now = sum(len(p[2]) // 4 for p in left), []
        self.open, self.gap, room = {}, 0, cuts(total, self.capacity)
        free = next(room, 0)
        for doc, start, data, n in left:
            while data:
                part, data = data[: 4 * free], data[4 * free :]
                now.append((doc, start, part, n))
                start, free = start + len(part) // 4, free - len(part) // 4
                if not free:
                    yield from self._settle(now)
                    now, free = [], next(room, 0)


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, start, length, ids (array), doc_tokens, sequence_id, offset."""
    return _pieces(docs, path, capacity, end_id, id_col, text_col, True)


def packed_digests(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As packed(), with the CRC-32 of the ids (unsigned, little-endian, 32 bits each) in their stead."""
    return _pieces(docs, path, capacity, end_id, id_col, text_col, False)


def _pieces(docs, path, capacity, end_id, id_col, text_col, whole):
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    path = path or vocabulary()
    ship(docs.sparkSession)
    long = T.LongType()
    ids_field = T.StructField("ids", T.ArrayType(T.IntegerType(), False)) if whole else T.StructField("ids_crc32", long)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("start", long), T.StructField("length", long), ids_field, T.StructField("doc_tokens", long), T.StructField("sequence_id", long), T.StructField("offset", long)])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        enc, end = library_coder(path), np.array([end_id], "<u4").tobytes()
        bins, id_type = Bins(TaskContext.get().partitionId() << 40, capacity), None

        def batch(rows):
            columns = list(zip(*rows, strict=True))
            types = [id_type, pa.int64(), pa.int64(), pa.list_(pa.int32()) if whole else pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=schema.names)

        def told(pieces):
            return [(doc, start, len(data) // 4, np.frombuffer(data, "<u4").tolist() if whole else zlib.crc32(data), n, sequence, at) for doc, start, data, n, sequence, at in pieces]

        ready: list[tuple] = []
        for b in batches:
            id_type = b.schema.field(0).type
            for doc, raw in zip(b.column(0).to_pylist(), utf8(b.column(1)), strict=True):
                ready += told(bins.add(doc, b"".join([*enc.encode(str(raw, "utf-8", "replace")), end])))
                if len(ready) >= (512 if whole else 20_000):
                    yield batch(ready)
                    ready = []
        ready += told(bins.close())
        if ready:
            yield batch(ready)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, schema)
