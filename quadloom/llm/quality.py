"""Quality classification by importance resampling.

Method. Hashed n-gram models (add-one multinomials, one for each kind of n-gram) are counted for the target, labelled good documents,
and for the raw corpus, all documents. Features of a text: each word's hash, bigrams of words, and bigrams of word shapes (runs of letters
by case, digits, and other characters as they are) with a mark where a word repeats the one before it. Tables of bigrams grow with the
cube root of the corpus's bytes (`bits`): 2^17 buckets each at 0.5 GB, 2^19 at 30 GB, 2^23 at 100 TB. A document's importance is
log p_target - log p_raw, tempered for long texts; Gumbel noise, drawn from the document's id, is added, and the k largest keys are taken, which is a sample of
k documents without replacement in proportion to importance. k is the number of documents at or above the importance that best
divides good from bad labelled documents.

What is fitted on labels uses a bounded sample, `LABELLED` rows by hash of id, one half for the
target model and the other for the division (`halves`); raw counts, importances, k and the k-th key cover all
documents. To the driver go the buckets' counts of each model, the sample's importances and histograms of at most 4096 rows. The k-th key is found
by narrowing histograms, not by a sort into one task.

Cases: null and empty texts have importance 0; without labelled good documents nothing is known, and all are kept; without bad ones
the division is the least good importance; ties at the k-th key are all kept; repeated rows get the same key and share their
fate; labels without a document or quality are ignored, of several for a document the worst counts; further columns stay as they are.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.llm.common import Scratch, ship, utf8

#: Few buckets for single words, so that the ratio tells kinds of words; what tells single ones are the bigrams, whose tables grow.
WORDS, LABELLED, SEED = 1 << 11, 20_000, 7
#: Buckets of bigrams: at least this many times the cube root of the bytes of all texts.
GROWTH = 128
#: A document counts as at most so many n-grams, at the mean ratio of all it has: else a long text's small leanings outweigh a short one's faults.
EFFECTIVE = 200


def bits(n_bytes: int) -> int:
    """log2 of the buckets of each table of bigrams."""
    return max(10, math.ceil(math.log2(GROWTH * max(1, n_bytes) ** (1 / 3))))


def parts(b: int) -> list[slice]:
    """Where the tables of words, bigrams of shapes and bigrams of words lie."""
    return [slice(0, WORDS), slice(WORDS, WORDS + (1 << b)), slice(WORDS + (1 << b), WORDS + (2 << b))]


class _Words(dict):
    """word -> its hash and its shape's; bounded."""

    def __missing__(self, word):
        from xxhash import xxh32_intdigest

        if len(self) >= 100_000:
            self.clear()
        shape = word.translate(_SHAPE)
        out, last = bytearray(), -1
        for c in shape:
            if c != last or c not in b"Aa0":
                out.append(c)
            last = c
        self[word] = value = xxh32_intdigest(word.lower()) | (xxh32_intdigest(bytes(out)) << 32)
        return value


_SHAPE = bytes(65 if 65 <= c <= 90 else 97 if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else c for c in range(256))


@lru_cache(1)
def _words() -> _Words:
    return _Words()


def features(raw: bytes, b: int):
    """Buckets of a text's n-grams, in the tables of `parts(b)`."""
    import numpy as np

    split = raw.split()
    both = np.fromiter(map(_words().__getitem__, split), np.uint64, len(split))
    word, shape = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    single = (word % np.uint64(WORDS)).astype(np.int64)
    if len(split) < 2:
        return single

    def pairs(x, mark):
        mixed = (x[:-1] * np.uint64(0x9E3779B1) + x[1:] * np.uint64(0x85EBCA77) + mark * np.uint64(0xC2B2AE3D)) & np.uint64(0xFFFFFFFF)
        return ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - b)).astype(np.int64)

    same = (word[1:] == word[:-1]).astype(np.uint64)
    return np.concatenate((single, pairs(shape, same) + WORDS, pairs(word, np.uint64(0)) + (WORDS + (1 << b))))


def gumbel(doc_id, seed: int = SEED) -> float:
    from xxhash import xxh64_intdigest

    u = (xxh64_intdigest(repr(doc_id), seed) + 0.5) / 2.0**64
    return -math.log(-math.log(u if u < 1 else 1 - 2.0**-53))


class Model:
    """Log ratio of the two models, by bucket."""

    def __init__(self, target, raw, b: int):
        import numpy as np

        ratio = []
        for part in parts(b):
            t, r = target[part] + 1.0, raw[part] + 1.0
            ratio.append(np.log(t / t.sum()) - np.log(r / r.sum()))
        self.ratio, self.bits = np.concatenate(ratio), b

    def importance(self, raw: bytes) -> float:
        return tempered(self.ratio[features(raw, self.bits)])


def tempered(ratios) -> float:
    """Sum of log ratios; of more than EFFECTIVE, so many times their mean."""
    return float(ratios.sum()) * min(1.0, EFFECTIVE / max(1, len(ratios)))


def labelled(labels: DataFrame, bound: int = LABELLED) -> DataFrame:
    """(l_id, good, half) of at most `bound` labelled documents, the first by hash of their id."""
    one = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"))
    first = one.select(F.col("doc_id").alias("l_id"), (F.col("q") > 0).alias("good")).orderBy(F.xxhash64("l_id"), "l_id").limit(bound)
    return first.withColumn("half", F.pmod(F.xxhash64(F.lit(SEED), "l_id"), F.lit(2)))


def halves(sample: DataFrame) -> DataFrame:
    """(l_id, good, counts, divides): one half is counted in the target model, the other, which that hasn't seen, finds the division.

    A model knows the texts it counted better than others like them. Where a half lacks good ones, or the other bad ones, all serve for both.
    """
    n = {(r["half"], r["good"]): r["count"] for r in sample.groupBy("half", "good").count().collect()}  # at most four rows
    both = not (n.get((0, True)) and n.get((1, True)) and (n.get((1, False)) or not n.get((0, False))))
    return sample.select("l_id", "good", (F.lit(both) | (F.col("half") == 0)).alias("counts"), (F.lit(both) | (F.col("half") == 1)).alias("divides"))


def fitted(docs: DataFrame, sample: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """The models of target and of all docs, in one pass after one that adds up lengths; None without good labelled documents."""
    ship(docs.sparkSession)
    b = bits(docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")))).first()[0] or 0)
    size = parts(b)[-1].stop

    def run(batches):
        import numpy as np
        import pyarrow as pa

        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for good, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                found = features(text, b)
                if len(found) > size:
                    n = np.bincount(found, minlength=size)
                    raw += n
                    target += n * bool(good)
                else:
                    np.add.at(raw, found, 1)
                    if good:
                        np.add.at(target, found, 1)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw[at], pa.int64()), pa.array(target[at], pa.int64())], names=["bucket", "raw", "target"])

    told = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(sample), F.col("id") == F.col("l_id"), "left").select((F.col("good") & F.col("counts")).alias("good"), "text")
    counts = told.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # at most `size` rows
    import numpy as np

    raw, target = np.zeros(size), np.zeros(size)
    raw[counts.bucket], target[counts.bucket] = counts.raw, counts.target
    return Model(target, raw, b) if target.any() else None


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, log_weight, key."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # a number for each bucket

    def run(batches):
        import pyarrow as pa

        ratio = held.value.ratio
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                ids, n, weight = part.column(0).to_pylist(), [], []
                for raw in utf8(part.column(1)):
                    found = features(raw, held.value.bits)
                    n.append((len(found) + 2) // 3)
                    weight.append(tempered(ratio[found]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(weight, pa.float64()), pa.array([w + gumbel(d) for w, d in zip(weight, ids, strict=True)], pa.float64())], names=["id", "n_tokens", "log_weight", "key"])

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, log_weight double, key double")


def division(scored: DataFrame, sample: DataFrame) -> float:
    """The importance that best divides good from bad among the sample's documents that divide; in the middle of its gap."""
    got = scored.join(F.broadcast(sample.where("divides")), F.col("id") == F.col("l_id")).select("log_weight", "good").toPandas().sort_values("log_weight")
    if got.good.all():
        return float(got.log_weight.min())
    wrong = got.good.cumsum().shift(fill_value=0) + (~got.good)[::-1].cumsum()[::-1]  # cutting before each row
    at = int(wrong.to_numpy().argmin())
    w = got.log_weight.to_numpy()
    return float(w[at] if at == 0 else (w[at] + w[at - 1]) / 2)


def kth_largest(table: DataFrame, column: str, k: int) -> float:
    """Exact: histograms of at most 4096 bins narrow the range until few rows are left in it."""
    lo, hi, n = table.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n or k <= 0:
        return math.inf
    k = min(k, n)
    while n > 4096 and lo < hi:
        width = (hi - lo) / 4096
        bins = {r["bin"]: (r["n"], r["lo"], r["hi"]) for r in table.where(F.col(column).between(lo, hi)).groupBy(F.floor((F.col(column) - lo) / width).alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            if k <= bins[b][0]:
                break
            k -= bins[b][0]
        if bins[b][0] == n:
            break
        n, lo, hi = bins[b]
    if lo == hi:
        return lo
    left = [r[0] for r in table.where(F.col(column).between(lo, hi)).select(column).orderBy(F.col(column).desc()).limit(k).collect()]
    return left[-1]


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = LABELLED) -> DataFrame:
    """Per row: id, n_tokens, log_weight, key, kept."""
    scratch = Scratch(docs.sparkSession, "quality")
    scored, cut = _scored(docs, labels, scratch, id_col, text_col, bound)[:2]
    return scored.select(F.col("id").alias(id_col), "n_tokens", "log_weight", "key", (F.col("key") >= cut).alias("kept"))


def _scored(docs, labels, scratch, id_col, text_col, bound):
    first = scratch.table(labelled(labels, bound), "labelled")
    met = docs.select(docs[id_col].alias("id")).join(F.broadcast(first), F.col("id") == F.col("l_id")).select(first.columns).distinct()
    sample = halves(scratch.table(met, "met"))
    model = fitted(docs, sample, id_col, text_col)
    if model is None:
        ids = docs.select(docs[id_col].alias("id"), F.lit(0).cast("long").alias("n_tokens"), F.lit(0.0).alias("log_weight"), F.lit(0.0).alias("key"))
        return ids, -math.inf, None
    scored = scratch.table(scores(docs, model, id_col, text_col), "scores")
    k = scored.where(F.col("log_weight") >= division(scored, sample)).count()
    return scored, kth_largest(scored, "key", k), model


def kept(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = LABELLED) -> DataFrame:
    """The sampled documents, with the columns of docs. A document's key follows from its row, so nothing is joined."""
    scratch = Scratch(docs.sparkSession, "quality")
    _, cut, model = _scored(docs, labels, scratch, id_col, text_col, bound)
    if model is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(model)
    at_id, at_text = docs.columns.index(id_col), docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                ok = [held.value.importance(raw) + gumbel(d) >= cut for d, raw in zip(part.column(at_id).to_pylist(), utf8(part.column(at_text)), strict=True)]
                yield part.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
