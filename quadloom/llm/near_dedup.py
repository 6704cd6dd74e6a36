"""Near-duplicates by MinHash: a signature-coordinate inverted join, links confirmed on full sets.

Sets. Words are `[^\\x20\\x09-\\x0D]+` of the whole text with A-Z in lower case; a document's set holds its distinct `width`-word
shingles as 64-bit hashes (with fewer words, the whole sequence is one). Two documents are linked if 100 * |A & B| >= 80 * |A | B|.

Method.
1. Each text becomes a signature and a 128-bit key of its set. A coordinate is a bin of one permutation: the smallest hash among those
   with the same first bits; bins without any have no coordinate. Documents of one key are one class.
2. Of the m bins that A | B fills, each differs with the chance 1 - |A & B| / |A | B|, so a linked pair differs in at most D(m), the
   quantile of a binomial law at `MISS`; nor can it differ in more bins than A and B have shingles apart, a quarter of either set. A class can
   thus differ from a linked one in a bounded number d of its own coordinates, and the pair meets in one of its d + 1 rarest (prefix, by
   counts over all classes; a value that one class alone holds takes a place and is posted nowhere). Those are posted under their
   coordinate-value pairs.
3. Lists are not expanded into pairs. First each class is compared only with its best pivot: of the members of its lists with the fewest
   coordinates of their own (copies have most in common with what they were made from) the one with which most marks, finer coordinates of
   one bit each, collide. A pair goes on if no fewer collide than in a linked one, by the same law (skip: coordinates outside the prefix are
   never merged); then its sets are compared in full. That collapses groups of copies.
4. Lists whose members are one component by now are done. Of the other lists' classes the shingles that no other such class has are
   counted: a class can share only its others, so a pair whose others are too few for a link never meets (the same prefix filter on whole
   sets).
5. These lists are dealt by size bands, and members that by their sizes and own shingles fit no other are dropped. In lists with few members left (`FEW`) these meet each other.
6. From a longer list one pivot p is taken and all members are compared with it in full, which gives each one's difference to p as a set.
   Two members of which one is not linked with p can be linked only if their differences overlap by a known number, so they
   are posted again under the rarest elements of their differences to p (prefix and positional filter, exact), and those lists
   are treated like the former ones. Edits of one copy alone are in one difference only and are posted nowhere, so the lists of a
   large group of copies scatter.
7. A round ends when links are merged (alternating large and small stars); rounds end when no list is left. So every pair that
   shares a posting is compared, or connected, or shown to be unlinked: components are as if all pairs had been compared, while a group
   of n near-copies costs about n comparisons.

A linked pair is missed if it differs in more coordinates than either bound: about one in a million each.

Nothing about documents reaches the driver but counts of rounds. Skew: counts are aggregated before shuffles, hot lists are joined
with one pivot each by joins that Spark can split, a pivot's text goes to as many tasks as its number of pairs asks for (`SPREAD`). Tables between rounds are written to the shared
folder, so lost executors cost one round at most.

Cases: null and empty texts have no set, are their own component and kept; repeated rows are one class, all with the smallest id
(so rows that repeat an id all count as kept by `grouped`, while `deduplicated` keeps one row of them); null ids come last and are kept only
if their component has no other; an empty table gives an empty result; further columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadloom.llm.common import Scratch, ship, utf8
from quadloom.llm.exact_dedup import located

WIDTH, PERCENT, BITS, MARK_BITS, MISS, FEW, SPREAD = 4, 80, 7, 10, 1e-6, 16, 512


def shingles(raw: bytes, width: int):
    """Sorted distinct 64-bit hashes of a text's shingles."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    words = raw.lower().split()  # of bytes: A-Z only, and ASCII white space only
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, width)
    with np.errstate(over="ignore"):
        h = np.full(n - k + 1, np.uint64(k), np.uint64)
        for i in range(k):
            h ^= w[i : n - k + 1 + i]
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    h.sort()  # in place, and not np.unique, which fills a hash table first
    first = np.ones(len(h), bool)
    np.not_equal(h[1:], h[:-1], out=first[1:])
    return h[first]


def set_key(found) -> tuple[int, int]:
    d = hashlib.blake2b(found.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def linked(a, b, percent: int) -> bool:
    """Are two sorted sets similar enough?"""
    import numpy as np

    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * common >= percent * (len(a) + len(b) - common)


@lru_cache(8)
def most_different(bins: int, chance: float, miss: float = MISS) -> list[int]:
    """D(m) for m = 0 ... bins: more than D(m) of m differ with a chance of at most `miss`, if each does with `chance`."""
    out, law = [0], [1.0]  # law[d]: chance that d of m differ
    for _ in range(bins):
        law = [a * (1 - chance) + b * chance for a, b in zip([*law, 0.0], [0.0, *law], strict=True)]
        above, d = 0.0, len(law) - 1
        while d and (above := above + law[d]) <= miss:
            d -= 1
        out.append(d)
        while law[-1] < 1e-30:  # what can't matter any more
            law.pop()
    return out


def coordinates(found, bits: int):
    """(bin, 32-bit value) of each bin that is filled: its first hash, since the hashes are sorted."""
    import numpy as np

    at = (found >> np.uint64(64 - bits)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(found) else np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        mixed = found[first] * np.uint64(0xD6E8FEB86659FD93)
    return at[first], (mixed >> np.uint64(32)).astype(np.int64)


def marks(found, bits: int):
    """One bit for each of the 2**bits finer bins, of its first hash (0 if it is empty), as 64-bit numbers."""
    import numpy as np

    out = np.zeros(1 << bits, np.uint8)
    if len(found):
        at = (found >> np.uint64(64 - bits)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        with np.errstate(over="ignore"):
            out[at[first]] = ((found[first] * np.uint64(0xA0761D6478BD642F)) >> np.uint64(63)).astype(np.uint8)
    return np.packbits(out).view(np.int64)


def signatures(docs: DataFrame, file: str, at: str, width: int, percent: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """Per row of docs, which columns `file` and `at` locate: id, n (set size), k1, k2 (key), posts (coordinate-value pairs), spare (how many more than its
    own coordinates are posted; below 0: fewer), marks, most (marks in which a linked set may differ), file, at, row (a number of its own, fixed once written)."""
    long, longs = T.LongType(), T.ArrayType(T.LongType(), False)
    names = {"n": long, "k1": long, "k2": long, "posts": longs, "spare": long, "marks": longs, "most": long, "file": long, "at": long, "row": long}
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *(T.StructField(k, t) for k, t in names.items())])
    bins, fine = 1 << bits, 1 << MARK_BITS
    differ, marked = most_different(bins, 1 - percent / 100), most_different(fine, (1 - percent / 100) / 2)

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                sizes, k1, k2, posts, spare, most, held = [], [], [], [], [], [], []
                for raw in utf8(part.column(1)):
                    found = shingles(raw, width)
                    n = len(found)
                    sizes.append(n)
                    a, c = set_key(found)
                    k1.append(a)
                    k2.append(c)
                    places, value = coordinates(found, bits)
                    posts.append(places << 32 | value)
                    apart = n * (100 - percent) // percent  # shingles in one of two linked sets only; beside this set at most as many
                    spare.append(min(differ[min(bins, len(places) + apart)], apart) + 1 - len(places))
                    held.append(marks(found, MARK_BITS))
                    most.append(min(marked[min(fine, n + apart)], apart))
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, posts)]), pa.int32()), pa.array(np.concatenate(posts) if posts else [], pa.int64()))
                packed = pa.ListArray.from_arrays(pa.array(np.arange(0, len(sizes) * fine // 64 + 1, fine // 64), pa.int32()), pa.array(np.concatenate(held) if held else [], pa.int64()))
                numbers = [pa.array(x, pa.int64()) for x in (sizes, k1, k2, spare, most, range(row, row + len(sizes)))]
                yield pa.RecordBatch.from_arrays([part.column(0), numbers[0], numbers[1], numbers[2], lists, numbers[3], packed, numbers[4], part.column(2), part.column(3), numbers[5]], names=schema.names)
                row += len(sizes)

    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.col(file).alias("file"), F.col(at).alias("at")).mapInArrow(run, schema)


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame | None:
    """(node, root) of every node of (a, b) edges, root being the smallest node of its component; None if there is no edge."""

    def put(df, table):
        seen = Observation()
        out = scratch.table(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), table)
        return out, (seen.get.get("n") or 0, seen.get.get("h"))

    now, before = put(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}_0")
    if not before[0]:
        scratch.drop(f"{name}_0")
        return None
    k = 0
    while True:
        k += 1
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))  # here a > b always
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).where("a != b").distinct()
        now, after = put(small, f"{name}_{k}")
        scratch.drop(f"{name}_{k - 1}")
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def _compared(pairs: DataFrame, texts: DataFrame, width: int, percent: int, run, schema: str) -> DataFrame:
    """`run` over (p, u, u_text, p_text) of (u, p) pairs of classes; a pivot with many pairs is dealt to several tasks."""
    salts = pairs.groupBy("p").agg(F.ceil(F.count(F.lit(1)) / SPREAD).cast("int").alias("salts"))
    mine = texts.select(F.col("node").alias("u"), F.col("text").alias("u_text"))
    other = texts.select(F.col("node").alias("p"), F.col("text").alias("p_text")).join(salts, "p").select("p", "p_text", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    dealt = pairs.select("u", "p").join(salts, "p").select("u", "p", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int").alias("salt"))
    return dealt.join(mine, "u").join(other, ["p", "salt"]).select("p", "u", "u_text", "p_text").mapInArrow(run, schema)


def _sets(width: int):
    """node, text -> its shingles; the last ones are kept, since a pivot's rows come together."""
    held: dict[int, object] = {}

    def of(node, raw):
        if (found := held.get(node)) is None:
            if len(held) >= 64:
                held.clear()
            held[node] = found = shingles(raw, width)
        return found

    return of


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of (u, p) pairs of classes, those whose full sets are linked, as (a, b)."""

    def run(batches):
        import pyarrow as pa

        of = _sets(width)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                p, u = part.column(0).to_pylist(), part.column(1).to_pylist()
                ok = [linked(of(y, yt), of(x, xt), percent) for y, x, xt, yt in zip(p, u, utf8(part.column(2)), utf8(part.column(3)), strict=True)]
                kept = [k for k, yes in enumerate(ok) if yes]
                yield pa.RecordBatch.from_arrays([pa.array([u[k] for k in kept], pa.int64()), pa.array([p[k] for k in kept], pa.int64())], names=["a", "b"])

    return _compared(pairs, texts, width, percent, run, "a long, b long")


def _differences(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Per (u, p) pair: n and p_n (set sizes), differ (the hashes in one of the two sets only)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        of = _sets(width)
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                p, u = part.column(0).to_pylist(), part.column(1).to_pylist()
                sets = [(of(x, xt), of(y, yt)) for y, x, xt, yt in zip(p, u, utf8(part.column(2)), utf8(part.column(3)), strict=True)]
                differ = [np.setxor1d(x, y, assume_unique=True).view(np.int64) for x, y in sets]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, differ)]), pa.int32()), pa.array(np.concatenate(differ), pa.int64()))
                sizes = [pa.array([len(s[k]) for s in sets], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(0), *sizes, lists], names=["u", "p", "n", "p_n", "differ"])

    return _compared(pairs, texts, width, percent, run, "u long, p long, n long, p_n long, differ array<long>")


#: What a posting carries. A partner's `s` must not exceed `r`; of two partners one is astray and one is at home.
_POSTING = ["key", "node", "n", "own", "s", "r", "astray", "home"]


def _banded(postings: DataFrame, percent: int) -> DataFrame:
    """Postings dealt by size: at home in their band, guests in the one below, since linked sizes differ by one band at most."""
    band = F.floor(F.log("n") / math.log(100 / percent) * (1 - 1e-9))
    two = postings.withColumn("home", F.explode(F.array(F.lit(True), F.lit(False))))
    return two.withColumn("key", F.xxhash64("key", F.when(F.col("home"), band).otherwise(band - 1))).select(_POSTING)


def _reposted(differences: DataFrame, percent: int) -> DataFrame:
    """Postings under the rarest elements of differences.

    With d the size of a difference to p, sets u and v of n elements are linked if (100 + percent) * (d_u + d_v - 2 * overlap) <= (100 - percent) *
    (n_u + n_v), that is 2 * (100 + percent) * overlap >= s_u + s_v. Behind the first shared element at place i, overlap is at most d - i + 1.
    """
    more, less = 100 + percent, 100 - percent
    told = differences.withColumn("d", F.size("differ").cast("long")).withColumn("s", more * F.col("d") - less * F.col("n")).withColumn("astray", F.col("s") > less * F.col("p_n"))
    least = told.groupBy("p").agg(F.min("s").alias("least"), F.min(F.when(F.col("astray"), F.col("s"))).alias("least_astray")).where("least_astray IS NOT NULL")
    each = told.select("u", "p", F.explode("differ").alias("e"))
    often = each.groupBy("p", "e").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = each.join(often, ["p", "e"]).groupBy("u", "p").agg(F.sort_array(F.collect_list(F.struct("often", "e"))).alias("shared"))
    placed = told.drop("differ").join(least, "p").join(shared, ["u", "p"]).select("*", F.posexplode("shared"))
    placed = placed.withColumn("r", 2 * more * (F.size("shared") - F.col("pos")) - F.col("s")).where("r >= IF(astray, least, least_astray)")
    return placed.select(F.xxhash64("p", "col.e").alias("key"), F.col("u").alias("node"), "n", F.col("d").alias("own"), "s", "r", "astray")


def _fitting(lists: DataFrame, scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """The postings with comp that may have a partner of another component in their list, as far as bounds of the whole list tell."""
    flags = {"": F.lit(True), "_astray": F.col("astray"), "_home": F.col("home"), "_both": F.col("astray") & F.col("home")}
    bounds = [F.max(F.when(c, F.col("r"))).alias(f"r{k}") for k, c in flags.items()] + [F.min(F.when(c, F.col("s"))).alias(f"s{k}") for k, c in flags.items()]
    bounds += [F.min("comp").alias("lo"), F.max("comp").alias("hi")]
    for k in (1, 2):
        of_list = lists.groupBy("key").agg(*bounds).where("lo < hi")
        of_list = of_list.select("key", *(F.col(f"{x}{f}").alias(f"b_{x}{f}") for x in "rs" for f in flags))

        def bound(x):
            return F.when(F.col("astray") & F.col("home"), F.col(f"b_{x}")).when(F.col("home"), F.col(f"b_{x}_astray")).when(F.col("astray"), F.col(f"b_{x}_home")).otherwise(F.col(f"b_{x}_both"))

        kept = lists.join(of_list, "key").where((F.col("s") <= bound("r")) & (bound("s") <= F.col("r"))).select(*_POSTING, "comp")
        lists, n = _stored(scratch, kept, f"{name}_{k}")
    scratch.drop(f"{name}_1")
    return lists, n


def _shingled(texts: DataFrame, width: int) -> DataFrame:
    """(node, h) of (node, text): every shingle of every text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                found = [shingles(raw, width) for raw in utf8(part.column(1))]
                nodes = np.repeat(part.column(0).to_numpy(), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(found).view(np.int64), pa.int64())], names=["node", "h"])

    return texts.select("node", "text").mapInArrow(run, "node long, h long")


def _stored(scratch: Scratch, df: DataFrame, table: str) -> tuple[DataFrame, int]:
    """A written table and its number of rows, in one job."""
    seen = Observation()
    out = scratch.table(df.observe(seen, F.count(F.lit(1)).alias("n")), table)
    return out, seen.get.get("n") or 0


def _judged(docs, file, at, scratch, width, percent, bits, id_col, text_col) -> DataFrame:
    """Per row of docs, which columns `file` and `at` locate: id, n, component_id, stays, file, at."""
    ship(docs.sparkSession)
    rows = scratch.table(signatures(docs, file, at, width, percent, bits, id_col, text_col), "rows")
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("best")
    one = scratch.table(rows.where("n > 0").groupBy("k1", "k2").agg(F.min("row").alias("node"), best), "one")

    posted = rows.select(F.col("row").alias("node"), "posts").join(one.select("node"), "node").select("node", F.explode("posts").alias("key"))
    often = posted.groupBy("key").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = posted.join(often, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("keys"))
    shared = shared.join(rows.select(F.col("row").alias("node"), "n", "spare", F.size("posts").alias("places")), "node").withColumn("left", (F.col("spare") + F.size("keys")).cast("int"))  # values of this class alone have taken the other places
    lists = scratch.table(shared.where("left > 0").select("node", "n", (F.col("places") - F.size("keys")).alias("private"), F.explode(F.slice("keys", F.lit(1), F.col("left"))).alias("k")).select("node", "n", "private", F.col("k.key").alias("key")), "lists")

    asked = rows.select(F.col("row").alias("node"), "marks", "most", "file", "at").join(lists.select("node").distinct(), "node", "left_semi")
    asked = scratch.table(asked, "asked")
    texts = docs.select(F.col(file).alias("file"), F.col(at).alias("at"), docs[text_col].alias("text")).join(asked.select("node", "file", "at"), ["file", "at"]).select("node", "text")
    texts = scratch.table(texts, "texts")
    sigs = asked.select("node", "marks", "most")
    comps = None  # (node, root) where a class has been linked

    def rooted(t, node, root):
        if comps is None:
            return t.withColumn(root, F.col(node))
        known = comps.select(F.col("node").alias(node), F.col("root").alias("_r"))
        return t.join(known, node, "left").withColumn(root, F.coalesce("_r", node)).drop("_r")

    def like(pairs):
        """Of (u, p), those in which no fewer marks collide than in a linked pair, with the number that don't."""
        apart = F.expr("aggregate(zip_with(u_marks, p_marks, (x, y) -> bit_count(x ^ y)), 0, (n, d) -> n + d)")
        known = pairs.join(sigs.toDF("u", "u_marks", "u_most"), "u").join(sigs.toDF("p", "p_marks", "p_most"), "p").withColumn("apart", apart)
        return known.where(F.col("apart") <= F.least("u_most", "p_most")).select("u", "p", "apart")

    def merge(edges, step):
        nonlocal comps
        joined = edges.select(F.col("a").alias("u"), F.col("b").alias("p"))
        merged = components(rooted(rooted(joined, "u", "a"), "p", "b").select("a", "b"), scratch, f"cc_{step}")
        if merged is not None:
            if comps is not None:
                moved = comps.join(merged.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
                merged = moved.union(merged.join(comps.select("node"), "node", "left_anti"))
            comps = scratch.table(merged, f"comps_{step}")

    # Each class with its best pivot
    first = lists.groupBy("key").agg(F.min(F.struct("private", "node", "n")).alias("f")).select("key", F.col("f.node").alias("p"), F.col("f.n").alias("p_n"))
    fits = F.lit(100) * F.least("n", "p_n") >= F.lit(percent) * F.greatest("n", "p_n")
    pairs = like(lists.join(first, "key").where((F.col("node") != F.col("p")) & fits).select(F.col("node").alias("u"), "p").distinct())
    pairs = pairs.groupBy("u").agg(F.min(F.struct("apart", "p")).alias("best")).select("u", F.col("best.p").alias("p"))
    pairs, n = _stored(scratch, pairs, "pairs_0")
    edges, n = _stored(scratch, _confirmed(pairs, texts, width, percent), "edges_0") if n else (None, 0)
    if n:
        merge(edges, 0)

    # Own shingles, of the classes in lists that are not one component
    mixed = rooted(lists, "node", "comp").groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    lists = scratch.table(lists.join(mixed, "key").select("node", "n", "key"), "lists_open")
    met = texts.join(lists.select("node").distinct(), "node", "left_semi")
    alone = _shingled(met, width).groupBy("h").agg(F.count(F.lit(1)).alias("held"), F.min("node").alias("node")).where("held = 1").groupBy("node").agg(F.count(F.lit(1)).alias("own"))
    lists = lists.join(alone, "node", "left").select("node", "n", F.coalesce("own", F.lit(0)).alias("own"), "key").withColumn("c", F.col("n") - F.col("own"))
    lists = scratch.table(lists.where(F.lit(100) * F.col("c") >= F.lit(percent) * F.col("n")), "lists_0")
    scratch.drop("lists", "lists_open")
    s, r = F.lit(percent) * F.col("n"), F.lit(100 + percent) * F.col("c") - F.lit(percent) * F.col("n")
    lists = _banded(lists.select("key", "node", "n", "own", s.alias("s"), r.alias("r"), F.lit(True).alias("astray")), percent)

    step = 0
    while True:
        step += 1
        lists, left = _fitting(rooted(lists, "node", "comp"), scratch, f"fit_{step}")
        scratch.drop(f"lists_{step - 1}", f"differ_{step - 1}")
        if not left:
            break
        sizes = scratch.table(lists.groupBy("key").agg(F.count_if("astray").alias("size"), F.min(F.struct(~F.col("astray"), "own", "node")).alias("f")).select("key", "size", F.col("f.node").alias("p")), f"sizes_{step}")

        # Short lists: those astray meet the others
        short = lists.join(sizes.where(F.col("size") <= FEW).select("key"), "key")
        a, b = short.where("astray").select(*(F.col(c).alias(f"a_{c}") if c != "key" else F.col(c) for c in short.columns)), short
        meet = (F.col("a_s") <= F.col("r")) & (F.col("s") <= F.col("a_r")) & (F.col("a_comp") != F.col("comp")) & (F.col("a_home") | F.col("home")) & (~F.col("astray") | (F.col("a_node") < F.col("node")))
        pairs, n = _stored(scratch, like(a.join(b, "key").where(meet).select(F.col("a_node").alias("u"), F.col("node").alias("p")).distinct()).select("u", "p"), f"pairs_{step}")
        edges = _confirmed(pairs, texts, width, percent) if n else None

        # Long lists: all meet one pivot and are posted again by what differs from it
        again = lists.join(sizes.where(F.col("size") > FEW).select("key", "p"), "key").where(F.col("node") != F.col("p")).select(F.col("node").alias("u"), "p").distinct()
        again, m = _stored(scratch, again, f"again_{step}")
        if m:
            differences = scratch.table(_differences(again, texts, width, percent), f"differ_{step}")
            found = differences.where(F.lit(100 + percent) * F.size("differ") <= F.lit(100 - percent) * (F.col("n") + F.col("p_n"))).select(F.col("u").alias("a"), F.col("p").alias("b"))
            edges = found if edges is None else edges.union(found)
        if edges is not None:
            edges, n = _stored(scratch, edges, f"edges_{step}")
            if n:
                merge(edges, step)
        scratch.drop(f"pairs_{step}", f"edges_{step}", f"again_{step}", f"sizes_{step}", f"fit_{step}_2")
        if not m:
            break
        lists = scratch.table(_banded(_reposted(differences, percent), percent), f"lists_{step}")
    scratch.drop("texts", "asked")
    of_class = rooted(one, "node", "comp")
    of_class = of_class.join(of_class.groupBy("comp").agg(F.min("best").alias("first")), "comp").select("k1", "k2", "first")
    out = rows.select("id", "n", "k1", "k2", "file", "at", "row").join(of_class, ["k1", "k2"], "left")
    return out.select("id", "n", F.when(F.col("n") > 0, F.col("first.id")).otherwise(F.col("id")).alias("component_id"), ((F.col("n") == 0) | (F.col("first.row") == F.col("row"))).alias("stays"), "file", "at")


def grouped(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept."""
    scratch = Scratch(docs.sparkSession, "near")
    out = _judged(*located(docs, scratch), scratch, width, percent, bits, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the smallest id (null last), then the first; and all rows without words. The columns of docs.

    Rows are told apart by their place, not by id: rows that repeat an id, or have none, are judged each by its own text.
    """
    scratch = Scratch(docs.sparkSession, "near")
    docs, file, at = located(docs, scratch)
    gone = _judged(docs, file, at, scratch, width, percent, bits, id_col, text_col).where("NOT stays").select(F.col("file").alias(file), F.col("at").alias(at))
    return docs.join(gone, [file, at], "left_anti").drop(file, at)
