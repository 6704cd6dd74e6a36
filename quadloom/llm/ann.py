"""Approximate nearest neighbours by low-dimensional stable projections.

Method. Vectors are scaled to unit length, so that nearness by cosine is nearness by distance. A 2-stable (Gaussian) projection to
`PROJECTED` dimensions keeps distances in this sense: projected squared distance over true squared distance is chi-square with that many degrees
of freedom. Every vector lies in a kd-tree over its projection. A query takes the tree's leaves by rising projected distance and
verifies their vectors with true cosines; it stops when the next leaf's projected distance d' and the k-th best true distance d
satisfy Psi(d'^2 / d^2) >= `STOP`: a vector nearer than d would by now have shown up but for a chance of 1 - STOP.

Scale. The upper levels of the tree are built from a bounded sample of projections (`SAMPLE` rows by hash of id) and cut the projected space into
cells of about `SHARD` vectors; every vector is assigned to its cell. Queries go to cells in rounds by rising projected distance: their own,
then `NEAR` more, then the rest up to where the test stops with the k-th distance found so far; a query leaves when it stops. So a query meets few cells
where data have neighbours much nearer than the mass (clusters, copies), and many where they have none (noise of many dimensions, in which no
projection tells neighbours from others). A cell with many vectors or queries is dealt to tasks of at most about `SHARD` vectors and `BLOCK` queries,
whatever the label or the copies; inside a task the lower levels of the tree are searched likewise. Copies of one vector inside a task are one
entry with their k + 1 smallest ids: by the rule for ties no other copy can be among the k nearest. Each task gives at most k rows a query, merged by a
top-k per query.

Cases: vectors that are null, empty, zero or hold null or non-finite numbers take no part, nor do rows without id; of rows that repeat an
id the smallest vector counts; only vectors of the query's own length are its candidates; with fewer than k candidates all are given; ties go
to the smaller id; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadloom.llm.common import Scratch, ship

PROJECTED, LEAF, STOP, SHARD, BLOCK, NEAR, SAMPLE, SEED = 8, 64, 0.985, 4096, 4096, 8, 20_000, 11


def chi_square(x, dof: int):
    """Distribution function for an even number of degrees of freedom."""
    import numpy as np

    half, term, total = np.minimum(x, 1e6) / 2, 1.0, 1.0
    for i in range(1, dof // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def kd_leaves(points, size: int):
    """Rows of each leaf of a kd-tree split at medians of the widest side, with the leaves' boxes."""
    import numpy as np

    leaves, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        own = points[rows]
        if len(rows) <= size:
            leaves.append((rows, own.min(0), own.max(0)))
            continue
        side = int((own.max(0) - own.min(0)).argmax())
        order = np.argsort(own[:, side], kind="stable")
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return [x[0] for x in leaves], np.array([x[1] for x in leaves]), np.array([x[2] for x in leaves])


def plane(size: int, projected: int = PROJECTED, seed: int = SEED):
    """Gaussian projection of vectors of `size` numbers; a longer one begins with the shorter one's rows."""
    import numpy as np

    return np.random.default_rng(seed).standard_normal((size, projected))


def unit_rows(v):
    """Rows scaled to length one; first by their largest part, so that squares neither overflow nor vanish."""
    import numpy as np

    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


class Cells:
    """Upper levels of the kd-tree: medians of a sample cut the whole projected space into cells."""

    def __init__(self, points, count: int):
        import numpy as np

        low, high = np.full(points.shape[1], -np.inf), np.full(points.shape[1], np.inf)
        todo, cells = [(points, low, high, count)], []
        while todo:
            own, low, high, count = todo.pop()
            side = int((own.max(0) - own.min(0)).argmax()) if len(own) else 0
            at = float(np.median(own[:, side])) if len(own) else 0.0
            if count < 2 or len(own) < 4 or not (own[:, side] < at).any():
                cells.append((low, high))
                continue
            left, right = high.copy(), low.copy()
            left[side] = right[side] = at
            todo += [(own[own[:, side] < at], low, left, count // 2), (own[own[:, side] >= at], right, high, count - count // 2)]
        self.low, self.high = np.array([c[0] for c in cells]), np.array([c[1] for c in cells])

    def of(self, points):
        """The cell of each point, which lies in one only."""
        import numpy as np

        out = np.zeros(len(points), np.int64)
        for k in range(len(self.low)):
            out[((points >= self.low[k]) & (points < self.high[k])).all(1)] = k
        return out

    def gaps(self, point):
        """Squared distance from a point to each cell."""
        import numpy as np

        return (np.maximum(np.maximum(self.low - point, point - self.high), 0) ** 2).sum(1)


class Index:
    """kd-tree over the projections of unit vectors."""

    def __init__(self, unit, projected: int = PROJECTED, leaf: int = LEAF, seed: int = SEED):
        self.unit, self.dof = unit, projected
        self.plane = plane(unit.shape[1], projected, seed)
        self.rows, self.low, self.high = kd_leaves(unit @ self.plane, leaf)

    def search(self, queries, k: int, stop: float = STOP, bound=None):
        """`bound` holds each query's k-th squared distance found elsewhere. For each query the rows and cosines of the k best that were verified, by falling cosine; -1 where there are fewer."""
        import numpy as np

        n, at = len(queries), queries @ self.plane
        gap = np.stack([(np.maximum(np.maximum(lo - at, at - hi), 0) ** 2).sum(1) for lo, hi in zip(self.low, self.high, strict=True)], 1)
        order = np.argsort(gap, axis=1, kind="stable")
        best, rows, active = np.full((n, k), -2.0), np.full((n, k), -1), np.arange(n)
        for step in range(order.shape[1]):
            leaf = order[active, step]
            true = np.maximum(2 - 2 * best[active, -1], 0)
            if bound is not None:
                true = np.minimum(true, bound[active])
            near = gap[active, leaf]
            over = (true < 6) & (near > 0) & (chi_square(near / np.maximum(true, 1e-12), self.dof) >= stop)
            active, leaf = active[~over], leaf[~over]
            if not len(active):
                break
            by = np.argsort(leaf, kind="stable")
            for group in np.split(by, np.flatnonzero(np.diff(leaf[by])) + 1):
                qs, members = active[group], self.rows[leaf[group[0]]]
                cosine = np.concatenate((best[qs], queries[qs] @ self.unit[members].T), 1)
                all_rows = np.concatenate((rows[qs], np.broadcast_to(members, (len(qs), len(members)))), 1)
                top = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
                best[qs], rows[qs] = np.take_along_axis(cosine, top, 1), np.take_along_axis(all_rows, top, 1)
        return rows, best


def cosine(a: list[float], b: list[float]) -> float:
    """In double precision, sums rounded once, so that it doesn't depend on order or batch; scaled by powers of two, which changes no digit, so
    that very small and very large numbers neither vanish nor overflow."""
    if not 1e-140 < max(map(abs, a)) < 1e140 or not 1e-140 < max(map(abs, b)) < 1e140:
        a, b = ([math.ldexp(x, -math.frexp(max(map(abs, v)))[1]) for x in v] for v in (a, b))
    return math.fsum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(math.fsum(x * x for x in a) * math.fsum(y * y for y in b))


def neighbours(vectors: DataFrame, is_query, k: int = 5, stop: float = STOP, shard_rows: int = SHARD, block_rows: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding", visits: list | None = None) -> DataFrame:
    """is_query: column of booleans. Per query: query_id, rank, vec_id, score of its k nearest found among all other rows. `visits`, if given, gets each
    round's number of visits of queries to cells, and the number of cells."""
    spark = vectors.sparkSession
    ship(spark)
    scratch = Scratch(spark, "ann")
    fine = F.forall(vectors[vec_col], lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(vectors[vec_col], lambda x: x != 0)
    rows = vectors.where(vectors[id_col].isNotNull() & fine).select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = scratch.table(rows.groupBy("id").agg(F.min(F.struct("v", "q")).alias("r")).select("id", "r.*"), "vectors")
    n, longest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect() if n > shard_rows else []  # a documented bound
    cells = _cells([r["v"] for r in sample], longest or 1, max(1, math.ceil(n / shard_rows)))
    held = spark.sparkContext.broadcast(cells)

    def assigned(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = np.zeros(b.num_rows, np.int64)
            for size, at in _by_size(b.column(1)):
                v = b.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)
                out[at] = held.value.of(unit_rows(v) @ plane(size))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out)], names=["id", "v", "q", "cell"])

    rows = scratch.table(rows.mapInArrow(assigned, "id long, v array<double>, q boolean, cell long"), "cells")
    asks = rows.where("q").select("id", "v", F.col("cell").alias("own"))
    many = rows.groupBy("cell").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("salts"))  # a row per cell
    hits = None
    for turn, (first, last) in enumerate(((0, 1), (1, 1 + NEAR), (1 + NEAR, len(cells.low)))):
        if first >= len(cells.low):
            break
        if hits is None:
            pending = asks.select("id", "v", F.lit(8.0).alias("bound"), F.col("own").alias("cell"))
        else:
            worst = hits.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("m")).select(F.col("query_id").alias("id"), F.when(F.col("m") >= k, 2 - 2 * F.col("s")).otherwise(8.0).alias("bound"))
            pending = asks.join(worst, "id", "left").select("id", "v", F.coalesce("bound", F.lit(8.0)).alias("bound"), "own").mapInArrow(_visits(held, first, last, stop), "id long, v array<double>, bound double, cell long")
        pending = scratch.table(pending, f"pending_{turn}")
        blocks = pending.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
        if visits is not None:
            visits.append((pending.count(), len(cells.low)))
        dealt = F.broadcast(many.join(blocks, "cell"))  # a row per cell, of which there are n / SHARD, SAMPLE / 4 at most
        one = rows.join(dealt, "cell").select("cell", "id", "v", F.lit(False).alias("asks"), F.lit(8.0).alias("bound"), F.pmod(F.xxhash64("id"), F.col("salts")).alias("salt"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        two = pending.join(dealt, "cell").select("cell", "id", "v", F.lit(True).alias("asks"), "bound", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)).alias("salt"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int").alias("block"))
        found = one.union(two).withColumn("size", F.size("v")).groupBy("size", "cell", "salt", "block").applyInArrow(_searched(k, stop), "query_id long, vec_id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        hits = (found if hits is None else found.union(hits.select("query_id", "vec_id", "score"))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        hits = scratch.table(hits, f"hits_{turn}")
    return hits.select("query_id", "rank", "vec_id", "score")


def _by_size(lists):
    """(length, places) of an Arrow column of lists."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes).tolist():
        yield size, np.flatnonzero(sizes == size)


def _cells(vectors: list, longest: int, count: int) -> Cells:
    import numpy as np

    to = plane(longest)
    points = [unit_rows(np.array([v]))[0] @ to[: len(v)] for v in vectors]
    return Cells(np.array(points).reshape(-1, PROJECTED), count)


def _visits(held, first: int, last: int, stop: float):
    """Cells first ... last - 1 of each query by rising projected distance, its own before all, as far as the test doesn't stop."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            take, to = [], []
            bound, own = b.column(2).to_pylist(), b.column(3).to_pylist()
            for size, at in _by_size(b.column(1)):
                v = b.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), size)
                for place, point in zip(at.tolist(), unit_rows(v) @ plane(size), strict=True):
                    gap = held.value.gaps(point)
                    gap[own[place]] = -1.0
                    order = np.argsort(gap, kind="stable")[first:last]
                    d = max(bound[place], 1e-12)
                    go = order if d >= 6 else order[chi_square(np.maximum(gap[order], 0) / d, PROJECTED) < stop]
                    take += [place] * len(go)
                    to += go.tolist()
            got = b.select([0, 1, 2]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(to, pa.int64())], names=["id", "v", "bound", "cell"])

    return run


def _searched(k: int, stop: float):
    """The k best of a cell's vectors for each of its queries."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        out = ([], [], [])
        asks = table.column("asks").to_numpy()
        if asks.any() and not asks.all():
            ids = table.column("id").to_numpy()
            v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            order = np.argsort(ids[~asks], kind="stable")
            base, base_ids = v[~asks][order], ids[~asks][order]
            _, first, same = np.unique(np.ascontiguousarray(base).view(f"V{base.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
            copies: dict[int, list[int]] = {}
            for place, vec_id in zip(same.tolist(), base_ids.tolist(), strict=True):
                if len(held := copies.setdefault(place, [])) <= k:
                    held.append(vec_id)
            distinct, asked, asked_ids = base[first], v[asks], ids[asks].tolist()
            unit = unit_rows(distinct)
            found, _ = Index(unit).search(unit_rows(asked), min(len(unit), 2 * k + 4), stop, table.column("bound").to_numpy()[asks])
            for q, (query, near) in enumerate(zip(asked_ids, found.tolist(), strict=True)):
                mine = asked[q].tolist()
                scored = sorted(((-cosine(mine, distinct[place].tolist()), vec_id) for place in near if place >= 0 for vec_id in copies[place] if vec_id != query))[:k]
                out[0].extend([query] * len(scored))
                out[1].extend(vec_id for _, vec_id in scored)
                out[2].extend(-s for s, _ in scored)
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run
