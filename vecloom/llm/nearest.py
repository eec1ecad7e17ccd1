"""Problem 2: the k keys of largest inner product for every query, by vantage-point trees per shard.

A collection's keys are spread by a hash over shards of bounded size, its queries over blocks. Each pair of
a shard and a block is one task: a stated set of queries against all keys, in blocks.

Inner products become distances. A shard is cut into bands of falling norm; in a band with largest norm M,
a key x gets the coordinate sqrt(M^2 - |x|^2) and a query is scaled to norm M, so that
d^2 = 2 M^2 - 2 M (q x) / |q|. Each band has a vantage-point tree: a node keeps the interval of its keys'
distances to the vantage point above it, and by the triangle inequality no key in it can be nearer to a
query at distance d than the distance from d to that interval. A leaf is skipped when that bound exceeds
factor * (distance of the k-th best so far). Factor 1 gives the exact result, equal products by rising
position included; a smaller one skips more.

A collection of several shards is searched twice: what the first shard gives is the bound with which every query
enters the others, so that they skip leaves from the start and return only what can still be among the best.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.sources import ensure_checkpoint_dir

#: Relaxation of the bound, leaf size, keys of a band, keys of a shard, queries of a block.
FACTOR, LEAF, BAND, SHARD_ROWS, BLOCK_ROWS = 0.95, 256, 2048, 32_768, 16_384


#: Up to so many candidates per query on average, a leaf's candidates are taken in one by one.
FEW = 8


class Tree:
    """Vantage-point tree over the rows of y, split at the median distance down to leaves."""

    def __init__(self, y: np.ndarray, leaf: int = LEAF):
        self.points: list[np.ndarray] = []  # vantage points
        self.leaves: list[tuple[np.ndarray, list[tuple[int, float, float]]]] = []  # rows; (vantage point, interval) of its ancestors
        self._grow(y, np.arange(len(y)), [], leaf)

    def _grow(self, y: np.ndarray, rows: np.ndarray, path: list[tuple[int, float, float]], leaf: int) -> None:
        part = y[rows]
        if len(rows) > leaf:
            # a row far from the middle tells the others apart best
            point = part[np.argmax(((part - part.mean(0)) ** 2).sum(1))]
            d = np.sqrt(((part - point) ** 2).sum(1))
            if d.max() > d.min():
                at, half = len(self.points), len(rows) // 2
                self.points.append(point)
                order = np.argpartition(d, half)
                for side in (order[:half], order[half:]):
                    self._grow(y, rows[side], [*path, (at, float(d[side].min()), float(d[side].max()))], leaf)
                return
        self.leaves.append((rows, path))

    def bounds(self, z: np.ndarray) -> np.ndarray:
        """Least possible distance of each query (row of z) to each leaf."""
        low = np.zeros((len(self.leaves), len(z)), np.float32)
        if self.points:
            v = np.stack(self.points)
            d2 = (z**2).sum(1)[None, :] + (v**2).sum(1)[:, None] - 2 * v @ z.T
            d = np.sqrt(np.maximum(d2, 0))
            for k, (_, path) in enumerate(self.leaves):
                for at, lo, hi in path:
                    np.maximum(low[k], np.maximum(lo - d[at], d[at] - hi), out=low[k])
        return low


def _exact(q: np.ndarray, x: np.ndarray, pos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x (in order of pos) and products of the k best of each query, in double precision, equal ones by rising position."""
    rows, found = np.full((len(q), k), -1, np.int64), np.full((len(q), k), -np.inf)
    x = x.astype(np.float64)
    step = max(1, 4_000_000 // max(1, len(x)))
    for a in range(0, len(q), step):
        s = q[a : a + step].astype(np.float64) @ x.T
        n = min(k, len(x))
        least = -np.partition(-s, n - 1, 1)[:, n - 1]
        r, c = np.nonzero(s >= least[:, None])  # columns come in order of pos
        order = np.lexsort((c, -s[r, c], r))
        r, c = r[order], c[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        r, c, nth = r[nth < n], c[nth < n], nth[nth < n]
        rows[a + r, nth], found[a + r, nth] = c, s[r, c]
    return rows, found


def search(
    q: np.ndarray, pos: np.ndarray, x: np.ndarray, k: int, factor: float = FACTOR, leaf: int = LEAF, band: int = BAND, floor: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Positions and inner products of the k best keys of each query, by falling product, then rising position.

    Fewer keys than k leave -1 behind the last. A position counts once. With factor 1 the result is exact. With a
    floor (one product for each query) only keys of that product at least are given.
    """
    # Equal vectors: beyond the k smallest positions none can be among the k best.
    pos, first = np.unique(pos, return_index=True)
    x = np.ascontiguousarray(x[first], np.float32) + np.float32(0)
    _, same = np.unique(x.view(f"V{4 * x.shape[1]}").ravel(), return_inverse=True)
    order = np.argsort(same, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(same[order]) > 0])
    nth = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    keep = np.sort(order[nth < k])
    pos, x = pos[keep], x[keep]

    q = q.astype(np.float32)
    wide = 2 * k  # kept in single precision; ranked in double at the end
    best = np.full((len(q), wide), -np.inf, np.float32)
    held = np.full((len(q), wide), -1, np.int64)
    qn = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    near = 1e-5 * qn * (float(norm.max()) if len(x) else 0.0)  # more than single precision can be wrong by
    low_at = np.full(len(q), -np.inf) if floor is None else np.asarray(floor, np.float64) - near

    def visit(rows: np.ndarray, some: np.ndarray) -> None:
        s = q[some] @ x[rows].T
        least = np.maximum(best[some].min(1), low_at[some])
        any_ = np.flatnonzero(s.max(1) > least)
        if not len(any_):
            return
        some, s = some[any_], s[any_]
        at = np.flatnonzero((s > least[any_][:, None]).ravel())
        if len(at) > FEW * len(some):
            all_s = np.concatenate([best[some], s], 1)
            at = np.argpartition(-all_s, wide - 1, 1)[:, :wide]
            all_i = np.concatenate([held[some], np.broadcast_to(rows, s.shape)], 1)
            best[some], held[some] = np.take_along_axis(all_s, at, 1), np.take_along_axis(all_i, at, 1)
            return
        # A few candidates per query: one after the other takes the place of the least kept, if it is better.
        r, c = at // s.shape[1], at % s.shape[1]
        score, to, key = s.ravel()[at], some[r], rows[c]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        for t in range(int(nth.max()) + 1):
            turn = np.flatnonzero(nth == t)
            least_at = best[to[turn]].argmin(1)
            turn, least_at = (z[score[turn] > best[to[turn], least_at]] for z in (turn, least_at))
            best[to[turn], least_at], held[to[turn], least_at] = score[turn], key[turn]

    def kth(some: np.ndarray | slice) -> np.ndarray:
        return np.maximum(-np.partition(-best[some], k - 1, 1)[:, k - 1], low_at[some])

    bands = []
    for rows in np.array_split(np.argsort(-norm, kind="stable"), max(1, -(-len(x) // band))):
        m = float(norm[rows].max()) if len(rows) else 0.0
        y = np.concatenate([x[rows], np.sqrt(np.maximum(m * m - norm[rows] ** 2, 0))[:, None]], 1).astype(np.float32)
        z = np.concatenate([q * (m / qn)[:, None], np.zeros((len(q), 1))], 1).astype(np.float32)
        tree = Tree(y, leaf)
        bands.append((rows, m, tree, tree.bounds(z)))
    if floor is None:
        # First each query's most promising leaf of every band, so that the bounds bite from the start.
        for rows, _, tree, low in bands:
            most = low.argmin(0)
            for n in range(len(tree.leaves)):
                some = np.flatnonzero(most == n)
                if len(some):
                    visit(rows[tree.leaves[n][0]], some)
            low[most, np.arange(len(q))] = np.inf
    for rows, m, tree, low in bands:
        for n in np.argsort(low.mean(1)):
            c = kth(slice(None))
            reach = np.sqrt(np.maximum(2 * m * m - 2 * m * c / qn, 0)) * factor
            slack = 1e-3 * m  # single precision
            some = np.flatnonzero((low[n] <= reach + slack) & (low[n] < np.inf) & (qn * m >= c - slack))
            if len(some):
                visit(rows[tree.leaves[n][0]], some)
    exact = np.einsum("qd,qkd->qk", q.astype(np.float64), x[np.maximum(held, 0)].astype(np.float64))
    exact = np.where(held < 0, -np.inf, exact)
    # More keys may be level with the k-th than were kept: these queries see all keys again.
    tied = np.flatnonzero(best.min(1) >= kth(slice(None)) - near)
    out = np.where(held < 0, -1, pos[np.maximum(held, 0)])
    order = np.lexsort((out, -exact), axis=1)[:, :k]
    out, exact = np.take_along_axis(out, order, 1), np.take_along_axis(exact, order, 1)
    if len(tied):
        rows, s = _exact(q[tied], x, pos, k)
        out[tied], exact[tied] = np.where(rows < 0, -1, pos[np.maximum(rows, 0)]), s
    if floor is not None:
        out = np.where(exact >= floor[:, None], out, -1)
    return out, exact


def usable(v: Column, dim: int) -> Column:
    """dim finite numbers, not all zero."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == dim) & whole & F.exists(v, lambda x: x != 0)


def _matrix(c: pa.ChunkedArray, dim: int) -> np.ndarray:
    a = c.combine_chunks()
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    return a.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def top_k(
    queries: DataFrame, keys: DataFrame, cell: list[str], query_id: str, query_vec: str, key_id: str, key_vec: str, dim: int,
    k: int = 10, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, key_id: for each usable query the k usable keys of its cell with the largest inner products.

    Usable: a vector of dim finite numbers that aren't all zero. A key counts once however often it was
    stored; equal products go by rising key_id; fewer keys than k give fewer rows. A query whose vector,
    id or cell is null, or whose cell has no usable key, has no row; a query given twice counts once.
    No cell is ever in one task: it is cut into shards of about shard_rows keys times blocks of about
    block_rows queries. Other columns are dropped. A query given with several vectors counts with the least.
    """
    spark = queries.sparkSession
    ensure_checkpoint_dir(spark)
    c = [f"c{i}" for i in range(len(cell))]
    named = [F.col(a).alias(b) for a, b in zip(cell, c)]
    kv = keys.where(usable(F.col(key_vec), dim) & F.col(key_id).isNotNull()).select(*named, F.col(key_id).cast("long").alias("i"), F.col(key_vec).cast("array<float>").alias("v"))
    qs = queries.where(usable(F.col(query_vec), dim) & F.col(query_id).isNotNull()).select(*named, F.col(query_id).cast("long").alias("i"), F.col(query_vec).cast("array<float>").alias("v"))
    # One small row per cell: in how many shards and blocks it is cut. Written once, as every use must cut alike.
    size = (
        kv.groupBy(*c).agg(F.count("*").alias("n")).join(qs.groupBy(*c).agg(F.count("*").alias("m")), c)
        .select(*c, F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"), F.ceil(F.col("m") / block_rows).cast("int").alias("blocks")).checkpoint()
    )
    tasks, most = size.agg(F.sum(F.col("shards") * F.col("blocks")), F.max("shards")).first()
    parts = int(min(2 * (tasks or 1), 20_000))
    upto = lambda n, a=0: F.explode(F.sequence(F.lit(a), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("i"), F.col(n)).cast("int")
    kv = kv.join(size, c).select(*c, "i", "v", part("shards").alias("shard"), upto("blocks").alias("block"))
    qs = qs.join(size, c).select(*c, "i", "v", "shards", part("blocks").alias("block"), F.lit(None).cast("double").alias("floor"))
    by = [*c, "shard", "block"]

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        none = pa.table({"i": pa.array([], pa.int64()), "p": pa.array([], pa.int64()), "s": pa.array([], pa.float64())})
        if not (q.num_rows and x.num_rows):
            return none
        ids, v = q.column("i").to_numpy(), _matrix(q.column("v"), dim)
        order = np.lexsort((*v.T[::-1], ids))
        order = order[np.r_[True, np.diff(ids[order]) != 0]]  # a query given twice
        ids, v = ids[order], v[order]
        floor = q.column("floor").to_numpy()[order] if q.column("floor").null_count == 0 else None
        p, s = search(v, x.column("i").to_numpy(), _matrix(x.column("v"), dim), k, factor, floor=floor)
        row, nth = np.nonzero(p >= 0)
        return pa.table({"i": pa.array(ids[row]), "p": pa.array(p[row, nth]), "s": pa.array(s[row, nth])})

    def searched(some: DataFrame, of: DataFrame) -> DataFrame:
        return some.repartition(parts, *by).groupBy(*by).cogroup(of.repartition(parts, *by).groupBy(*by)).applyInArrow(run, "i bigint, p bigint, s double")

    found = searched(qs.withColumn("shard", F.lit(0)).drop("shards"), kv.where("shard = 0"))
    if most and most > 1:
        found = found.checkpoint()
        # The k-th best of the first shard, for those queries that found k there.
        kth = found.groupBy("i").agg(F.min("s").alias("least"), F.count("*").alias("n")).select("i", F.when(F.col("n") >= k, F.col("least")).otherwise(F.lit(float("-inf"))).alias("floor"))
        later = qs.where("shards > 1").drop("floor").join(kth, "i", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
        later = later.select(*c, "i", "v", "block", "floor", upto("shards", 1).alias("shard"))
        found = found.unionByName(searched(later, kv.where("shard > 0")))
    # Ranked on both sides of the exchange: no list of all hits of a query is ever made.
    place = F.row_number().over(Window.partitionBy("i").orderBy(F.desc("s"), "p"))
    best = found.withColumn("place", place).where(F.col("place") <= k)
    return best.select(F.col("i").alias(query_id), F.col("p").alias(key_id), F.col("s").alias("score"))
