"""Searches of a stated set of queries against all keys, in blocks; softmax attention over what they score.

A cell's keys are spread over shards of bounded size and its queries over blocks; every pair of a shard and
a block is one group of a cogroup, scored as a matrix product. What leaves a group is small and mergeable:
its best k, or the state (m, D, N) of its softmax.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import vec
from vecloom.sources import partitions_for

SHARD_ROWS, BLOCK_ROWS = 32_768, 4096


def matrix(c: pa.ChunkedArray) -> np.ndarray:
    a = c.combine_chunks()
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    flat = a.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(a), -1) if len(a) else flat.reshape(0, 1)


def by_blocks(queries: DataFrame, keys: DataFrame, cell: list[str], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """run(queries, keys) for each block of queries and shard of keys of a cell.

    queries have q_row and q, keys pos, key and value. Cells that only one side has are left out; cells
    with a null in their name never match.
    """
    n = keys.groupBy(*cell).agg(F.count("*").alias("n")).join(queries.groupBy(*cell).agg(F.count("*").alias("m")), cell)
    size = n.select(*cell, F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"), F.ceil(F.col("m") / block_rows).cast("int").alias("blocks"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda of, c: F.pmod(F.xxhash64(of), F.col(c)).cast("int")
    kv = keys.join(size, cell).select(*cell, "pos", "key", "value", part("pos", "shards").alias("shard"), upto("blocks").alias("block"))
    qs = queries.join(size, cell).select(*cell, "q_row", "q", part("q_row", "blocks").alias("block"), upto("shards").alias("shard"))
    by = [*cell, "shard", "block"]
    parts = partitions_for(queries, keys)
    return qs.repartition(parts, *by).groupBy(*by).cogroup(kv.repartition(parts, *by).groupBy(*by)).applyInArrow(run, schema)


def exact_top_k(queries: DataFrame, keys: DataFrame, cell: list[str], k: int, **sizes: int) -> DataFrame:
    """q_row, rank, pos, score: the k keys of largest inner product, ties by rising position; exact."""

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        pos, ids = x.column("pos").to_numpy(), q.column("q_row").to_numpy()
        if not (len(pos) and len(ids)):
            return pa.table({"q_row": pa.array([], pa.int64()), "pos": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        s = matrix(q.column("q")) @ matrix(x.column("key")).T
        n = min(k, len(pos))
        least = -np.partition(-s, n - 1, 1)[:, n - 1]
        row, col = np.nonzero(s >= least[:, None])  # ties at the edge stay in until the merge
        order = np.lexsort((pos[col], -s[row, col], row))
        row, col = row[order], col[order]
        first = np.searchsorted(row, row)
        keep = np.arange(len(row)) - first < n
        row, col = row[keep], col[keep]
        return pa.table({"q_row": pa.array(ids[row]), "pos": pa.array(pos[col]), "score": pa.array(s[row, col])})

    near = by_blocks(queries, keys, cell, run, "q_row bigint, pos bigint, score double", **sizes)
    return top_k(near, ["q_row"], k)


def chunked_top_k(queries: DataFrame, keys: DataFrame, cell: list[str], chunk: int, k: int, **sizes: int) -> DataFrame:
    """q_row, rank, pos, score: the k best of every chunk of positions, merged; each chunk is cut where it is scored."""

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        pos, ids = x.column("pos").to_numpy(), q.column("q_row").to_numpy()
        rows, cols, best = [], [], []
        if len(pos) and len(ids):
            order = np.argsort(pos)
            pos = pos[order]
            s = matrix(q.column("q")) @ matrix(x.column("key"))[order].T
            for own in np.split(np.arange(len(pos)), np.flatnonzero(np.diff(pos // chunk)) + 1):
                n = min(k, len(own))
                at = np.argsort(-s[:, own], axis=1, kind="stable")[:, :n]
                rows.append(np.repeat(ids, n))
                cols.append(pos[own][at].ravel())
                best.append(np.take_along_axis(s[:, own], at, 1).ravel())
        join = lambda v, t: pa.array(np.concatenate(v).astype(t) if v else np.zeros(0, t))
        return pa.table({"q_row": join(rows, np.int64), "pos": join(cols, np.int64), "score": join(best, np.float64)})

    found = by_blocks(queries, keys, cell, run, "q_row bigint, pos bigint, score double", **sizes)
    merged = top_k(found.withColumn("chunk", F.floor(F.col("pos") / chunk)), ["q_row", "chunk"], k).drop("rank")
    return top_k(merged, ["q_row"], k)


def retriever(kind: str, k: int = 16, nprobe: int = 8, lists: int = 16, centroids: DataFrame | None = None, assigned: DataFrame | None = None) -> Callable[[DataFrame, DataFrame, list[str]], DataFrame]:
    """A function of (queries, keys, cell) that returns q_row, rank, pos, score, chosen by name.

    "exact": the k best of all keys; "full": all keys in order; "ivf": the k best in the nprobe nearest of the inverted lists
    (of the given centroids and assignment, else of `lists` sampled ones). Any other name is refused.
    """
    if kind == "exact":
        return lambda q, kv, cell: exact_top_k(q, kv, cell, k)
    if kind == "full":
        rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), "pos"))
        return lambda q, kv, cell: scores(q, kv, cell).select("q_row", rank.alias("rank"), "pos", "score")
    if kind == "ivf":

        def search_lists(q: DataFrame, kv: DataFrame, cell: list[str]) -> DataFrame:
            cents = centroids if centroids is not None else sample_centroids(kv, cell, lists)
            return ivf_top_k(q, assigned if assigned is not None else nearest_centroid(kv, cents, cell), cents, cell, k, nprobe)

        return search_lists
    raise ValueError(f"no retriever is called {kind!r}: exact, full or ivf")


def top_k(scored: DataFrame, by: list[str], k: int, score: str = "score", pos: str = "pos") -> DataFrame:
    """by, rank, pos, score: the k largest scores of each group, ties by rising position."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), pos))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select(*by, "rank", pos, score)


def scores(queries: DataFrame, keys: DataFrame, cell: list[str], **sizes: int) -> DataFrame:
    """q_row, pos, score of every query and key of its cell."""

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        pos, ids = x.column("pos").to_numpy(), q.column("q_row").to_numpy()
        s = (matrix(q.column("q")) @ matrix(x.column("key")).T).ravel() if len(pos) and len(ids) else np.zeros(0)
        return pa.table({"q_row": pa.array(np.repeat(ids, len(pos)).astype(np.int64)), "pos": pa.array(np.tile(pos, len(ids)).astype(np.int64)), "score": pa.array(s)})

    return by_blocks(queries, keys, cell, run, "q_row bigint, pos bigint, score double", **sizes)


def softmax_states(queries: DataFrame, keys: DataFrame, cell: list[str], scaling: float, causal: bool = False, **sizes: int) -> DataFrame:
    """q_row, m, d, n of each shard: the largest logit, the sum of e^(logit - m), and the values summed with those weights.

    causal: the last number of a query and of a key is its time; keys later than the query don't count, and a query
    that sees no key of a shard has no row for it.
    """

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        ids = q.column("q_row").to_numpy()
        if not (x.num_rows and len(ids)):
            return pa.table({"q_row": pa.array([], pa.int64()), "m": pa.array([], pa.float64()), "d": pa.array([], pa.float64()), "n": pa.array([], pa.list_(pa.float64()))})
        a, b = matrix(q.column("q")), matrix(x.column("key"))
        if causal:
            s = np.where(b[None, :, -1] <= a[:, None, -1], a[:, :-1] @ b[:, :-1].T * scaling, -np.inf)
            seen = np.isfinite(s).any(1)
            s, ids = s[seen], ids[seen]
        else:
            s = a @ b.T * scaling
        m = s.max(1)
        w = np.exp(s - m[:, None])
        return pa.table({"q_row": pa.array(ids), "m": pa.array(m), "d": pa.array(w.sum(1)), "n": pa.array(list(w @ matrix(x.column("value"))), pa.list_(pa.float64()))})

    return by_blocks(queries, keys, cell, run, "q_row bigint, m double, d double, n array<double>", **sizes)


def merge_states(states: DataFrame, by: list[str], dim: int) -> DataFrame:
    """by, lse, out: the softmax states of a group merged. Associative: any split of the keys gives the same."""
    top = states.withColumn("top", F.max("m").over(Window.partitionBy(*by)))
    w = F.exp(F.col("m") - F.col("top"))
    sums = top.groupBy(*by).agg(F.first("top").alias("top"), F.sum(F.col("d") * w).alias("d"), *[F.sum(F.col("n")[i] * w).alias(f"n{i}") for i in range(dim)])
    return sums.select(*by, (F.col("top") + F.log("d")).alias("lse"), F.array(*[F.col(f"n{i}") / F.col("d") for i in range(dim)]).alias("out"))


def full_attention(queries: DataFrame, keys: DataFrame, cell: list[str], scaling: float, dim: int, **sizes: int) -> DataFrame:
    """q_row, lse, out over all keys of the cell. A query whose cell has no key has no row."""
    return merge_states(softmax_states(queries, keys, cell, scaling, **sizes), ["q_row"], dim)


def attend(rows: DataFrame, by: list[str], dim: int, logit: str = "logit", value: str = "value") -> DataFrame:
    """by, lse, out, boundary, n: softmax attention over the scored rows of each group; boundary is its least logit."""
    top = rows.withColumn("top", F.max(logit).over(Window.partitionBy(*by)))
    w = F.exp(F.col(logit) - F.col("top"))
    sums = top.groupBy(*by).agg(F.first("top").alias("top"), F.sum(w).alias("d"), F.min(logit).alias("boundary"), F.count("*").alias("n"), *[F.sum(F.col(value)[i] * w).alias(f"n{i}") for i in range(dim)])
    return sums.select(*by, (F.col("top") + F.log("d")).alias("lse"), F.array(*[F.col(f"n{i}") / F.col("d") for i in range(dim)]).alias("out"), "boundary", "n")


def merge_partitions(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """by, lse, out: two attention partitions (lse, out) merged; a group that only one has passes through."""
    x, y = a.select(*by, F.col("lse").alias("lse_a"), F.col("out").alias("out_a")), b.select(*by, F.col("lse").alias("lse_b"), F.col("out").alias("out_b"))
    both = x.join(y, by, "full")
    lse = F.when(F.col("lse_a").isNull(), F.col("lse_b")).when(F.col("lse_b").isNull(), F.col("lse_a")).otherwise(vec.logaddexp(F.col("lse_a"), F.col("lse_b")))
    out = F.when(F.col("lse_a").isNull(), F.col("out_b")).when(F.col("lse_b").isNull(), F.col("out_a")).otherwise(vec.merge_out(F.col("out_a"), F.col("lse_a"), F.col("out_b"), F.col("lse_b")))
    return both.select(*by, lse.alias("lse"), out.alias("out"))


def exploded(rows: DataFrame, by: list[Column | str], array: str = "out", name: str = "out") -> DataFrame:
    """One row for each number of an array: its place i and the number."""
    return rows.select(*by, F.posexplode(array).alias("i", name))


# ------------------------------------------------------------------ approximate search


def sample_centroids(keys: DataFrame, cell: list[str], c: int) -> DataFrame:
    """cell, cid, centroid: the c keys of each cell whose position has the least MD5."""
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(F.md5(F.col("pos").cast("string").cast("binary")), "pos"))
    return keys.withColumn("cid", rank - 1).where(F.col("cid") < c).select(*cell, "cid", F.col("key").alias("centroid"))


def nearest_centroid(keys: DataFrame, cents: DataFrame, cell: list[str]) -> DataFrame:
    """keys with cid, the nearest centroid of their cell by Euclidean distance, ties to the smaller number.

    The centroids of a cell travel as one array row: at most c vectors, joined by the cell.
    """
    packed = cents.groupBy(*cell).agg(F.sort_array(F.collect_list(F.struct("cid", "centroid"))).alias("cents"))
    both = keys.join(packed, cell)

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            cents_of: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
            out = np.zeros(t.num_rows, np.int64)
            if t.num_rows:
                x = matrix(t.column("key"))
                names = list(zip(*[t.column(c).to_pylist() for c in cell]))
                groups: dict[tuple, list[int]] = {}
                for i, n in enumerate(names):
                    groups.setdefault(n, []).append(i)
                for n, rows in groups.items():
                    if n not in cents_of:
                        got = t.column("cents")[rows[0]].as_py()
                        cents_of[n] = np.array([g["cid"] for g in got]), np.array([g["centroid"] for g in got])
                    ids, m = cents_of[n]
                    d = ((x[rows][:, None, :] - m[None, :, :]) ** 2).sum(2)
                    out[rows] = ids[d.argmin(1)]
            made = t.drop_columns(["cents"]).append_column("cid", pa.array(out.astype(np.int32)))
            yield from made.combine_chunks().to_batches()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys.schema) + ", cid int"
    return both.select(*keys.columns, "cents").mapInArrow(run, schema)


def k_means(keys: DataFrame, cell: list[str], c: int, iters: int, fit_rows: int) -> DataFrame:
    """cell, cid, centroid after Lloyd's iterations on a bounded sample of each cell.

    The sample are the fit_rows keys of least MD5 of their position (up to 1000 are cut in each task, before the
    shuffle); a cluster that becomes empty keeps its
    centroid. Each iteration is one job over the sample and ends in a checkpoint of the centroids.
    """
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(F.md5(F.col("pos").cast("string").cast("binary")), "pos"))
    sample = keys.withColumn("r", rank).where(F.col("r") <= fit_rows).drop("r").checkpoint()
    cents = sample_centroids(sample, cell, c)
    for _ in range(iters):
        flat = nearest_centroid(sample, cents, cell).select(*cell, "cid", F.posexplode("key").alias("i", "x"))
        mean = flat.groupBy(*cell, "cid", "i").agg(F.avg("x").alias("x")).groupBy(*cell, "cid").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
        mean = mean.select(*cell, "cid", F.transform("v", lambda s: s["x"]).alias("moved"))
        cents = cents.join(mean, [*cell, "cid"], "left").select(*cell, "cid", F.coalesce("moved", "centroid").alias("centroid")).checkpoint()
    return cents


def probe(queries: DataFrame, cents: DataFrame, cell: list[str]) -> DataFrame:
    """q_row, cid, probe: the centroids of a query's cell in order of falling inner product, from 1."""
    both = queries.join(cents, cell).withColumn("s", vec.dot(F.col("q"), F.col("centroid")))
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("s"), "cid"))
    return both.select("q_row", "cid", rank.alias("probe"))


def ivf_top_k(queries: DataFrame, assigned: DataFrame, cents: DataFrame, cell: list[str], k: int, nprobe: int) -> DataFrame:
    """q_row, rank, pos, score: the k best keys in the nprobe lists nearest to a query. With all lists it is exact."""
    chosen = probe(queries, cents, cell).where(F.col("probe") <= nprobe)
    asked = queries.join(chosen, "q_row").select(*cell, "cid", "q_row", "q")
    return exact_top_k(asked, assigned, [*cell, "cid"], k)


def recall(found: DataFrame, exact: DataFrame, by: list[str], groups: DataFrame | None = None) -> DataFrame:
    """by, recall: the share of a group's exact positions that were found. Of the stated groups those without an exact row have 1."""
    hit = exact.select(*by, "pos").join(found.select(*by, "pos", F.lit(1).alias("hit")).distinct(), [*by, "pos"], "left")
    out = hit.groupBy(*by).agg((F.count("hit") / F.count("*")).alias("recall"))
    return out if groups is None else groups.select(*by).distinct().join(out, by, "left").withColumn("recall", F.coalesce("recall", F.lit(1.0)))
