"""Correction for the mass that retrieval drops: moments, mass estimate, stand-in, cuts, fits, gate.

A query keeps its best keys; the rest, the tail, is replaced by one pseudo-key: its mass is estimated from
the moments of the cell's keys, its value by a ridge map of the query's direction. All fits are sums over
rows that are added up in the tasks first; what is solved at last has a fixed size per cell and cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import vec
from vecloom.functions.special import log_ndtr_col
from vecloom.operators.search import SHARD_ROWS, by_blocks, exact_top_k, matrix, merge_partitions, merge_states, scores, softmax_states

#: The grid of the mass factor, 0 to 1.5 in steps of 0.05.
ALPHAS = [round(i * 0.05, 2) for i in range(31)]
#: Tolerances of the comparison of recomputed with recorded outputs (median, p99).
SANITY = (2.5e-3, 1e-2)


def _group_sums(df: DataFrame, cell: list[str], parts, width: int) -> DataFrame:
    """cell, i, x: sums by cell of the rows of parts(table) (one vector of `width` per row), added up in the tasks."""
    types = {c: df.schema[c].dataType.simpleString() for c in cell}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            names = list(zip(*[t.column(c).to_pylist() for c in cell]))
            groups: dict[tuple, list[int]] = {}
            for k, n in enumerate(names):
                groups.setdefault(n, []).append(k)
            for n, rows in groups.items():
                v = parts(t.take(pa.array(rows)))
                sums[n] = sums[n] + v if n in sums else v
        for n, v in sums.items():
            cols = [pa.array([x] * width, schema_of[c]) for x, c in zip(n, cell)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.arange(width, dtype=np.int32)), pa.array(v)], [*cell, "i", "x"])

    schema_of = {c: {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[t] for c, t in types.items()}
    made = df.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in types.items()) + ", i int, x double")
    return made.groupBy(*cell, "i").agg(F.sum("x").alias("x"))


def moments(keys: DataFrame, cell: list[str], dim: int) -> DataFrame:
    """cell, n_keys, mean, cov: mean and population covariance (E[kk'] - mm') of each cell's keys."""

    def parts(t: pa.Table) -> np.ndarray:
        x = matrix(t.column("key"))
        return np.concatenate([[float(len(x))], x.sum(0), (x.T @ x).ravel()])

    sums = _group_sums(keys, cell, parts, 1 + dim + dim * dim)
    v = F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    packed = sums.groupBy(*cell).agg(v.alias("v"))
    n = F.col("v")[0]
    mean = F.transform(F.slice("v", 2, dim), lambda x: x / n)
    row = lambda i: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda j: F.element_at("v", F.lit(2 + dim) + i * dim + j) / n - F.element_at("v", F.lit(2) + i) / n * (F.element_at("v", F.lit(2) + j) / n))
    return packed.select(*cell, n.cast("bigint").alias("n_keys"), mean.alias("mean"), F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), row).alias("cov"))


def mass_terms(q: Column, mean: Column, cov: Column, scaling: float) -> tuple[Column, Column]:
    """Mean and variance of a query's logits over keys of that mean and covariance."""
    return vec.dot(q, mean) * scaling, vec.dot(q, vec.matvec(cov, q)) * scaling * scaling


def mass_base(mu: Column, var: Column, n_keys: Column) -> Column:
    """ln n + mu + var / 2: the log mass of all keys; minus infinity without keys."""
    return F.when(n_keys <= 0, vec.neg_inf()).otherwise(F.log(n_keys) + mu + var / 2)


def tail_mass(mu: Column, var: Column, n_keys: Column, boundary: Column) -> Column:
    """Log mass of the keys below the boundary: the base times the part of the tilted normal below it.

    Without variance there is no truncation; without keys, or if the result isn't finite, it is minus infinity.
    """
    sigma = F.sqrt(F.greatest(var, F.lit(0.0)))
    z = (boundary - mu - var) / F.when(sigma > 0, sigma).otherwise(1.0)
    out = mass_base(mu, var, n_keys) + F.when(sigma > 0, log_ndtr_col(z)).otherwise(0.0)
    return F.when(out.isNull() | F.isnan(out) | (F.abs(out) == F.lit(float("inf"))), vec.neg_inf()).otherwise(out)


def standin(q: Column, weight: Column, bias: Column, scale: Column) -> Column:
    """The tail's value: the mapped direction of the query, of length scale."""
    return vec.scale(vec.unit(vec.add(vec.matvec(weight, vec.unit(q)), bias)), scale)


def combine(n_top: Column, d_top: Column, u: Column, z: Column) -> Column:
    """(N + Z u) / (D + Z); with no mass the kept part as it is."""
    return F.when(z > 0, vec.scale(vec.add(n_top, vec.scale(u, z)), 1 / (d_top + z))).otherwise(vec.scale(n_top, 1 / d_top))


def _ordered(s: np.ndarray, k: int) -> np.ndarray:
    """The k first columns of each row by falling value, equal ones by rising column."""
    n = s.shape[1]
    if 4 * k >= n:
        return np.argsort(-s, axis=1, kind="stable")[:, :k]
    some = np.argpartition(-s, k - 1, axis=1)[:, :k]
    v = np.take_along_axis(s, some, 1)
    tied = np.flatnonzero((s >= v.min(1)[:, None]).sum(1) > k)  # equal values on both sides of the edge
    if len(tied):
        some[tied] = np.argsort(-s[tied], axis=1, kind="stable")[:, :k]
        v = np.take_along_axis(s, some, 1)
    return np.take_along_axis(some, np.lexsort((some, -v), axis=1), 1)


def apply(rows: DataFrame, live: DataFrame) -> DataFrame:
    """q_row, lse, out: the kept keys of each query, with the tail where its head is active, merged with the live part.

    rows have q_row, m, dt, nt, uh, z, alpha and active. A row that isn't active, or has no stand-in, passes through
    untouched. Queries that only live has are kept.
    """
    on = F.coalesce(F.col("active") & F.col("uh").isNotNull() & F.col("z").isNotNull() & (F.coalesce("alpha", F.lit(1.0)) > 0), F.lit(False))
    mass = F.when(on, F.col("z") * F.coalesce("alpha", F.lit(1.0)))
    kept_lse, kept = F.col("m") + F.log("dt"), vec.scale(F.col("nt"), 1 / F.col("dt"))
    part = rows.select("q_row", F.when(on, F.col("m") + F.log(F.col("dt") + mass)).otherwise(kept_lse).alias("lse"), F.when(on, combine(F.col("nt"), F.col("dt"), F.col("uh"), mass)).otherwise(kept).alias("out"))
    return merge_partitions(part, live, ["q_row"]).select("q_row", "lse", "out")


def cut_statistics(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, cut and the twelve statistics of a cut, from scored rows (train, u, uh, pred, z, d, dt, none_err, err).

    Held-out rows: mean and 90th percentile of the error with the tail, mean without, how often worse, phi (the share of
    the mass that is dropped), r2 of the map over the training mean of directions, the median ratio of masses and cosine;
    const is the squared length of that mean, leftover (1 - const)(1 - r2), pred phi times its root.
    """
    dim = F.size("u")
    rows = rows.where(F.col("u").isNotNull()).withColumn("un", vec.unit(F.col("u")))
    flat = rows.where("train").select(*by, "cut", F.posexplode("un").alias("i", "x")).groupBy(*by, "cut", "i").agg(F.avg("x").alias("x"))
    mean = flat.groupBy(*by, "cut").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("mean_dir"))  # one number per dimension
    held = rows.where("not train").join(mean, [*by, "cut"])
    sq = lambda a, b: vec.let(vec.sub(a, b), lambda v: vec.dot(v, v))
    left = F.col("d") - F.col("dt")
    out = held.where(dim > 0).groupBy(*by, "cut").agg(
        F.avg("err").alias("err_mean"), F.percentile("err", 0.9).alias("err_p90"), F.avg("none_err").alias("none_mean"), F.avg((F.col("err") > F.col("none_err")).cast("double")).alias("worse"), F.avg(left / F.col("d")).alias("phi"),
        F.first(vec.dot(F.col("mean_dir"), F.col("mean_dir"))).alias("const"), (1 - F.sum(sq(F.col("un"), F.col("pred"))) / F.sum(sq(F.col("un"), F.col("mean_dir")))).alias("r2"),
        F.percentile(F.col("z") / left, 0.5).alias("mass_ratio"), F.percentile(vec.cosine(F.col("uh"), F.col("u")), 0.5).alias("cos_median"), (F.avg("err") / F.avg("none_err")).alias("ratio"),
    )
    out = out.withColumn("leftover", (1 - F.col("const")) * (1 - F.col("r2")))
    return out.withColumn("pred", F.col("phi") * F.sqrt("leftover"))


def cut_scan(queries: DataFrame, keys: DataFrame, cell: list[str], cuts: list[int], scaling: float, dim: int, least: int = 1, by_hash: bool = False, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """q_row, cut, m, bnd, dt, nt, d, exact: softmax sums over the best `cut` keys of each query and over all, in one scan.

    All sums are relative to the query's best logit m. bnd is the weakest logit kept, dt and nt the mass and the weighted
    values of the kept keys, d the mass of all, exact their output. Cuts beyond the number of keys are left out,
    those up to `least` keep all keys. by_hash takes the keys by the MD5 of their position in place of their score.
    Only a row per query and cut leaves a block; cells of several shards are ranked over all shards instead and
    summed between cuts.
    """
    cuts = sorted(set(cuts))

    def run(q: pa.Table, x: pa.Table) -> pa.Table:
        ids, pos = q.column("q_row").to_numpy(), x.column("pos").to_numpy()
        parts: list[list[np.ndarray]] = [[] for _ in range(8)]
        some = [c for c in cuts if c <= max(len(pos), least)] if len(pos) and len(ids) else []
        if some:
            o = np.argsort(pos)
            key, value, qv = matrix(x.column("key"))[o], matrix(x.column("value"))[o], matrix(q.column("q"))
            at = np.minimum(np.array(some), len(pos)) - 1
            k = int(at.max()) + 1
            if by_hash:
                digest = [(hashlib.md5(str(v).encode()).hexdigest(), v) for v in pos[o].tolist()]
                chosen = np.array(sorted(range(len(digest)), key=digest.__getitem__))[:k]
            step = max(1, 1_000_000 // max(k, len(pos) // 8))
            for a in range(0, len(ids), step):
                s = qv[a : a + step] @ key.T * scaling
                m = s.max(1)
                w = np.exp(s - m[:, None])
                d = w.sum(1)
                top = np.broadcast_to(chosen, (len(s), k)) if by_hash else _ordered(s, k)
                wt = np.take_along_axis(w, top, 1)
                nt = np.cumsum(wt[:, :, None] * value[top], 1)[:, at]
                bnd = np.minimum.accumulate(np.take_along_axis(s, top, 1), 1)[:, at]
                n = len(at)
                made = [np.repeat(ids[a : a + step], n), np.tile(some, len(s)), np.repeat(m, n), bnd.ravel(), np.cumsum(wt, 1)[:, at].ravel(), nt.reshape(-1, dim), np.repeat(d, n), np.repeat(w @ value / d[:, None], n, 0)]
                for got, v in zip(parts, made):
                    got.append(v)
        names = ["q_row", "cut", "m", "bnd", "dt", "nt", "d", "exact"]
        flat = [np.concatenate(v) if v else np.zeros((0, dim) if c in ("nt", "exact") else 0) for c, v in zip(names, parts)]
        lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, dim, dtype=np.int32)), pa.array(v.ravel().astype(np.float64)))
        types = {"q_row": np.int64, "cut": np.int32}
        return pa.table({c: lists(v) if c in ("nt", "exact") else pa.array(v.astype(types.get(c, np.float64))) for c, v in zip(names, flat)})

    schema = "q_row bigint, cut int, m double, bnd double, dt double, nt array<double>, d double, exact array<double>"
    sizes = keys.groupBy(*cell).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    if most <= shard_rows:
        return by_blocks(queries, keys, cell, run, schema, shard_rows=shard_rows)
    small = keys.join(sizes.where(F.col("_n") <= shard_rows), cell, "left_semi")
    large = keys.join(sizes.where(F.col("_n") > shard_rows), cell, "left_semi")
    return by_blocks(queries, small, cell, run, schema, shard_rows=shard_rows).unionByName(_cut_scan_large(queries, large, cell, cuts, scaling, dim, by_hash, shard_rows, sizes, least))


def _cut_scan_large(queries: DataFrame, keys: DataFrame, cell: list[str], cuts: list[int], scaling: float, dim: int, by_hash: bool, shard_rows: int, sizes: DataFrame, least: int) -> DataFrame:
    """cut_scan of cells of several shards: the best max(cuts) keys of all shards, summed between neighbouring cuts, then added up."""
    k = cuts[-1]
    if by_hash:
        rank = F.row_number().over(Window.partitionBy(*cell).orderBy(F.md5(F.col("pos").cast("string").cast("binary")), "pos"))
        some = keys.withColumn("rank", rank).where(F.col("rank") <= k)
        top = scores(queries, some, cell, shard_rows=shard_rows).join(queries.select("q_row", *cell), "q_row").join(some.select(*cell, "pos", "rank", "value"), [*cell, "pos"])
    else:
        top = exact_top_k(queries, keys, cell, k, shard_rows=shard_rows).join(queries.select("q_row", *cell), "q_row").join(keys.select(*cell, "pos", "value"), [*cell, "pos"])
    full = softmax_states(queries, keys, cell, scaling, shard_rows=shard_rows)
    best = full.groupBy("q_row").agg(F.max("m").alias("m"))
    whole = merge_states(full, ["q_row"], dim).join(best, "q_row").select("q_row", "m", F.exp(F.col("lse") - F.col("m")).alias("d"), F.col("out").alias("exact"))
    cut = F.array_min(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c >= F.col("rank")))
    rows = top.select("q_row", "rank", (F.col("score") * scaling).alias("logit"), "value").join(best, "q_row").withColumn("cut", cut)
    w = F.exp(F.col("logit") - F.col("m"))
    between = rows.groupBy("q_row", "cut").agg(F.min("logit").alias("bnd"), F.sum(w).alias("dt"), *[F.sum(w * F.col("value")[i]).alias(f"n{i}") for i in range(dim)])
    upto = Window.partitionBy("q_row").orderBy("cut").rowsBetween(Window.unboundedPreceding, 0)  # one row per cut
    sums = between.select("q_row", "cut", F.min("bnd").over(upto).alias("bnd"), F.sum("dt").over(upto).alias("dt"), F.array(*[F.sum(f"n{i}").over(upto) for i in range(dim)]).alias("nt"))
    fits = queries.select("q_row", *cell).join(sizes, cell).select("q_row", "_n")
    out = sums.join(whole, "q_row").join(fits, "q_row").where(F.col("cut") <= F.greatest("_n", F.lit(least)))
    return out.select("q_row", "cut", "m", "bnd", "dt", "nt", "d", "exact")


def kept_error() -> Column:
    """Error of the kept keys alone, in the rows of cut_scan."""
    return vec.rel_err(vec.scale(F.col("nt"), 1 / F.col("dt")), F.col("exact"))


def true_tail(rows: DataFrame) -> DataFrame:
    """rows with u, the mean value of the dropped keys; null where nothing is dropped."""
    left = F.col("d") - F.col("dt")
    u = vec.scale(vec.sub(vec.scale(F.col("exact"), F.col("d")), F.col("nt")), 1 / left)
    return rows.withColumn("u", F.when(left > 1e-12 * F.col("d"), u))


def ridge_map(rows: DataFrame, by: list[str], dim_q: int, dim_v: int, ridge: float) -> DataFrame:
    """by, weight, bias, scale, rows: the ridge map from a query's direction to the direction of its tail.

    rows have q and u. The Gram sums are added up in the tasks; per group one system of dim_q + 1 unknowns
    is solved. scale is the median length of u. A row whose u is null doesn't count.
    """
    a = dim_q + 1
    train = rows.where(F.col("u").isNotNull()).withColumn("qh", vec.unit(F.col("q"))).withColumn("uh", vec.unit(F.col("u")))

    def parts(t: pa.Table) -> np.ndarray:
        x = np.concatenate([matrix(t.column("qh")), np.ones((t.num_rows, 1))], 1)
        return np.concatenate([[float(t.num_rows)], (x.T @ x).ravel(), (x.T @ matrix(t.column("uh"))).ravel()])

    sums = _group_sums(train.select(*by, "qh", "uh"), by, parts, 1 + a * a + a * dim_v)

    def solve(p: pd.DataFrame) -> pd.DataFrame:
        v = p.sort_values("i")["x"].to_numpy()
        xx, xy = v[1 : 1 + a * a].reshape(a, a), v[1 + a * a :].reshape(a, dim_v)
        b = np.linalg.solve(xx + ridge * np.trace(xx) / a * np.eye(a), xy)
        return pd.DataFrame([[*p.iloc[0][by], b[:dim_q].T.tolist(), b[dim_q].tolist(), int(v[0])]], columns=[*by, "weight", "bias", "rows"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in by)
    maps = sums.groupBy(*by).applyInPandas(solve, f"{kinds}, weight array<array<double>>, bias array<double>, rows bigint")
    return maps.join(train.groupBy(*by).agg(F.percentile(vec.norm(F.col("u")), 0.5).alias("scale")), by)


def query_terms(queries: DataFrame, moms: DataFrame, cell: list[str], scaling: float) -> DataFrame:
    """q_row, mu, var, n_keys: what a query's tail mass needs of its cell's moments, once per query whatever the cuts."""
    both = queries.join(moms, cell)
    mu, var = mass_terms(F.col("q"), F.col("mean"), F.col("cov"), scaling)
    return both.select("q_row", mu.alias("mu"), var.alias("var"), "n_keys")


def scored_tail(rows: DataFrame, maps: DataFrame, terms: DataFrame, cell: list[str]) -> DataFrame:
    """rows (cell, cut, q, m, bnd, dt, nt, exact) with uh, the stand-in, and z, the estimated mass relative to m.

    A row whose cell and cut have no map keeps a null uh and z: nothing is known of its tail.
    """
    both = rows.join(maps, [*cell, "cut"], "left").join(terms, "q_row")
    ln_z = tail_mass(F.col("mu"), F.col("var"), F.col("n_keys"), F.col("bnd"))
    pred = vec.add(vec.matvec(F.col("weight"), vec.unit(F.col("q"))), F.col("bias"))
    both = both.withColumn("pred", pred).withColumn("z", F.when(F.col("weight").isNotNull(), F.exp(ln_z - F.col("m"))))
    return both.withColumn("uh", vec.scale(vec.unit(F.col("pred")), F.col("scale"))).drop("weight", "bias", "mean", "cov")


def with_alpha(rows: DataFrame, alpha: Column) -> Column:
    """Error of the corrected output, its mass scaled by alpha."""
    return vec.rel_err(combine(F.col("nt"), F.col("dt"), F.col("uh"), F.col("z") * alpha), F.col("exact"))


def fit_alpha(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, alpha, err: the grid value of least mean error, the smaller one on ties."""
    each = rows.withColumn("alpha", F.explode(F.array(*[F.lit(a) for a in ALPHAS])))
    mean = each.groupBy(*by, "alpha").agg(F.avg(with_alpha(each, F.col("alpha"))).alias("err"))
    return mean.groupBy(*by).agg(F.min_by("alpha", F.struct("err", "alpha")).alias("alpha"), F.min("err").alias("err"))


def ratio_stats(err: Column, base: Column) -> list[Column]:
    """worse, ratio_med, ratio_p99, ratio_max of err / base over the rows in which err exceeds base; 1 if none does."""
    r = F.when(err > base, err / base)
    one = F.lit(1.0)
    return [
        F.avg((err > base).cast("double")).alias("worse"), F.coalesce(F.percentile(r, 0.5), one).alias("ratio_med"),
        F.coalesce(F.percentile(r, 0.99), one).alias("ratio_p99"), F.coalesce(F.max(r), one).alias("ratio_max"),
    ]


def choose_cut(stats: DataFrame, by: list[str], stat: str, eps: float) -> DataFrame:
    """by, cut, reached: the smallest cut whose statistic is at most eps, else the deepest."""
    ok = F.min(F.when(F.col(stat) <= eps, F.col("cut")))
    return stats.groupBy(*by).agg(F.coalesce(ok, F.max("cut")).alias("cut"), ok.isNotNull().alias("reached"))


def gate(stats: DataFrame, worse_tol: float, p99_tol: float) -> DataFrame:
    """stats (worse, ratio_p99, sanity_pass) with gate_pass and reason, all reasons joined by a semicolon."""
    why = F.concat_ws(
        "; ",
        F.when(~F.col("sanity_pass"), "sanity failed"),
        F.when(F.col("worse") > worse_tol, F.format_string("worse %.1f%% > %.0f%%", F.col("worse") * 100, F.lit(worse_tol * 100))),
        F.when(F.col("ratio_p99") > p99_tol, F.format_string("p99 %.2fx > %.1fx", F.col("ratio_p99"), F.lit(p99_tol))),
    )
    return stats.withColumn("reason", why).withColumn("gate_pass", F.col("reason") == "")


def status(cells: DataFrame, heads: DataFrame, by: list[str], n_retrieved: int) -> DataFrame:
    """cells with active and reason; the first that holds: no file, not validated, gated off, other n_retrieved, active."""
    h = heads.withColumn("file", F.lit(True))
    both = cells.join(h, by, "left")
    why = (
        F.when(F.col("file").isNull(), "no file").when(~F.col("gate_pass") & ~F.col("validated"), "not validated")
        .when(~F.col("gate_pass"), F.concat(F.lit("gated off: "), F.when(F.col("reason") == "", F.lit(None)).otherwise(F.col("reason"))))
        .when(F.col("n_retrieved") != n_retrieved, F.format_string("n_retrieved %d is not %d", "n_retrieved", F.lit(n_retrieved)))
    )
    return both.select(*by, why.isNull().alias("active"), why.alias("reason"))


def layer_summary(rows: DataFrame, measure: str) -> DataFrame:
    """layer, heads, active, keys_active, keys_off, off: of rows with layer, kv_head, active and a number of each head.

    The means are null where no head is counted in them; off names the heads that are off, by rising number.
    """
    on = F.coalesce("active", F.lit(False))
    off = F.sort_array(F.collect_list(F.when(~on, F.col("kv_head"))))  # heads of one layer, some tens
    out = rows.groupBy("layer").agg(F.count("*").alias("heads"), F.count(F.when(on, 1)).alias("active"), F.avg(F.when(on, F.col(measure))).alias("keys_active"), F.avg(F.when(~on, F.col(measure))).alias("keys_off"), off.alias("o"))
    return out.withColumn("off", F.array_join(F.transform("o", lambda h: F.format_string("L%dH%d", F.col("layer"), h)), " ")).drop("o")
