"""Analytics over recorded retrievals (layer, q_head, step, rank, pos, score).

A shard is a layer and a group of query heads that share keys: what one of them fetches, the others have.
Steps are whole numbers; the admission policies look sequential, but as nothing is ever evicted a position is
cached from the first step at which it qualifies. That step is an aggregate, so no state is walked through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.operators.search import by_blocks, matrix
from vecloom.sources import ensure_checkpoint_dir

#: Steps in a block of a running sum or a sliding window.
BLOCK = 4096
SHARD = ["layer", "shard"]


def sharded(retr: DataFrame, group: int) -> DataFrame:
    return retr.withColumn("shard", F.floor(F.col("q_head") / group).cast("int"))


def weighted(retr: DataFrame) -> DataFrame:
    """retr with w, the softmax weight of a row among the rows of its query."""
    by = Window.partitionBy("layer", "q_head", "step")
    e = F.exp(F.col("score") - F.max("score").over(by))
    return retr.withColumn("e", e).withColumn("w", F.col("e") / F.sum("e").over(by)).drop("e")


def running_sum(rows: DataFrame, by: list[str], order: str, columns: list[str], block: int = BLOCK) -> DataFrame:
    """rows with each column replaced by its sum over all rows of the group up to this one in order.

    Done in two levels: the sums of blocks of the order column, and the running sum within a block, so that
    no task needs more than a block or one row per block. order holds whole numbers; rows of equal order
    get the same sum.
    """
    # Both levels read the rows: what they are made from, often a whole table, is computed once.
    ensure_checkpoint_dir(rows.sparkSession)
    rows = rows.withColumn("blk", F.floor(F.col(order) / block)).checkpoint()
    sums = rows.groupBy(*by, "blk").agg(*[F.sum(c).alias(f"{c}_blk") for c in columns])
    before = Window.partitionBy(*by).orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "blk", *[F.coalesce(F.sum(f"{c}_blk").over(before), F.lit(0)).alias(f"{c}_blk") for c in columns])
    within = Window.partitionBy(*by, "blk").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    part = rows.select(*[F.sum(c).over(within).alias(c) if c in columns else F.col(c) for c in rows.columns])
    both = part.join(sums, [*by, "blk"])
    return both.select(*[(F.col(c) + F.col(f"{c}_blk")).alias(c) if c in columns else F.col(c) for c in rows.columns if c != "blk"])


def sliding_sum(rows: DataFrame, by: list[str], order: str, columns: list[str], width: int, block: int = BLOCK) -> DataFrame:
    """rows with each column replaced by its sum over the rows whose order lies in (order - width, order].

    Rows at the end of a block are copied to the next one, so that each block is summed by itself.
    """
    own = F.floor(F.col(order) / block)
    blk = F.explode(F.array_distinct(F.array(own, F.floor((F.col(order) + width - 1) / block))))
    rows = rows.withColumn("own", own).withColumn("blk", blk)
    win = Window.partitionBy(*by, "blk").orderBy(order).rangeBetween(-(width - 1), 0)
    part = rows.select(*[F.sum(c).over(win).alias(c) if c in columns else F.col(c) for c in rows.columns])
    return part.where(F.col("own") == F.col("blk")).drop("own", "blk")


def first_steps(retr: DataFrame, group: int) -> DataFrame:
    """layer, shard, pos, first: when a shard first retrieves a position."""
    return sharded(retr, group).groupBy(*SHARD, "pos").agg(F.min("step").alias("first"))


def layer_reuse(retr: DataFrame) -> DataFrame:
    """layer, hit_ceiling, retention, averaged over heads.

    hit_ceiling: the share of retrievals that repeat a position the head has seen. retention: the share of a
    step's positions that the head also had in the step before, over the steps that have one before.
    """
    heads = retr.groupBy("layer", "q_head").agg(F.countDistinct("pos").alias("touched"), F.count("*").alias("rows"))
    ceiling = heads.groupBy("layer").agg((1 - F.avg("touched") / F.avg("rows")).alias("hit_ceiling"))
    own = retr.select("layer", "q_head", "step", "pos")
    steps = own.groupBy("layer", "q_head", "step").agg(F.count("*").alias("k"))
    before = own.withColumn("step", F.col("step") + 1).withColumn("hit", F.lit(1))
    has = steps.select("layer", "q_head", (F.col("step") + 1).alias("step"))
    hits = own.join(before, ["layer", "q_head", "step", "pos"]).groupBy("layer", "q_head", "step").agg(F.sum("hit").alias("same"))
    kept = steps.join(has, ["layer", "q_head", "step"], "left_semi").join(hits, ["layer", "q_head", "step"], "left")
    kept = kept.groupBy("layer").agg(F.avg(F.coalesce("same", F.lit(0)) / F.col("k")).alias("retention"))
    return ceiling.join(kept, "layer", "left")


def redundancy(retr: DataFrame) -> DataFrame:
    """layer, redundancy: retrieved rows over distinct positions of a step, averaged over steps."""
    step = retr.groupBy("layer", "step").agg((F.count("*") / F.countDistinct("pos")).alias("r"))
    return step.groupBy("layer").agg(F.avg("r").alias("redundancy"))


def heatmap(retr: DataFrame, context: int, bins: int) -> DataFrame:
    """layer, step, bin, heads: how many query heads retrieve from each bin of positions."""
    at = F.floor(F.col("pos") * bins / context).cast("int")
    return retr.groupBy("layer", "step", at.alias("bin")).agg(F.countDistinct("q_head").alias("heads"))


def new_positions(retr: DataFrame, group: int) -> DataFrame:
    """layer, shard, step, fresh: positions that a shard retrieves for the first time."""
    return first_steps(retr, group).groupBy(*SHARD, F.col("first").alias("step")).agg(F.count("*").alias("fresh"))


def download_curve(retr: DataFrame, group: int) -> DataFrame:
    """step, total: distinct positions fetched up to a step, summed over shards; every step that was recorded."""
    fresh = new_positions(retr, group).groupBy("step").agg(F.sum("fresh").alias("total"))
    steps = retr.select("step").distinct().join(fresh, "step", "left").select(F.lit(0).alias("one"), "step", F.coalesce("total", F.lit(0)).alias("total"))
    return running_sum(steps, ["one"], "step", ["total"]).drop("one")


def weight_mass_new(retr: DataFrame, group: int) -> DataFrame:
    """layer, step, fresh: the share of a head's weight on positions new to its shard, averaged over heads."""
    rows = sharded(weighted(retr), group).join(first_steps(retr, group), [*SHARD, "pos"])
    head = rows.groupBy("layer", "step", "q_head").agg(F.sum(F.when(F.col("first") == F.col("step"), F.col("w")).otherwise(0.0)).alias("f"))
    return head.groupBy("layer", "step").agg(F.avg("f").alias("fresh"))


def admitted(rows: DataFrame, taus: list[float]) -> DataFrame:
    """tau, layer, shard, pos, since: from when a position is cached if it is fetched once its best weight reaches tau."""
    best = rows.groupBy(*SHARD, "pos", "step").agg(F.max("w").alias("best"))
    each = best.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus]))).where(F.col("best") >= F.col("tau"))
    return each.groupBy("tau", *SHARD, "pos").agg(F.min("step").alias("since"))


def threshold_policy(retr: DataFrame, group: int, taus: list[float]) -> DataFrame:
    """tau, download, retained: fetched positions relative to fetching all, and the weight on cached positions."""
    rows = sharded(weighted(retr), group)
    at = admitted(rows, taus)
    each = rows.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus]))).join(at, ["tau", *SHARD, "pos"], "left")
    lost = each.groupBy("tau").agg(F.sum(F.when(F.col("since") <= F.col("step"), 0.0).otherwise(F.col("w"))).alias("lost"), F.sum("w").alias("all"))
    n = at.groupBy("tau").agg(F.count("*").alias("n"))
    whole = rows.select(*SHARD, "pos").distinct().agg(F.count("*").alias("n_all"))
    return lost.join(n, "tau", "left").join(F.broadcast(whole)).select("tau", (F.coalesce("n", F.lit(0)) / F.col("n_all")).alias("download"), (1 - F.col("lost") / F.col("all")).alias("retained"))


def _dims(prefix: str, n: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(n)]


def _sse(pairs: list[tuple[Column, Column]]) -> Column:
    out = F.lit(0.0)
    for a, b in pairs:
        out = out + (a - b) * (a - b)
    return out


def threshold_mse(rows: DataFrame, group: int, taus: list[float], dim: int) -> DataFrame:
    """tau, mse of the output over the cached positions alone against the full one. rows have the values v0, v1, ..."""
    v = _dims("v", dim)
    rows = sharded(weighted(rows), group)
    each = rows.withColumn("tau", F.explode(F.array(*[F.lit(float(t)) for t in taus]))).join(admitted(rows, taus), ["tau", *SHARD, "pos"], "left")
    kept = F.when(F.col("since") <= F.col("step"), F.col("w")).otherwise(0.0)
    out = each.groupBy("tau", "layer", "q_head", "step").agg(F.sum(kept).alias("mass"), *[F.sum(F.col("w") * F.col(c)).alias(f"full_{c}") for c in v], *[F.sum(kept * F.col(c)).alias(f"kept_{c}") for c in v])
    sse = _sse([(F.col(f"full_{c}"), F.when(F.col("mass") > 0, F.col(f"kept_{c}") / F.col("mass")).otherwise(0.0)) for c in v])
    return out.groupBy("tau").agg((F.sum(sse) / (F.count("*") * dim)).alias("mse"))


def meanfield(rows: DataFrame, group: int, heads: list[int], dim: int, width: int = 32) -> DataFrame:
    """h, dropped, in_step, causal, window: mean squared errors when only the h heaviest positions stay exact.

    The rest is dropped (the head renormalised), or replaced by the mean value of the tail: of this step, of
    all steps so far of the shard, or of the last `width` steps. A query with no more than h positions has no
    tail and no error.
    """
    v = _dims("v", dim)
    rows = sharded(weighted(rows), group).withColumn("h", F.explode(F.array(*[F.lit(h) for h in heads])))
    top = F.col("rank") <= F.col("h")
    q = rows.groupBy("h", *SHARD, "q_head", "step").agg(
        F.sum(F.when(top, F.col("w")).otherwise(0.0)).alias("w_head"), F.sum(F.when(top, 0).otherwise(1)).alias("n_tail"),
        *[F.sum(F.col("w") * F.col(c)).alias(f"full_{c}") for c in v],
        *[F.sum(F.when(top, F.col("w") * F.col(c)).otherwise(0.0)).alias(f"head_{c}") for c in v],
        *[F.sum(F.when(top, 0.0).otherwise(F.col(c))).alias(f"tail_{c}") for c in v],
    )
    sums = [f"tail_{c}" for c in v] + ["n_tail"]
    step = q.groupBy("h", *SHARD, "step").agg(*[F.sum(c).alias(c) for c in sums])
    runs = running_sum(step, ["h", *SHARD], "step", sums).select("h", *SHARD, "step", *[F.col(c).alias(f"run_{c}") for c in sums])
    wins = sliding_sum(step, ["h", *SHARD], "step", sums, width).select("h", *SHARD, "step", *[F.col(c).alias(f"win_{c}") for c in sums])
    q = q.join(runs, ["h", *SHARD, "step"]).join(wins, ["h", *SHARD, "step"])
    rest = 1 - F.col("w_head")

    def mean(prefix: str, c: str) -> Column:
        n = F.col(f"{prefix}n_tail")
        return F.when(n > 0, F.col(f"{prefix}tail_{c}") / n).otherwise(0.0)

    def error(prefix: str) -> Column:
        return _sse([(F.col(f"full_{c}"), F.col(f"head_{c}") + rest * mean(prefix, c)) for c in v])

    dropped = _sse([(F.col(f"full_{c}"), F.col(f"head_{c}") / F.greatest("w_head", F.lit(1e-9))) for c in v])
    n = F.count("*") * dim
    return q.groupBy("h").agg((F.sum(dropped) / n).alias("dropped"), (F.sum(error("")) / n).alias("in_step"), (F.sum(error("run_")) / n).alias("causal"), (F.sum(error("win_")) / n).alias("window"))


def _nearest_cached(open_: DataFrame, cache: DataFrame, v: list[str], k: list[str]) -> DataFrame:
    """h, shard, pos, step, sub: the values of the cached position nearest to each open one, of those cached by its step."""
    cell = ["h", "layer", "heads"]  # the search has a column shard of its own
    open_, cache = (x.withColumnRenamed("shard", "heads") for x in (open_, cache))
    fields = [f"{c} {open_.schema[c].dataType.simpleString()}" for c in [*cell, "pos", "step"]]
    q = open_.select(*cell, F.struct("pos", "step").alias("q_row"), F.array(*k, F.col("step").cast("double")).alias("q"))
    kv = cache.select(*[F.col(c).alias(c) for c in cell], "pos", F.array(*[f"c{c}" for c in k], F.col("since").cast("double")).alias("key"), F.array(*[f"c{c}" for c in v]).alias("value"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        n = a.num_rows
        sub, dist, near = np.zeros((n, len(v))), np.full(n, np.inf), np.zeros(n, np.int64)
        if n and b.num_rows:
            order = np.argsort(b.column("pos").to_numpy())
            x, y, pos, value = matrix(a.column("q")), matrix(b.column("key"))[order], b.column("pos").to_numpy()[order], matrix(b.column("value"))[order]
            size = max(1, 2_000_000 // len(pos))
            for i in range(0, n, size):
                part = x[i : i + size]
                d = sum((part[:, j, None] - y[None, :, j]) ** 2 for j in range(len(k)))
                d = np.where(y[None, :, -1] <= part[:, -1, None], d, np.inf)
                at = d.argmin(1)
                sub[i : i + size], near[i : i + size], dist[i : i + size] = value[at], pos[at], d[np.arange(len(part)), at]
        of = a.column("q_row").combine_chunks()
        of = of.combine_chunks() if isinstance(of, pa.ChunkedArray) else of
        cols = [a.column(c) for c in cell] + [of.field("pos"), of.field("step"), pa.array(dist), pa.array(near), pa.array(list(sub), pa.list_(pa.float64()))]
        return pa.table(cols, [*cell, "pos", "step", "dist", "near", "sub"])

    found = by_blocks(q, kv, cell, run, ", ".join(fields) + ", dist double, near bigint, sub array<double>")
    # The nearest of all shards; a position with none cached yet has none.
    best = found.where(F.col("dist") < float("inf")).groupBy(*cell, "pos", "step").agg(F.min_by("sub", F.struct("dist", "near")).alias("s"))
    return best.select("h", "layer", F.col("heads").alias("shard"), "pos", "step", F.struct(*[F.col("s")[i].alias(c) for i, c in enumerate(v)]).alias("sub"))


def cached_reuse(rows: DataFrame, group: int, heads: list[int], dim: int, asked: Column) -> DataFrame:
    """h, download, mse_drop, mse_mean, mse_cached: the h heaviest positions of a step join the shard's cache.

    Cached positions are used exactly. The others are dropped, replaced by their mean, or each by the value
    of the cached position with the nearest key (ties: the smaller position). Dropping and means are judged over
    all steps, the nearest over the stated ones (asked), which are searched against the whole cache in blocks;
    download relates the cache to all distinct positions. rows have values v0.. and keys k0..
    """
    v, k = _dims("v", dim), _dims("k", dim)
    rows = sharded(weighted(rows), group)
    every = rows.withColumn("h", F.explode(F.array(*[F.lit(h) for h in heads])))
    cache = every.where(F.col("rank") <= F.col("h")).groupBy("h", *SHARD, "pos").agg(F.min("step").alias("since"), *[F.first(c).alias(f"c{c}") for c in v + k])
    use = every.join(cache.select("h", *SHARD, "pos", "since"), ["h", *SHARD, "pos"], "left")
    use = use.withColumn("cached", F.coalesce(F.col("since") <= F.col("step"), F.lit(False))).drop("since").withColumn("asked", asked)
    open_ = use.where(F.col("asked") & ~F.col("cached")).groupBy("h", *SHARD, "pos", "step").agg(*[F.first(c).alias(c) for c in k])
    use = use.join(_nearest_cached(open_, cache, v, k), ["h", *SHARD, "pos", "step"], "left")
    q = use.groupBy("h", "layer", "q_head", "step").agg(
        F.sum(F.when(F.col("cached"), F.col("w")).otherwise(0.0)).alias("mass"), F.sum(F.when(F.col("cached"), 0).otherwise(1)).alias("n_open"),
        F.sum(F.when(F.col("cached"), 0.0).otherwise(F.col("w"))).alias("w_open"),
        *[F.sum(F.col("w") * F.col(c)).alias(f"full_{c}") for c in v],
        *[F.sum(F.when(F.col("cached"), F.col("w") * F.col(c)).otherwise(0.0)).alias(f"kept_{c}") for c in v],
        *[F.sum(F.when(F.col("cached"), 0.0).otherwise(F.col(c))).alias(f"open_{c}") for c in v],
        *[F.sum(F.when(F.col("cached"), F.col("w") * F.col(c)).otherwise(F.col("w") * F.coalesce(F.col(f"sub.{c}"), F.col(c)))).alias(f"sub_{c}") for c in v],
    )
    drop = _sse([(F.col(f"full_{c}"), F.col(f"kept_{c}") / F.greatest("mass", F.lit(1e-9))) for c in v])
    mean = _sse([(F.col(f"full_{c}"), F.col(f"kept_{c}") + F.col("w_open") * F.col(f"open_{c}") / F.greatest("n_open", F.lit(1))) for c in v])
    cached = _sse([(F.col(f"full_{c}"), F.col(f"sub_{c}")) for c in v])
    n = F.count("*") * dim
    stated = F.count(F.when(asked, 1)) * dim
    errors = q.groupBy("h").agg((F.sum(drop) / n).alias("mse_drop"), (F.sum(mean) / n).alias("mse_mean"), (F.sum(F.when(asked, cached)) / stated).alias("mse_cached"))
    distinct = rows.select(*SHARD, "pos").distinct().agg(F.count("*").alias("n_all"))
    size = cache.groupBy("h").agg(F.count("*").alias("n"))
    return size.join(F.broadcast(distinct)).join(errors, "h", "left").select("h", (F.col("n") / F.col("n_all")).alias("download"), "mse_drop", "mse_mean", "mse_cached")


def layer_coverage(retr: DataFrame, permuted: Column | None = None) -> DataFrame:
    """layer, coverage: the share of a step's positions that an earlier layer has at the same step, averaged over steps.

    permuted maps a step to the one whose earlier layers it is held against: a baseline of popularity. The
    first layer has no earlier one and no row.
    """
    pos = retr.select("layer", "step", "pos").distinct()
    first = pos.groupBy("step", "pos").agg(F.min("layer").alias("earliest"))
    want = pos.withColumn("at", permuted if permuted is not None else F.col("step"))
    lowest = pos.agg(F.min("layer").alias("lowest"))
    both = want.join(first.withColumnRenamed("step", "at"), ["at", "pos"], "left")
    hit = F.coalesce((F.col("earliest") < F.col("layer")).cast("double"), F.lit(0.0))
    step = both.groupBy("layer", "step").agg(F.avg(hit).alias("c"))
    return step.join(F.broadcast(lowest)).where(F.col("layer") > F.col("lowest")).groupBy("layer").agg(F.avg("c").alias("coverage"))


def coretrieval_edges(retr: DataFrame, group: int, kept: int, neighbours: int) -> DataFrame:
    """layer, shard, a, b, queries, rank: for each position the others most often retrieved by the same query.

    Pairs arise within the kept best positions of one query only, a constant number of them; ties go to the
    smaller position.
    """
    rows = sharded(retr, group).where(F.col("rank") <= kept)
    sets = rows.groupBy(*SHARD, "q_head", "step").agg(F.collect_list("pos").alias("set"))
    pairs = sets.select(*SHARD, F.explode("set").alias("a"), "set").select(*SHARD, "a", F.explode("set").alias("b")).where("a <> b")
    count = pairs.groupBy(*SHARD, "a", "b").agg(F.count("*").alias("queries"))
    rank = F.row_number().over(Window.partitionBy(*SHARD, "a").orderBy(F.desc("queries"), "b"))
    return count.withColumn("rank", rank).where(F.col("rank") <= neighbours)


def downsample(curve: DataFrame, order: str, points: int) -> DataFrame:
    """The rows of the curve at evenly spaced ranks, `points` of them or all if it has fewer."""
    one = curve.select(F.lit(0).alias("one"), order, F.lit(1).cast("bigint").alias("at"))
    ranks = running_sum(one, ["one"], order, ["at"]).select(order, (F.col("at") - 1).alias("at"))
    n = curve.agg(F.count("*").alias("n"))
    wanted = curve.sparkSession.range(points).join(F.broadcast(n)).select(F.bround(F.col("id") * (F.col("n") - 1) / (points - 1), 0).cast("bigint").alias("at"))
    wanted = wanted.where("at >= 0").distinct()
    return curve.join(ranks.join(F.broadcast(wanted), "at").select(order), order)
