"""Exact and approximate search, and attention over what it returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.functions import vec
from vecloom.operators import search
from vecloom.plans.registry import KEYS, LIVE, QS, SCORED, TOP, query, usable
from vecloom.sources import ensure_checkpoint_dir, table, views
from vecloom.sources.views import CELL, SCALING, VALUE_DIM

K = views.KEPT


def _r(c, n: int = 6):
    """Rounded for output, with -0.0 as 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def _top(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    return search.exact_top_k(views.queries(spark, d), views.keys(spark, d), CELL, k)


def _gathered(spark: SparkSession, d: str, k: int = K) -> DataFrame:
    """The top k with the values of their positions: q_row, rank, pos, logit, value."""
    kv = views.keys(spark, d).select(*CELL, "pos", "value")
    top = _top(spark, d, k).join(views.queries(spark, d).select("q_row", *CELL), "q_row")
    return top.join(kv, [*CELL, "pos"]).withColumn("logit", F.col("score") * SCALING)


def _top_out(spark: SparkSession, d: str) -> DataFrame:
    return search.attend(_gathered(spark, d), ["q_row"], VALUE_DIM)


def _full_out(spark: SparkSession, d: str) -> DataFrame:
    return search.full_attention(views.queries(spark, d), views.keys(spark, d), CELL, SCALING, VALUE_DIM)


def _live_states(spark: SparkSession, d: str) -> DataFrame:
    """Softmax states of each query over the live keys of its session and head up to its own step, in blocks."""
    cell = ["session_id", "layer", "kv_head", "q_head"]
    timed = lambda v, step: F.concat(v, F.array(F.col(step).cast("double")))
    q = views.queries(spark, d).withColumn("q", timed("q", "step"))
    kv = views.live_rows(spark, d).withColumn("key", timed("key", "step")).withColumnRenamed("q_row", "pos")
    return search.softmax_states(q, kv, cell, SCALING, causal=True)


def _live_out(spark: SparkSession, d: str) -> DataFrame:
    return search.merge_states(_live_states(spark, d), ["q_row"], VALUE_DIM)


LIVE_SCORED = f"""{QS}, {LIVE}, lived AS (SELECT q_row, qs.layer, live_step, list_inner_product(q, key) * {SCALING} AS logit, value FROM qs JOIN live USING (session_id, layer, kv_head, q_head) WHERE live_step <= step)"""


def _attend_sql(rel: str, logit: str, name: str) -> str:
    return f"""{name} AS (SELECT q_row, i, m + ln(sum(exp({logit} - m))) AS lse, sum(exp({logit} - m) * value[i + 1]) / sum(exp({logit} - m)) AS o, min({logit}) AS boundary
    FROM (SELECT *, max({logit}) OVER (PARTITION BY q_row) AS m FROM {rel}), (SELECT unnest(range({VALUE_DIM})) AS i) GROUP BY q_row, i, m)"""


OUT = "SELECT q_row, CAST(i AS INTEGER) AS i, round(o, 6) + 0.0 AS out, round(lse, 6) + 0.0 AS lse"


@query(f"WITH {TOP} SELECT q_row, CAST(rank AS INTEGER) AS rank, pos, round(score, 6) + 0.0 AS score FROM topk")
def exact_topk(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).withColumn("score", _r("score"))


@query(f"WITH {TOP} SELECT q_row, round(min(score), 6) + 0.0 AS boundary, count(*) AS kept FROM topk GROUP BY q_row")
def topk_boundary(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).groupBy("q_row").agg(_r(F.min("score")).alias("boundary"), F.count("*").alias("kept"))


@query(f"WITH {TOP} SELECT q_row, CAST(rank AS INTEGER) AS rank, pos FROM topk")
def topk_chunk_merge(spark: SparkSession, d: str) -> DataFrame:
    """The best of chunks of 64 positions, merged."""
    return search.chunked_top_k(views.queries(spark, d), views.keys(spark, d), CELL, 64, K).select("q_row", "rank", "pos")


@query(f"WITH {TOP}, {_attend_sql('topk', f'score * {SCALING}', 'att')} {OUT}, round(boundary, 6) + 0.0 AS boundary FROM att")
def attn_topk(spark: SparkSession, d: str) -> DataFrame:
    """Exact retrieval attention: softmax over the 16 best keys of each query."""
    return search.exploded(_top_out(spark, d), ["q_row", _r("lse").alias("lse"), _r("boundary").alias("boundary")]).withColumn("out", _r("out"))


@query(f"WITH {SCORED}, {_attend_sql('scored', f'score * {SCALING}', 'att')} {OUT} FROM att")
def attn_full(spark: SparkSession, d: str) -> DataFrame:
    return search.exploded(_full_out(spark, d), ["q_row", _r("lse").alias("lse")]).withColumn("out", _r("out"))


@query(f"WITH {LIVE_SCORED}, {_attend_sql('lived', 'logit', 'att')} {OUT} FROM att")
def attn_live_causal(spark: SparkSession, d: str) -> DataFrame:
    return search.exploded(_live_out(spark, d), ["q_row", _r("lse").alias("lse")]).withColumn("out", _r("out"))


@query(f"""WITH {TOP}, {LIVE}, lived AS (SELECT q_row, list_inner_product(q, key) * {SCALING} AS logit, value FROM qs JOIN live USING (session_id, layer, kv_head, q_head) WHERE live_step <= step),
  both_ AS (SELECT q_row, score * {SCALING} AS logit, value FROM topk UNION ALL SELECT q_row, logit, value FROM lived), {_attend_sql('both_', 'logit', 'att')} {OUT} FROM att""")
def attn_merge(spark: SparkSession, d: str) -> DataFrame:
    """Retrieved and live attention merged by their log-sum-exps; the SQL does it in one softmax."""
    both = search.merge_partitions(_top_out(spark, d), _live_out(spark, d), ["q_row"])
    return search.exploded(both, ["q_row", _r("lse").alias("lse")]).withColumn("out", _r("out"))


@query(f"WITH {TOP} SELECT q_row, CAST(rank AS INTEGER) AS rank, pos, round(list_sum(value), 6) + 0.0 AS total, round(value[1], 6) + 0.0 AS first FROM topk")
def value_gather(spark: SparkSession, d: str) -> DataFrame:
    total = F.aggregate("value", F.lit(0.0), lambda a, x: a + x)
    return _gathered(spark, d).select("q_row", "rank", "pos", _r(total).alias("total"), _r(F.col("value")[0]).alias("first"))


@query(f"""WITH {QS}, {KEYS}, n AS (SELECT cache_id, layer, kv_head, count(*) AS keys FROM keys GROUP BY ALL)
  SELECT q_row, q_head, CAST(q_head // 4 AS INTEGER) AS group_head, n.keys FROM qs JOIN n ON qs.cache_id = n.cache_id AND qs.layer = n.layer AND n.kv_head = qs.q_head // 4""")
def gqa_expand(spark: SparkSession, d: str) -> DataFrame:
    """Each query head finds the keys of KV head q_head div 4."""
    n = views.keys(spark, d).groupBy(*CELL).agg(F.count("*").alias("keys")).withColumnRenamed("kv_head", "group_head")
    q = views.queries(spark, d).withColumn("group_head", F.floor(F.col("q_head") / 4).cast("int"))
    return q.join(n, ["cache_id", "layer", "group_head"]).select("q_row", "q_head", "group_head", "keys")


@query(f"WITH {SCORED} SELECT q_row, pos, CAST(row_number() OVER (PARTITION BY q_row ORDER BY score DESC, pos) - 1 AS INTEGER) AS rank FROM scored")
def rank_full(spark: SparkSession, d: str) -> DataFrame:
    """The full ranking of a cell's keys for each query, from 0."""
    all_ = search.scores(views.queries(spark, d), views.keys(spark, d), CELL)
    rank = F.row_number().over(Window.partitionBy("q_row").orderBy(F.desc("score"), "pos")) - 1
    return all_.select("q_row", "pos", rank.alias("rank"))


@query(f"""WITH {KEYS}, c AS (SELECT cache_id, layer, kv_head, pos, key, rn - 1 AS cid FROM (SELECT *, row_number() OVER (PARTITION BY cache_id, layer, kv_head ORDER BY md5(CAST(pos AS VARCHAR)), pos) AS rn FROM keys) WHERE rn <= 16),
  a AS (SELECT k.cache_id, k.layer, k.kv_head, k.pos, arg_min(cid, list_distance(k.key, c.key) * 1e6 + cid * 1e-9) AS cid FROM keys k JOIN c USING (cache_id, layer, kv_head) GROUP BY ALL)
  SELECT cache_id, layer, kv_head, pos, CAST(cid AS INTEGER) AS cid FROM a""")
def centroid_assign(spark: SparkSession, d: str) -> DataFrame:
    kv = views.keys(spark, d)
    return search.nearest_centroid(kv, search.sample_centroids(kv, CELL, 16), CELL).select(*CELL, "pos", "cid")


@query(f"""WITH {KEYS}, c AS (SELECT cache_id, layer, kv_head, pos, key, rn - 1 AS cid FROM (SELECT *, row_number() OVER (PARTITION BY cache_id, layer, kv_head ORDER BY md5(CAST(pos AS VARCHAR)), pos) AS rn FROM keys) WHERE rn <= 16),
  a AS (SELECT k.cache_id, k.layer, k.kv_head, k.pos, arg_min(cid, list_distance(k.key, c.key) * 1e6 + cid * 1e-9) AS cid FROM keys k JOIN c USING (cache_id, layer, kv_head) GROUP BY ALL)
  SELECT cache_id, layer, kv_head, CAST(cid AS INTEGER) AS cid, CAST(i AS INTEGER) AS i, count(*) AS n, round(avg(value[i + 1]) + 1e-10, 6) + 0.0 AS mean
  FROM a JOIN keys USING (cache_id, layer, kv_head, pos), (SELECT unnest(range(8)) AS i) GROUP BY cache_id, layer, kv_head, cid, i""")
def centroid_value_mean(spark: SparkSession, d: str) -> DataFrame:
    kv = views.keys(spark, d)
    a = search.nearest_centroid(kv, search.sample_centroids(kv, CELL, 16), CELL)
    flat = a.select(*CELL, "cid", F.posexplode("value").alias("i", "x"))
    return flat.groupBy(*CELL, "cid", "i").agg(F.count("*").alias("n"), _r(F.avg("x") + 1e-10).alias("mean"))


IVF = f"""{SCORED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY q_row ORDER BY score DESC, pos) AS rank FROM scored),
  c AS (SELECT cache_id, layer, kv_head, key, rn - 1 AS cid FROM (SELECT *, row_number() OVER (PARTITION BY cache_id, layer, kv_head ORDER BY md5(CAST(pos AS VARCHAR)), pos) AS rn FROM keys) WHERE rn <= 16),
  a AS (SELECT k.cache_id, k.layer, k.kv_head, k.pos, arg_min(cid, list_distance(k.key, c.key) * 1e6 + cid * 1e-9) AS cid FROM keys k JOIN c USING (cache_id, layer, kv_head) GROUP BY ALL),
  probes AS (SELECT q_row, cid, row_number() OVER (PARTITION BY q_row ORDER BY list_inner_product(q, c.key) DESC, cid) AS probe FROM qs JOIN c USING (cache_id, layer, kv_head)),
  np AS (SELECT unnest([1, 2, 4, 8, 16]) AS nprobe)"""


@query(f"""WITH {IVF}, top AS (SELECT r.q_row, r.score, r.rank, p.probe FROM ranked r JOIN a USING (cache_id, layer, kv_head, pos) JOIN probes p ON p.q_row = r.q_row AND p.cid = a.cid WHERE rank <= 16)
  SELECT CAST(nprobe AS INTEGER) AS nprobe, round(avg(hit), 6) + 0.0 AS recall FROM (SELECT q_row, nprobe, avg(CASE WHEN probe <= nprobe THEN 1.0 ELSE 0.0 END) AS hit FROM top, np GROUP BY q_row, nprobe) GROUP BY nprobe""")
def ivf_recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the 16 best keys by the number of inverted lists searched; with all lists it is 1.

    A best key is found if its list is searched, as none of the keys beside it can be better: one ranking of the lists
    answers for every number of them. ivf_search runs such a search itself.
    """
    top = _top_with_probe(spark, d).withColumn("nprobe", F.explode(F.array(*[F.lit(n) for n in (1, 2, 4, 8, 16)])))
    per = top.groupBy("q_row", "nprobe").agg(F.avg((F.col("probe") <= F.col("nprobe")).cast("double")).alias("recall"))
    return per.groupBy("nprobe").agg(_r(F.avg("recall")).alias("recall"))


def _top_with_probe(spark: SparkSession, d: str) -> DataFrame:
    """The top k with the place of their list in the order in which their query would search the lists."""
    kv, q = views.keys(spark, d), views.queries(spark, d)
    cents = search.sample_centroids(kv, CELL, 16)
    top = _top(spark, d).join(q.select("q_row", *CELL), "q_row").join(search.nearest_centroid(kv, cents, CELL).select(*CELL, "pos", "cid"), [*CELL, "pos"])
    return top.join(search.probe(q, cents, CELL), ["q_row", "cid"])


@query(f"""WITH {IVF}, f AS (SELECT r.q_row, r.pos, row_number() OVER (PARTITION BY r.q_row ORDER BY r.score DESC, r.pos) AS rank FROM ranked r JOIN a USING (cache_id, layer, kv_head, pos) JOIN probes p ON p.q_row = r.q_row AND p.cid = a.cid WHERE p.probe <= 4)
  SELECT q_row, CAST(rank AS INTEGER) AS rank, pos FROM f WHERE rank <= 16""")
def ivf_search(spark: SparkSession, d: str) -> DataFrame:
    """The 16 best keys in the four nearest of 16 inverted lists."""
    return search.retriever("ivf", K, 4)(views.queries(spark, d), views.keys(spark, d), CELL).select("q_row", "rank", "pos")


@query(f"""WITH {IVF}, top AS (SELECT r.q_row, r.layer, p.probe, exp(score * {SCALING} - max(score * {SCALING}) OVER (PARTITION BY r.q_row)) AS e FROM ranked r JOIN a USING (cache_id, layer, kv_head, pos) JOIN probes p ON p.q_row = r.q_row AND p.cid = a.cid WHERE rank <= 16)
  SELECT layer, CAST(nprobe AS INTEGER) AS nprobe, round(avg(share), 6) + 0.0 AS weight FROM (SELECT q_row, layer, nprobe, sum(CASE WHEN probe <= nprobe THEN e ELSE 0 END) / sum(e) AS share FROM top, np GROUP BY ALL) GROUP BY layer, nprobe""")
def nprobe_recall_weight(spark: SparkSession, d: str) -> DataFrame:
    """Softmax weight of the 16 best keys whose cluster is among the nprobe nearest by inner product."""
    top = _top_with_probe(spark, d)
    s = F.col("score") * SCALING
    e = top.withColumn("e", F.exp(s - F.max(s).over(Window.partitionBy("q_row"))))
    e = e.withColumn("nprobe", F.explode(F.array(*[F.lit(n) for n in (1, 2, 4, 8, 16)])))
    per = e.groupBy("q_row", "layer", "nprobe").agg((F.sum(F.when(F.col("probe") <= F.col("nprobe"), F.col("e")).otherwise(0.0)) / F.sum("e")).alias("share"))
    return per.groupBy("layer", "nprobe").agg(_r(F.avg("share")).alias("weight"))


HEADS_KEPT = [2, 4, 8]


@query(f"""WITH {IVF}, cv AS (SELECT cache_id, layer, kv_head, cid, i, avg(value[i + 1]) AS cv FROM a JOIN keys USING (cache_id, layer, kv_head, pos), (SELECT unnest(range({VALUE_DIM})) AS i) GROUP BY ALL),
  top AS (SELECT r.q_row, r.layer, r.rank, r.score * {SCALING} AS lg, list_inner_product(qs.q, c.key) * {SCALING} AS clg, r.value, cv.i, cv.cv FROM ranked r JOIN qs ON qs.q_row = r.q_row JOIN a ON a.cache_id = r.cache_id AND a.layer = r.layer AND a.kv_head = r.kv_head AND a.pos = r.pos
    JOIN c ON c.cache_id = r.cache_id AND c.layer = r.layer AND c.kv_head = r.kv_head AND c.cid = a.cid JOIN cv ON cv.cache_id = r.cache_id AND cv.layer = r.layer AND cv.kv_head = r.kv_head AND cv.cid = a.cid WHERE r.rank <= 16),
  h AS (SELECT unnest({HEADS_KEPT}) AS h), s AS (SELECT h, layer, q_row, i, sum(exp(lg) * value[i + 1]) / sum(exp(lg)) AS f, sum(CASE WHEN rank <= h THEN exp(lg) * value[i + 1] ELSE exp(clg) * cv END) / sum(CASE WHEN rank <= h THEN exp(lg) ELSE exp(clg) END) AS ce,
    sum(CASE WHEN rank <= h THEN exp(lg) * value[i + 1] ELSE 0 END) / sum(CASE WHEN rank <= h THEN exp(lg) ELSE 0 END) AS dr,
    sum(CASE WHEN rank <= h THEN exp(lg) * value[i + 1] ELSE 0 END) / sum(exp(lg)) + sum(CASE WHEN rank <= h THEN 0 ELSE exp(lg) END) / sum(exp(lg)) * avg(value[i + 1]) FILTER (WHERE rank > h) AS me FROM top, h GROUP BY ALL)
  SELECT CAST(h AS INTEGER) AS h, layer, round(avg(pow(f - ce, 2)), 6) + 0.0 AS mse_centroid, round(avg(pow(f - dr, 2)), 6) + 0.0 AS mse_drop, round(avg(pow(f - me, 2)), 6) + 0.0 AS mse_mean FROM s GROUP BY h, layer""")
def centroid_mse(spark: SparkSession, d: str) -> DataFrame:
    """Error when all but the h best of 16 keys are replaced by their clusters' centroids, dropped, or replaced by their mean."""
    kv, q = views.keys(spark, d), views.queries(spark, d)
    cents = search.sample_centroids(kv, CELL, 16)
    assigned = search.nearest_centroid(kv, cents, CELL)
    mean = assigned.groupBy(*CELL, "cid").agg(F.array(*[F.avg(F.col("value")[i]) for i in range(VALUE_DIM)]).alias("cval"))
    top = _gathered(spark, d).join(q.select("q_row", "q"), "q_row").join(assigned.select(*CELL, "pos", "cid"), [*CELL, "pos"]).join(cents, [*CELL, "cid"]).join(mean, [*CELL, "cid"])
    top = top.withColumn("clogit", vec.dot(F.col("q"), F.col("centroid")) * SCALING).withColumn("h", F.explode(F.array(*[F.lit(h) for h in HEADS_KEPT])))
    kept = F.col("rank") <= F.col("h")
    # Scaled logits of 16 keys are small; a common factor of all weights would cancel.
    w, c = F.exp("logit"), F.exp("clogit")
    v = lambda i: F.col("value")[i]
    sums = top.groupBy("h", "layer", "q_row").agg(
        F.sum(w).alias("d"), F.sum(F.when(kept, w).otherwise(c)).alias("dc"), F.sum(F.when(kept, w).otherwise(0.0)).alias("dk"),
        *[F.sum(w * v(i)).alias(f"f{i}") for i in range(VALUE_DIM)], *[F.sum(F.when(kept, w * v(i)).otherwise(c * F.col("cval")[i])).alias(f"c{i}") for i in range(VALUE_DIM)],
        *[F.sum(F.when(kept, w * v(i)).otherwise(0.0)).alias(f"k{i}") for i in range(VALUE_DIM)], *[F.avg(F.when(~kept, v(i))).alias(f"m{i}") for i in range(VALUE_DIM)],
    )

    def mse(part):
        total = F.lit(0.0)
        for i in range(VALUE_DIM):
            e = F.col(f"f{i}") / F.col("d") - part(i)
            total = total + e * e
        return _r(F.avg(total / VALUE_DIM))

    rest = 1 - F.col("dk") / F.col("d")
    return sums.groupBy("h", "layer").agg(
        mse(lambda i: F.col(f"c{i}") / F.col("dc")).alias("mse_centroid"), mse(lambda i: F.col(f"k{i}") / F.col("dk")).alias("mse_drop"), mse(lambda i: F.col(f"k{i}") / F.col("d") + rest * F.col(f"m{i}")).alias("mse_mean")
    )


def _k_means_sql(c: int, iters: int, fit: int) -> str:
    cell = "cache_id, layer, kv_head"
    near = lambda rel, cents: f"SELECT k.cache_id, k.layer, k.kv_head, k.pos, any_value(k.key) AS key, arg_min(cid, list_distance(k.key, c.v) * 1e6 + cid * 1e-9) AS cid FROM {rel} k JOIN {cents} c USING ({cell}) GROUP BY k.cache_id, k.layer, k.kv_head, k.pos"
    parts = [KEYS, f"ranked AS (SELECT *, row_number() OVER (PARTITION BY {cell} ORDER BY md5(CAST(pos AS VARCHAR)), pos) AS rn FROM keys)", f"fit AS (SELECT * FROM ranked WHERE rn <= {fit})", f"c0 AS (SELECT {cell}, rn - 1 AS cid, key AS v FROM fit WHERE rn <= {c})"]
    for i in range(iters):
        parts.append(f"a{i} AS ({near('fit', f'c{i}')})")
        parts.append(f"m{i} AS (SELECT {cell}, cid, list(x ORDER BY i) AS v FROM (SELECT {cell}, cid, i, avg(key[i + 1]) AS x FROM a{i}, (SELECT unnest(range({views.KEY_DIM})) AS i) GROUP BY {cell}, cid, i) GROUP BY {cell}, cid)")
        parts.append(f"c{i + 1} AS (SELECT c.cache_id, c.layer, c.kv_head, c.cid, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m USING ({cell}, cid))")
    parts.append(f"n AS (SELECT {cell}, cid, count(*) AS n FROM ({near('keys', f'c{iters}')}) GROUP BY {cell}, cid)")
    return f"WITH {', '.join(parts)} SELECT {cell}, CAST(cid AS INTEGER) AS cid, coalesce(n, 0) AS n, CAST(i AS INTEGER) AS i, round(v[i + 1] + 1e-10, 5) + 0.0 AS x FROM c{iters} LEFT JOIN n USING ({cell}, cid), (SELECT unnest(range({views.KEY_DIM})) AS i)"


@query(_k_means_sql(8, 3, 1000))
def kmeans_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Lloyd's iterations: the centroids of each cell and how many keys are nearest to them."""
    ensure_checkpoint_dir(spark)
    kv = views.keys(spark, d)
    cents = search.k_means(kv, CELL, 8, 3, 1000)
    n = search.nearest_centroid(kv, cents, CELL).groupBy(*CELL, "cid").agg(F.count("*").alias("n"))
    both = cents.join(n, [*CELL, "cid"], "left").select(*CELL, "cid", F.coalesce("n", F.lit(0)).alias("n"), F.posexplode("centroid").alias("i", "x"))
    return both.withColumn("x", _r(F.col("x") + 1e-10, 5))


@query(f"""WITH {TOP}, nk AS (SELECT cache_id, layer + 4 AS nl, layer, kv_head, pos FROM keys),
  other AS (SELECT q_row, layer, pos FROM (SELECT q.q_row, q.layer, k.pos, row_number() OVER (PARTITION BY q.q_row ORDER BY list_inner_product(q.q, k.key) DESC, k.pos) AS rank
    FROM qs q JOIN keys k ON k.cache_id = q.cache_id AND k.kv_head = q.kv_head AND k.layer = q.layer + 4) WHERE rank <= 16)
  SELECT t.layer, count(*) AS pairs, round(avg(CASE WHEN o.pos IS NULL THEN 0.0 ELSE 1.0 END), 6) + 0.0 AS recall
  FROM topk t LEFT JOIN other o ON o.q_row = t.q_row AND o.pos = t.pos WHERE t.layer IN (SELECT layer - 4 FROM keys) GROUP BY t.layer""")
def proxy_recall(spark: SparkSession, d: str) -> DataFrame:
    """How many of a query's best positions the keys of the next layer would have returned for the same query."""
    kv, q = views.keys(spark, d), views.queries(spark, d)
    nxt = kv.withColumn("layer", F.col("layer") - 4)
    have = nxt.select("layer").distinct()
    own = _top(spark, d).join(q.select("q_row", "layer"), "q_row").join(have, "layer", "left_semi")
    other = search.exact_top_k(q, nxt, CELL, K).select("q_row", "pos", F.lit(1.0).alias("hit"))
    both = own.join(other, ["q_row", "pos"], "left")
    return both.groupBy("layer").agg(F.count("*").alias("pairs"), _r(F.avg(F.coalesce("hit", F.lit(0.0)))).alias("recall"))


@query(f"""WITH {TOP}, {LIVE}, lv AS (SELECT q_row, max(list_inner_product(q, key)) * {SCALING} AS live_top FROM qs JOIN live USING (session_id, layer, kv_head, q_head) WHERE live_step <= step GROUP BY q_row)
  SELECT layer, count(*) AS rows_, round(avg(live_top - top), 6) + 0.0 AS gap FROM (SELECT q_row, layer, max(score) * {SCALING} AS top FROM topk GROUP BY ALL) JOIN lv USING (q_row) GROUP BY layer""")
def live_vs_retrieved(spark: SparkSession, d: str) -> DataFrame:
    """By how much the best live logit exceeds the best retrieved one, averaged by layer."""
    live = _live_states(spark, d).groupBy("q_row").agg(F.max("m").alias("live_top")).join(views.queries(spark, d).select("q_row", "layer"), "q_row")
    top = _top(spark, d, 1).select("q_row", (F.col("score") * SCALING).alias("top"))
    return live.join(top, "q_row").groupBy("layer").agg(F.count("*").alias("rows_"), _r(F.avg(F.col("live_top") - F.col("top"))).alias("gap"))


@query(f"""WITH r AS (SELECT q_row, step, CAST(q AS DOUBLE[]) AS q FROM decode_rows WHERE {usable('q')}), p AS (SELECT q_row, i, q[i + 1] AS a, q[i + 9] AS b, step / pow(10000.0, i / 8.0) AS t FROM r, (SELECT unnest(range(8)) AS i))
  SELECT q_row, CAST(i AS INTEGER) AS i, round(a * cos(t) - b * sin(t), 6) + 0.0 AS first, round(a * sin(t) + b * cos(t), 6) + 0.0 AS second FROM p""")
def rope_shift(spark: SparkSession, d: str) -> DataFrame:
    """Every usable query moved on by its step; the rotary part is the first half of the numbers."""
    rows = table(spark, d, "decode_rows").where(views.usable(F.col("q")))
    moved = rows.select("q_row", vec.rope_shift(F.col("q"), F.col("step"), vec.rope_inv_freq(views.KEY_DIM, factor=0.5)).alias("v"))
    pair = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct(F.element_at("v", i + 1).alias("a"), F.element_at("v", i + 9).alias("b")))
    return moved.select("q_row", F.posexplode(pair).alias("i", "p")).select("q_row", "i", _r("p.a").alias("first"), _r("p.b").alias("second"))


@query(f"""WITH {KEYS} SELECT cache_id, layer, kv_head, CAST(i AS INTEGER) AS i, count(*) AS n, round(avg(key[i + 1]) + 1e-10, 6) + 0.0 AS mean, round(var_pop(key[i + 1]) + 1e-10, 6) + 0.0 AS var
  FROM keys, (SELECT unnest(range(32)) AS i) GROUP BY cache_id, layer, kv_head, i""")
def key_moments(spark: SparkSession, d: str) -> DataFrame:
    flat = views.keys(spark, d).select(*CELL, F.posexplode("key").alias("i", "x"))
    return flat.groupBy(*CELL, "i").agg(F.count("*").alias("n"), _r(F.avg("x") + 1e-10).alias("mean"), _r(F.var_pop("x") + 1e-10).alias("var"))
