"""Analytics over recorded retrievals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators import logs
from vecloom.plans.registry import RETR, query
from vecloom.sources import views
from vecloom.sources.views import GROUP, VALUE_DIM

CONTEXT, BINS = 1 << 20, 512
TAUS = [0.0, 1e-2, 3e-2, 1e-1, 3e-1]
HEADS = [1, 2, 4, 8]

R = RETR + ", r AS (SELECT *, q_head // 2 AS shard, exp(score) / sum(exp(score)) OVER (PARTITION BY layer, q_head, step) AS w FROM retr)"
FIRST = f"{R}, firsts AS (SELECT layer, shard, pos, min(step) AS first FROM r GROUP BY ALL)"
VAL = f"""{R}, nv AS (SELECT max(vec_id) + 1 AS n FROM embeddings), rv AS (SELECT r.*, CAST(e.embedding AS DOUBLE[])[1:8] AS v, CAST(e.embedding AS DOUBLE[])[9:16] AS k FROM r, nv JOIN embeddings e ON e.vec_id = r.pos % nv.n)"""


def _r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)


def _values(spark: SparkSession, d: str) -> DataFrame:
    return views.position_values(spark, d, views.retrieved(spark, d))


@query(f"WITH {RETR} SELECT layer, q_head, step, CAST(rank AS INTEGER) AS rank, pos, round(score, 5) + 0.0 AS score FROM retr")
def retrieval_log(spark: SparkSession, d: str) -> DataFrame:
    """The recording itself: the 16 best hits of every scanned row in long form."""
    return views.retrieved(spark, d).withColumn("score", _r("score", 5))


@query(f"""WITH {RETR}, h AS (SELECT layer, q_head, count(DISTINCT pos) AS t, count(*) AS n FROM retr GROUP BY ALL), c AS (SELECT layer, 1 - avg(t) / avg(n) AS hit_ceiling FROM h GROUP BY layer),
  s AS (SELECT layer, q_head, step, count(*) AS k FROM retr GROUP BY ALL), m AS (SELECT a.layer, a.q_head, a.step, count(*) AS same FROM retr a JOIN retr b ON a.layer = b.layer AND a.q_head = b.q_head AND a.step = b.step + 1 AND a.pos = b.pos GROUP BY ALL),
  t AS (SELECT s.layer, avg(coalesce(same, 0) / s.k) AS retention FROM s JOIN s p ON p.layer = s.layer AND p.q_head = s.q_head AND p.step + 1 = s.step LEFT JOIN m ON m.layer = s.layer AND m.q_head = s.q_head AND m.step = s.step GROUP BY s.layer)
  SELECT layer, round(hit_ceiling, 6) + 0.0 AS hit_ceiling, round(retention, 6) + 0.0 AS retention FROM c LEFT JOIN t USING (layer)""")
def layer_reuse(spark: SparkSession, d: str) -> DataFrame:
    return logs.layer_reuse(views.retrieved(spark, d)).select("layer", _r("hit_ceiling").alias("hit_ceiling"), _r("retention").alias("retention"))


@query(f"WITH {RETR} SELECT layer, round(avg(x), 6) + 0.0 AS redundancy FROM (SELECT layer, step, count(*) / count(DISTINCT pos) AS x FROM retr GROUP BY ALL) GROUP BY layer")
def redundancy(spark: SparkSession, d: str) -> DataFrame:
    return logs.redundancy(views.retrieved(spark, d)).select("layer", _r("redundancy").alias("redundancy"))


@query(f"WITH {RETR} SELECT layer, step, CAST(pos * {BINS} // {CONTEXT} AS INTEGER) AS bin, count(DISTINCT q_head) AS heads FROM retr GROUP BY ALL")
def heatmap_bins(spark: SparkSession, d: str) -> DataFrame:
    return logs.heatmap(views.retrieved(spark, d), CONTEXT, BINS)


@query(f"WITH {FIRST} SELECT layer, CAST(shard AS INTEGER) AS shard, first AS step, count(*) AS fresh FROM firsts GROUP BY ALL")
def new_positions(spark: SparkSession, d: str) -> DataFrame:
    return logs.new_positions(views.retrieved(spark, d), GROUP)


CURVE = f"{FIRST}, curve AS (SELECT step, CAST(sum(coalesce(f, 0)) OVER (ORDER BY step) AS BIGINT) AS total FROM (SELECT DISTINCT step FROM r) LEFT JOIN (SELECT first AS step, count(*) AS f FROM firsts GROUP BY first) USING (step))"


@query(f"WITH {CURVE} SELECT step, total FROM curve")
def download_curve(spark: SparkSession, d: str) -> DataFrame:
    return logs.download_curve(views.retrieved(spark, d), GROUP)


@query(f"""WITH {CURVE}, n AS (SELECT count(*) AS n FROM curve), w AS (SELECT DISTINCT CAST(round_even(id * (n - 1) / 19.0, 0) AS BIGINT) AS place FROM n, (SELECT unnest(range(20)) AS id))
  SELECT step, total FROM (SELECT *, row_number() OVER (ORDER BY step) - 1 AS place FROM curve) JOIN w USING (place)""")
def downsample_curve(spark: SparkSession, d: str) -> DataFrame:
    """The download curve at 20 evenly spaced steps."""
    return logs.downsample(logs.download_curve(views.retrieved(spark, d), GROUP), "step", 20)


@query(f"""WITH {FIRST} SELECT layer, step, round(avg(f), 6) + 0.0 AS fresh FROM (SELECT layer, step, q_head, sum(CASE WHEN first = step THEN w ELSE 0 END) AS f FROM r JOIN firsts USING (layer, shard, pos) GROUP BY ALL) GROUP BY ALL""")
def weight_mass_new(spark: SparkSession, d: str) -> DataFrame:
    return logs.weight_mass_new(views.retrieved(spark, d), GROUP).withColumn("fresh", _r("fresh"))


@query(f"""WITH {FIRST}, g AS (SELECT layer, step, q_head, count(*) AS fresh FROM r JOIN firsts USING (layer, shard, pos) WHERE first = step GROUP BY ALL)
  SELECT layer, step, CAST(sum(fresh) AS BIGINT) AS fresh, CAST(max(fresh) AS BIGINT) AS most FROM g GROUP BY ALL""")
def unique_per_step(spark: SparkSession, d: str) -> DataFrame:
    """New positions of each step, counted for every head that retrieves them in it."""
    retr = views.retrieved(spark, d)
    rows = logs.sharded(retr, GROUP).join(logs.first_steps(retr, GROUP), [*logs.SHARD, "pos"]).where("first = step")
    head = rows.groupBy("layer", "step", "q_head").agg(F.count("*").alias("fresh"))
    return head.groupBy("layer", "step").agg(F.sum("fresh").alias("fresh"), F.max("fresh").alias("most"))


TAU = f"{R}, tau AS (SELECT unnest({TAUS}) AS tau), best AS (SELECT layer, shard, pos, step, max(w) AS b FROM r GROUP BY ALL), adm AS (SELECT tau, layer, shard, pos, min(step) AS since FROM best, tau WHERE b >= tau GROUP BY ALL)"


@query(f"""WITH {TAU}, l AS (SELECT tau.tau, sum(CASE WHEN since <= step THEN 0 ELSE w END) AS lost, sum(w) AS a FROM r CROSS JOIN tau LEFT JOIN adm ON adm.tau = tau.tau AND adm.layer = r.layer AND adm.shard = r.shard AND adm.pos = r.pos GROUP BY tau.tau),
  n AS (SELECT tau, count(*) AS n FROM adm GROUP BY tau) SELECT CAST(tau AS DOUBLE) AS tau, round(coalesce(n, 0) / (SELECT count(*) FROM (SELECT DISTINCT layer, shard, pos FROM r)), 6) + 0.0 AS download, round(1 - lost / a, 6) + 0.0 AS retained FROM l LEFT JOIN n USING (tau)""")
def threshold_policy(spark: SparkSession, d: str) -> DataFrame:
    return logs.threshold_policy(views.retrieved(spark, d), GROUP, TAUS).select("tau", _r("download").alias("download"), _r("retained").alias("retained"))


@query(f"""WITH {VAL}, tau AS (SELECT unnest({TAUS}) AS tau), best AS (SELECT layer, shard, pos, step, max(w) AS b FROM r GROUP BY ALL), adm AS (SELECT tau, layer, shard, pos, min(step) AS since FROM best, tau WHERE b >= tau GROUP BY ALL),
  e AS (SELECT tau.tau, rv.layer, q_head, step, i, sum(w * v[i + 1]) AS f, sum(CASE WHEN since <= step THEN w * v[i + 1] ELSE 0 END) AS k, sum(CASE WHEN since <= step THEN w ELSE 0 END) AS mass
    FROM rv CROSS JOIN tau CROSS JOIN (SELECT unnest(range(8)) AS i) LEFT JOIN adm ON adm.tau = tau.tau AND adm.layer = rv.layer AND adm.shard = rv.shard AND adm.pos = rv.pos GROUP BY ALL)
  SELECT CAST(tau AS DOUBLE) AS tau, round(avg(pow(f - CASE WHEN mass > 0 THEN k / mass ELSE 0 END, 2)), 7) + 0.0 AS mse FROM e GROUP BY tau""")
def threshold_mse(spark: SparkSession, d: str) -> DataFrame:
    return logs.threshold_mse(_values(spark, d), GROUP, TAUS, VALUE_DIM).withColumn("mse", _r("mse", 7))


@query(f"""WITH {VAL}, hs AS (SELECT unnest({HEADS}) AS h), q AS (SELECT h, layer, shard, q_head, step, i, sum(CASE WHEN rank <= h THEN w ELSE 0 END) AS wh, sum(CASE WHEN rank <= h THEN 0 ELSE 1 END) AS nt, sum(w * v[i + 1]) AS f,
    sum(CASE WHEN rank <= h THEN w * v[i + 1] ELSE 0 END) AS o, sum(CASE WHEN rank <= h THEN 0 ELSE v[i + 1] END) AS t FROM rv, hs, (SELECT unnest(range(8)) AS i) GROUP BY ALL),
  s AS (SELECT h, layer, shard, step, i, sum(t) AS t, sum(nt) AS nt FROM q GROUP BY ALL),
  x AS (SELECT h, layer, shard, step, i, sum(t) OVER c AS rt, sum(nt) OVER c AS rn, sum(t) OVER w AS wt, sum(nt) OVER w AS wn FROM s
    WINDOW c AS (PARTITION BY h, layer, shard, i ORDER BY step), w AS (PARTITION BY h, layer, shard, i ORDER BY step RANGE BETWEEN 31 PRECEDING AND CURRENT ROW))
  SELECT CAST(h AS INTEGER) AS h, round(avg(pow(f - o / greatest(wh, 1e-9), 2)), 7) + 0.0 AS dropped, round(avg(pow(f - o - (1 - wh) * CASE WHEN nt > 0 THEN q.t / nt ELSE 0 END, 2)), 7) + 0.0 AS in_step,
    round(avg(pow(f - o - (1 - wh) * CASE WHEN rn > 0 THEN rt / rn ELSE 0 END, 2)), 7) + 0.0 AS causal, round(avg(pow(f - o - (1 - wh) * CASE WHEN wn > 0 THEN wt / wn ELSE 0 END, 2)), 7) + 0.0 AS "window"
  FROM q JOIN x USING (h, layer, shard, step, i) GROUP BY h""")
def meanfield_tail(spark: SparkSession, d: str) -> DataFrame:
    out = logs.meanfield(_values(spark, d), GROUP, HEADS, VALUE_DIM)
    return out.select("h", *[_r(c, 7).alias(c) for c in ("dropped", "in_step", "causal", "window")])


@query(f"""WITH {VAL}, hs AS (SELECT unnest([2, 4]) AS h), cache AS (SELECT h, layer, shard, pos, min(step) AS since, any_value(v) AS cv, any_value(k) AS ck FROM rv, hs WHERE rank <= h GROUP BY ALL),
  u AS (SELECT hs.h, rv.*, coalesce(since <= step, FALSE) AS cached FROM rv CROSS JOIN hs LEFT JOIN cache c ON c.h = hs.h AND c.layer = rv.layer AND c.shard = rv.shard AND c.pos = rv.pos),
  nn AS (SELECT h, layer, shard, pos, step, cv FROM (SELECT o.h, o.layer, o.shard, o.pos, o.step, c.cv, row_number() OVER (PARTITION BY o.h, o.layer, o.shard, o.pos, o.step ORDER BY list_distance(o.k, c.ck), c.pos) AS rn
    FROM (SELECT DISTINCT h, layer, shard, pos, step, k FROM u WHERE NOT cached AND step % 100 = 0) o JOIN cache c ON c.h = o.h AND c.layer = o.layer AND c.shard = o.shard AND c.since <= o.step) WHERE rn = 1),
  q AS (SELECT u.h, u.layer, q_head, u.step, i, sum(CASE WHEN cached THEN w ELSE 0 END) AS mass, sum(CASE WHEN cached THEN 0 ELSE 1 END) AS n_open, sum(CASE WHEN cached THEN 0 ELSE w END) AS w_open, sum(w * v[i + 1]) AS f,
    sum(CASE WHEN cached THEN w * v[i + 1] ELSE 0 END) AS kept, sum(CASE WHEN cached THEN 0 ELSE v[i + 1] END) AS op, sum(CASE WHEN cached THEN w * v[i + 1] ELSE w * coalesce(cv[i + 1], v[i + 1]) END) AS sub
    FROM u LEFT JOIN nn USING (h, layer, shard, pos, step) CROSS JOIN (SELECT unnest(range(8)) AS i) GROUP BY u.h, u.layer, q_head, u.step, i)
  SELECT CAST(q.h AS INTEGER) AS h, round(any_value(dl), 6) + 0.0 AS download, round(avg(pow(f - kept / greatest(mass, 1e-9), 2)), 7) + 0.0 AS mse_drop, round(avg(pow(f - kept - w_open * op / greatest(n_open, 1), 2)), 7) + 0.0 AS mse_mean, round(avg(pow(f - sub, 2)) FILTER (WHERE q.step % 100 = 0), 7) + 0.0 AS mse_cached
  FROM q JOIN (SELECT h, count(*) / (SELECT count(*) FROM (SELECT DISTINCT layer, shard, pos FROM r)) AS dl FROM cache GROUP BY h) z ON z.h = q.h GROUP BY q.h""")
def cached_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Substitution by the nearest cached value for the steps divisible by 100, against the whole cache; other errors over all steps."""
    out = logs.cached_reuse(_values(spark, d), GROUP, [2, 4], VALUE_DIM, F.col("step") % 100 == 0)
    return out.select("h", _r("download").alias("download"), *[_r(c, 7).alias(c) for c in ("mse_drop", "mse_mean", "mse_cached")])


COVER = f"{RETR}, p AS (SELECT DISTINCT layer, step, pos FROM retr), f AS (SELECT step, pos, min(layer) AS earliest FROM p GROUP BY ALL)"


@query(f"""WITH {COVER} SELECT layer, round(avg(c), 6) + 0.0 AS coverage FROM (SELECT p.layer, p.step, avg(CASE WHEN earliest < p.layer THEN 1.0 ELSE 0.0 END) AS c FROM p LEFT JOIN f USING (step, pos) GROUP BY ALL)
  WHERE layer > (SELECT min(layer) FROM p) GROUP BY layer""")
def cross_layer_coverage(spark: SparkSession, d: str) -> DataFrame:
    return logs.layer_coverage(views.retrieved(spark, d)).withColumn("coverage", _r("coverage"))


@query(f"""WITH {COVER} SELECT layer, round(avg(c), 6) + 0.0 AS coverage FROM (SELECT p.layer, p.step, avg(CASE WHEN earliest < p.layer THEN 1.0 ELSE 0.0 END) AS c FROM p LEFT JOIN f ON f.step = p.step ^ 1 AND f.pos = p.pos GROUP BY ALL)
  WHERE layer > (SELECT min(layer) FROM p) GROUP BY layer""".replace("p.step ^ 1", "xor(p.step, 1)"))
def permuted_baseline(spark: SparkSession, d: str) -> DataFrame:
    """Coverage by the earlier layers of another step: neighbouring steps are swapped in pairs."""
    return logs.layer_coverage(views.retrieved(spark, d), F.col("step").bitwiseXOR(F.lit(1).cast("bigint"))).withColumn("coverage", _r("coverage"))


@query(f"""WITH {R}, s AS (SELECT * FROM r WHERE rank <= 8), c AS (SELECT x.layer, x.shard, x.pos AS a, y.pos AS b, count(*) AS queries FROM s x JOIN s y ON x.layer = y.layer AND x.q_head = y.q_head AND x.step = y.step AND x.pos <> y.pos GROUP BY ALL)
  SELECT layer, CAST(shard AS INTEGER) AS shard, a, b, queries, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY layer, shard, a ORDER BY queries DESC, b) AS rank FROM c) WHERE rank <= 4""")
def coretrieval_edges(spark: SparkSession, d: str) -> DataFrame:
    return logs.coretrieval_edges(views.retrieved(spark, d), GROUP, 8, 4)


@query(f"""WITH {RETR} SELECT layer, step, round(avg(top), 5) + 0.0 AS top, round(avg(least), 5) + 0.0 AS least, round(avg(mean), 5) + 0.0 AS mean, count(*) AS heads
  FROM (SELECT layer, q_head, step, max(score) AS top, min(score) AS least, avg(score) AS mean FROM retr GROUP BY ALL) GROUP BY ALL""")
def score_stats(spark: SparkSession, d: str) -> DataFrame:
    """Best, weakest and mean kept score of each step, averaged over heads."""
    head = views.retrieved(spark, d).groupBy("layer", "q_head", "step").agg(F.max("score").alias("top"), F.min("score").alias("least"), F.avg("score").alias("mean"))
    return head.groupBy("layer", "step").agg(*[_r(F.avg(c), 5).alias(c) for c in ("top", "least", "mean")], F.count("*").alias("heads"))


@query(f"WITH {RETR} SELECT layer, q_head, count(*) AS rows_, count(DISTINCT pos) AS distinct_, count(DISTINCT step) AS steps FROM retr GROUP BY ALL")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return views.retrieved(spark, d).groupBy("layer", "q_head").agg(F.count("*").alias("rows_"), F.countDistinct("pos").alias("distinct_"), F.countDistinct("step").alias("steps"))
