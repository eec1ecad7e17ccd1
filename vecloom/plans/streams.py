"""Streams run over all that has arrived, held against their batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.plans.registry import query
from vecloom.sources import stores, views
from vecloom.sources.session import ship
from vecloom.sources.views import GROUP
from vecloom.streaming import policies

def _path(d: str) -> str:
    """The table as a pattern, since a stream takes a single file only by one."""
    return f"{d}/scan_hits.parque[t]"


OK = "top_ix >= 0 AND top_sc IS NOT NULL AND NOT isnan(top_sc) AND NOT isinf(top_sc)"


@query(f"SELECT layer, shard, count(*) AS positions FROM (SELECT DISTINCT layer, CAST(kv_head // 2 AS INTEGER) AS shard, top_ix FROM scan_hits WHERE {OK}) GROUP BY ALL")
def stream_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Positions that a stream of hits meets for the first time, counted by shard."""
    ship(spark)
    seen = policies.run_to_end(spark, policies.first_seen(policies.hits(spark, _path(d)), GROUP))
    return seen.groupBy("layer", "shard").agg(F.count("*").alias("positions"))


@query(f"SELECT layer, CAST(kv_head // 2 AS INTEGER) AS shard, CAST(top_ix AS BIGINT) AS pos, min(p_row) AS since FROM scan_hits WHERE {OK} AND top_sc >= 4.0 GROUP BY ALL")
def stream_admissions(spark: SparkSession, d: str) -> DataFrame:
    """When each position of a shard is admitted to its cache, from a stream of hits in any order."""
    ship(spark)
    return policies.latest(spark, policies.admissions(policies.hits(spark, _path(d)), GROUP, 4.0), ["layer", "shard", "pos"], "since")


@query("""SELECT cache_id, layer, kv_head, count(*) AS n, CAST(sum(pos) AS BIGINT) AS total FROM (SELECT DISTINCT cache_id, layer, kv_head, pos FROM kv
  WHERE len(key_vec) = 32 AND len(list_filter(key_vec, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(key_vec, lambda x: x <> 0)) > 0 AND pos IS NOT NULL) GROUP BY ALL""")
def cache_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The usable keys stored by cache, layer and head, and read again."""
    at = stores.scratch(spark)
    f32 = lambda c: F.col(c).cast("array<float>").alias(c)
    stores.save_cache(views.keys(spark, d).select(*views.CELL, "pos", f32("key"), f32("value")), at)
    return stores.load_cache(spark, at).groupBy(*views.CELL).agg(F.count("*").alias("n"), F.sum("pos").alias("total"))
