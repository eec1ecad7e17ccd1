"""Registration of queries, each with the SQL that states the same result, and the SQL's common parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, folder) under its name, with its SQL if SQL can express it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def usable(v: str) -> str:
    return f"(len({v}) = 32 AND len(list_filter({v}, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter({v}, lambda x: x <> 0)) > 0)"


#: Keys, queries, scores of all pairs, and recorded retrievals, as in sources/views.py.
KEYS = f"""keys AS (SELECT cache_id, layer, kv_head, pos, CAST(any_value(key_vec) AS DOUBLE[]) AS key, CAST(any_value(key_vec) AS DOUBLE[])[9:16] AS value
  FROM kv WHERE {usable('key_vec')} AND pos IS NOT NULL GROUP BY cache_id, layer, kv_head, pos)"""
QS = f"""qs AS (SELECT q_row, session_id, cache_id, layer, kv_head, q_head, step, CAST(q AS DOUBLE[]) AS q FROM decode_rows WHERE q_row % 100 = 0 AND {usable('q')})"""
SCORED = f"""{KEYS}, {QS}, scored AS (SELECT q_row, cache_id, qs.layer, kv_head, pos, list_inner_product(q, key) AS score, value FROM qs JOIN keys USING (cache_id, layer, kv_head))"""
TOP = f"""{SCORED}, topk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_row ORDER BY score DESC, pos) AS rank FROM scored) WHERE rank <= 16)"""
LIVE = f"""live AS (SELECT q_row AS live_row, session_id, layer, kv_head, q_head, step AS live_step, CAST(q AS DOUBLE[]) AS key, CAST(q AS DOUBLE[])[9:16] AS value
  FROM decode_rows WHERE {usable('q')})"""
RETR = """once AS (SELECT layer, kv_head, p_row, top_ix, max(CAST(top_sc AS DOUBLE)) AS score FROM scan_hits
    WHERE top_ix >= 0 AND top_sc IS NOT NULL AND NOT isnan(top_sc) AND NOT isinf(top_sc) GROUP BY ALL),
  retr AS (SELECT layer, kv_head AS q_head, p_row AS step, rank, CAST(top_ix AS BIGINT) AS pos, score FROM (
    SELECT *, row_number() OVER (PARTITION BY layer, kv_head, p_row ORDER BY score DESC, top_ix) AS rank FROM once) WHERE rank <= 16)"""
#: Weights of each recorded row, and its group's first step of a position.
WEIGHTED = f"""{RETR}, weighted AS (SELECT *, q_head // 2 AS shard, exp(score - max(score) OVER g) / sum(exp(score)) OVER g * exp(max(score) OVER g) AS w0 FROM retr WINDOW g AS (PARTITION BY layer, q_head, step)),
  wr AS (SELECT layer, q_head, shard, step, rank, pos, score, exp(score) / sum(exp(score)) OVER (PARTITION BY layer, q_head, step) AS w FROM (SELECT * FROM weighted))"""


def dims(array: str, n: int = 8) -> str:
    """A relation of the places 0..n-1."""
    return f"(SELECT unnest(range({n})) AS i)"
