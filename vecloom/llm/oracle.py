"""SQL for those pN_ queries whose result SQL can state."""

from __future__ import annotations

import math

from vecloom.llm import percentiles
from vecloom.llm.queries import PERCENTILES, TIMES

P2 = """
WITH k AS (SELECT DISTINCT cache_id, layer, kv_head, pos, CAST(key_vec AS DOUBLE[]) AS v FROM kv
    WHERE len(key_vec) = 32 AND len(list_filter(key_vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(key_vec, lambda x: x <> 0)) > 0),
  q AS (SELECT q_row, cache_id, layer, kv_head, CAST(q AS DOUBLE[]) AS v FROM decode_rows
    WHERE len(q) = 32 AND len(list_filter(q, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(q, lambda x: x <> 0)) > 0)
SELECT q_row, top_ix FROM (
  SELECT q_row, pos AS top_ix, row_number() OVER (PARTITION BY q_row ORDER BY list_inner_product(k.v, q.v) DESC, pos) AS place
  FROM q JOIN k USING (cache_id, layer, kv_head))
WHERE place <= 10
"""

P3 = """
SELECT layer, kv_head, p_row, CAST(place AS INTEGER) AS place, top_ix FROM (
  SELECT *, row_number() OVER (PARTITION BY layer, kv_head, p_row ORDER BY sc DESC, top_ix) AS place FROM (
    SELECT layer, kv_head, p_row, top_ix, max(top_sc) AS sc FROM scan_hits
    WHERE top_ix >= 0 AND top_sc IS NOT NULL AND NOT isnan(top_sc) AND NOT isinf(top_sc)
    GROUP BY ALL))
WHERE place <= 8
"""


def _p5_counts() -> str:
    log_g = repr(math.log((1 + percentiles.ALPHA) / (1 - percentiles.ALPHA)))
    return " UNION ALL ".join(
        f"""SELECT config, bucket AS run_bucket, CAST(started_at AS DATE) AS day, '{c}' AS metric,
            CASE WHEN abs({c}) < {percentiles.LEAST} THEN 0
                 ELSE sign({c}) * (ceil(ln(abs({c})) / {log_g}) + 1000000) END AS bin
            FROM eval_rows WHERE {c} IS NOT NULL AND NOT isnan({c}) AND NOT isinf({c})"""
        for c in TIMES
    )


def _p5() -> str:
    g = (1 + percentiles.ALPHA) / (1 - percentiles.ALPHA)
    ps = ", ".join(f"({p})" for p in PERCENTILES)
    return f"""
    WITH v AS ({_p5_counts()}),
    b AS (SELECT 'config' AS "by", config, CAST(NULL AS INTEGER) AS run_bucket, CAST(NULL AS DATE) AS day, metric, bin FROM v
      UNION ALL SELECT 'config, run_bucket', config, run_bucket, NULL, metric, bin FROM v
      UNION ALL SELECT 'config, run_bucket, day', config, run_bucket, day, metric, bin FROM v
      UNION ALL SELECT 'config, day', config, NULL, day, metric, bin FROM v),
    r AS (SELECT *, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY "by", config, run_bucket, day, metric) AS n
      FROM b WINDOW w AS (PARTITION BY "by", config, run_bucket, day, metric ORDER BY bin))
    SELECT "by", config, run_bucket, day, metric, n, CAST(p AS DOUBLE) AS p,
      round(CASE WHEN bin = 0 THEN 0.0 ELSE sign(bin) * (pow({g!r}, abs(bin) - 1000000) * {2 / (1 + g)!r}) END, 6) AS value
    FROM r, (VALUES {ps}) AS q(p) WHERE k = CAST(floor(p * (n - 1)) AS BIGINT)
    """


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": P2,
        "p3_found": P3,
        "p5_percentiles": _p5(),
        "p5_sketch": f"SELECT config, day, metric, CAST(bin AS INTEGER) AS bin, count(*) AS n FROM ({_p5_counts()}) GROUP BY ALL",
    }
