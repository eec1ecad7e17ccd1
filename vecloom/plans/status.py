"""Sessions, heads, caches, polls and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions import parse
from vecloom.operators import status, tail
from vecloom.plans import tail as tail_plans
from vecloom.plans.registry import KEYS, SQL, query
from vecloom.sources import stores, table, views

CELL2 = ["layer", "kv_head"]


@query("""WITH p AS (SELECT session_id, meta, TRY_CAST(trim(meta['context_len']) AS DOUBLE) AS c, TRY_CAST(trim(meta['scaling']) AS DOUBLE) AS s, list_filter(list_transform(string_split(coalesce(meta['layers'], ''), ','), lambda x: TRY_CAST(x AS INTEGER)), lambda x: x IS NOT NULL) AS have FROM session_meta),
  m AS (SELECT *, list_filter([3, 7], lambda x: NOT list_contains(have, x)) AS missing FROM p)
  SELECT session_id, concat_ws('; ', CASE WHEN c IS NULL THEN 'context_len ' || coalesce(meta['context_len'], 'none') END, CASE WHEN coalesce(meta['model'], '') <> 'retro-9b' THEN 'model ' || coalesce(meta['model'], 'none') END,
    CASE WHEN NOT coalesce(abs(s - 8.0) <= 1e-9, FALSE) THEN 'scaling ' || coalesce(meta['scaling'], 'none') END, CASE WHEN len(missing) > 0 THEN 'layers ' || array_to_string(missing, ',') || ' not recorded' END) AS problems FROM m""")
def session_identity(spark: SparkSession, d: str) -> DataFrame:
    """Why a session can't be used; empty if it can."""
    out = status.session_problems(table(spark, d, "session_meta"), "retro-9b", 8.0, [3, 7])
    return out.select("session_id", F.array_join("problems", "; ").alias("problems"))


def _heads(spark: SparkSession, d: str) -> DataFrame:
    """One record per head that has stored keys, with the gate that its errors give it; a head without queries isn't validated."""
    n = views.keys(spark, d).groupBy(*CELL2).agg(F.count("*").alias("n_keys"))
    gates = tail_plans.worse_gate(spark, d).withColumn("validated", F.lit(True))
    both = n.join(gates, CELL2, "left")
    false = F.lit(False)
    return both.select(*CELL2, "n_keys", F.coalesce("gate_pass", false).alias("gate_pass"), F.coalesce("validated", false).alias("validated"), F.when(F.col("kv_head") < 3, tail_plans.KEEP).otherwise(32).alias("n_retrieved"), F.coalesce("reason", F.lit("")).alias("reason"))


HEADS = f"{KEYS}, gates AS ({SQL['worse_gate']}), heads AS (SELECT n.layer, n.kv_head, n_keys, coalesce(gate_pass, FALSE) AS gate_pass, g.layer IS NOT NULL AS validated, CASE WHEN n.kv_head < 3 THEN {tail_plans.KEEP} ELSE 32 END AS n_retrieved, coalesce(reason, '') AS reason FROM (SELECT layer, kv_head, count(*) AS n_keys FROM keys GROUP BY ALL) n LEFT JOIN gates g ON g.layer = n.layer AND g.kv_head = n.kv_head), cells AS (SELECT DISTINCT layer, kv_head FROM scan_hits)"


@query(f"WITH {HEADS} SELECT layer, kv_head, n_keys, n_keys IS NULL AS missing FROM cells LEFT JOIN heads USING (layer, kv_head) UNION ALL SELECT layer, kv_head, n_keys, NULL FROM heads ANTI JOIN cells USING (layer, kv_head)")
def cells_left_files(spark: SparkSession, d: str) -> DataFrame:
    """Scanned cells with their head's record, and records of cells that weren't scanned."""
    cells, heads = table(spark, d, "scan_hits").select(*CELL2).distinct(), _heads(spark, d).select(*CELL2, "n_keys")
    left = cells.join(heads, CELL2, "left").withColumn("missing", F.col("n_keys").isNull())
    return left.unionByName(heads.join(cells, CELL2, "left_anti").withColumn("missing", F.lit(None).cast("boolean")))


STATUS = f"""{HEADS}, st AS (SELECT layer, kv_head, CASE WHEN n_keys IS NULL THEN 'no file' WHEN NOT gate_pass AND NOT validated THEN 'not validated' WHEN NOT gate_pass THEN CASE WHEN reason = '' THEN NULL ELSE 'gated off: ' || reason END
  WHEN n_retrieved <> 16 THEN 'n_retrieved ' || n_retrieved || ' is not 16' END AS reason FROM cells LEFT JOIN heads USING (layer, kv_head))"""


@query(f"WITH {STATUS} SELECT layer, kv_head, reason IS NULL AS active, reason FROM st")
def head_status(spark: SparkSession, d: str) -> DataFrame:
    return tail.status(table(spark, d, "scan_hits").select(*CELL2).distinct(), _heads(spark, d), CELL2, 16)


@query(f"""WITH {STATUS} SELECT layer, count(*) AS heads, count(*) FILTER (WHERE st.reason IS NULL) AS active, round(avg(CASE WHEN st.reason IS NULL THEN n_keys END), 4) AS keys_active, round(avg(CASE WHEN st.reason IS NOT NULL THEN n_keys END), 4) AS keys_off,
  coalesce(string_agg(CASE WHEN st.reason IS NOT NULL THEN 'L' || layer || 'H' || kv_head END, ' ' ORDER BY kv_head), '') AS off FROM st LEFT JOIN (SELECT layer, kv_head, n_keys FROM heads) h USING (layer, kv_head) GROUP BY layer""")
def head_layers(spark: SparkSession, d: str) -> DataFrame:
    """Each layer's heads: how many there are and are active, their keys on average, and the names of those that are off."""
    rows = head_status(spark, d).join(_heads(spark, d).select(*CELL2, "n_keys"), CELL2, "left")
    out = tail.layer_summary(rows, "n_keys")
    return out.withColumns({c: F.round(c, 4) for c in ("keys_active", "keys_off")})


@query(f"WITH {STATUS} SELECT coalesce(reason, 'active') AS reason, count(*) AS n FROM st GROUP BY 1")
def reason_counts(spark: SparkSession, d: str) -> DataFrame:
    return head_status(spark, d).groupBy(F.coalesce("reason", F.lit("active")).alias("reason")).agg(F.count("*").alias("n")).orderBy(F.desc("n"))


@query("""WITH p AS (SELECT cache_id, count(*) AS n, string_split(cache_id, '-')[2] AS tier FROM kv GROUP BY cache_id), v AS (SELECT *, CASE WHEN regexp_matches(tier, '^[0-9]+[kKmM]?$') THEN CAST(regexp_extract(tier, '^([0-9]+)', 1) AS BIGINT) * CASE WHEN regexp_matches(tier, '[kK]$') THEN 1000 WHEN regexp_matches(tier, '[mM]$') THEN 1000000 ELSE 1 END END AS tokens FROM p)
  SELECT cache_id, tier, tokens, greatest(1, CAST(ceil(tokens / 262144.0) AS BIGINT)) AS yarn, CASE WHEN tokens >= 1000000 AND tokens % 1000000 = 0 THEN (tokens // 1000000) || 'M' WHEN tokens >= 1000 AND tokens % 1000 = 0 THEN (tokens // 1000) || 'k' ELSE CAST(tokens AS VARCHAR) END AS label FROM v""")
def tier_parse(spark: SparkSession, d: str) -> DataFrame:
    """The context length in a cache's name, the rotary factor for it, and its label."""
    rows = table(spark, d, "kv").select("cache_id").distinct().withColumn("tier", F.try_element_at(F.split("cache_id", "-"), F.lit(2)))
    rows = rows.withColumn("tokens", parse.size_to_tokens(F.col("tier")))
    return rows.select("cache_id", "tier", "tokens", parse.yarn_factor(F.col("tokens")).alias("yarn"), parse.tokens_to_label(F.col("tokens")).alias("label"))


@query(f"""WITH {HEADS}, c AS (SELECT unnest([8, 64, 256]) AS cut), s AS (SELECT unnest(['2000', '-16', '10%', '-5.5%', '2.5', 'x']) AS shift),
  x AS (SELECT *, regexp_matches(shift, '^[+-]?[0-9]+(\\.[0-9]+)?%?$') AND (shift LIKE '%\\%' ESCAPE '\\' OR shift NOT LIKE '%.%') AS ok, TRY_CAST(replace(shift, '%', '') AS DOUBLE) AS num FROM heads, c, s)
  SELECT layer, kv_head, CAST(cut AS INTEGER) AS cut, shift, CASE WHEN ok THEN CAST(least(greatest(cut + round(CASE WHEN shift LIKE '%\\%' ESCAPE '\\' THEN cut * num / 100 ELSE num END), 1), n_keys - 1) AS BIGINT) END AS shifted FROM x""")
def cut_shift(spark: SparkSession, d: str) -> DataFrame:
    """Cuts moved by shifts, within the number of keys of each head."""
    each = _heads(spark, d).select(*CELL2, "n_keys", F.explode(F.array(*[F.lit(c) for c in (8, 64, 256)])).alias("cut"))
    each = each.withColumn("shift", F.explode(F.array(*[F.lit(s) for s in ("2000", "-16", "10%", "-5.5%", "2.5", "x")])))
    return each.select(*CELL2, "cut", "shift", parse.shift_cut(F.col("cut"), F.col("shift"), F.col("n_keys")).alias("shifted"))


@query(f"WITH {HEADS} SELECT layer, kv_head, unnest(list_filter(list_transform(range(41), lambda k: CAST(pow(2, k) AS BIGINT)), lambda x: x >= 4 AND x <= n_keys)) AS cut FROM heads")
def ladder(spark: SparkSession, d: str) -> DataFrame:
    """The candidate cuts of each head: powers of two from 4 to its number of keys."""
    return _heads(spark, d).select(*CELL2, F.explode(parse.ladder(F.lit(4), F.col("n_keys"))).alias("cut"))


@query("""SELECT source, doc_id, CAST(rank AS INTEGER) AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY added_at DESC NULLS LAST, doc_id) AS rank FROM documents) WHERE rank <= 4""")
def lru_evict(spark: SparkSession, d: str) -> DataFrame:
    """The four newest entries of each source; the others would be evicted."""
    docs = table(spark, d, "documents").select("source", "doc_id", "added_at")
    return status.keep_newest(docs, ["source"], [F.col("added_at").desc_nulls_last(), F.col("doc_id")], 4).select("source", "doc_id", "rank")


@query("""SELECT event_id, user_id, ready, ready AND coalesce(lag(ready, 1) OVER w, FALSE) AND coalesce(lag(ready, 2) OVER w, FALSE) AS stable FROM (SELECT *, event_type <> 'error' AND value > 0 AS ready FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def poll_stable(spark: SparkSession, d: str) -> DataFrame:
    """Polls of each index (user): ready if there is no error and a value, stable if so three times in a row."""
    ready = (F.col("event_type") != "error") & (F.col("value") > 0)
    return status.stable(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], ready, 3).select("event_id", "user_id", "ready", "stable")


@query("""WITH c AS (SELECT DISTINCT layer, kv_head FROM scan_hits), n AS (SELECT layer, kv_head, row_number() OVER (PARTITION BY layer ORDER BY kv_head) - 1 AS place, dense_rank() OVER (ORDER BY layer) - 1 AS l, count(*) OVER (PARTITION BY layer) AS k FROM c)
  SELECT layer, kv_head, CAST(2 * l + place // 3 AS INTEGER) AS batch FROM n""")
def plan_batches(spark: SparkSession, d: str) -> DataFrame:
    """The scanned heads in batches of three; a layer of four is split into two."""
    return status.plan_batches(table(spark, d, "scan_hits").select(*CELL2).distinct(), 3)


@query("SELECT DISTINCT cache_id, layer, kv_head, left(sha1(concat_ws('|', cache_id, layer, kv_head)), 16) AS key, printf('layer%02d_head%d', layer, kv_head) AS file, printf('L%dH%d', layer, kv_head) AS cell FROM kv")
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Content key, file name and cell name of every collection."""
    cells = table(spark, d, "kv").select(*views.CELL).distinct()
    layer, head = F.col("layer"), F.col("kv_head")
    return cells.select("*", parse.cache_key(F.col("cache_id"), layer.cast("string"), head.cast("string")).alias("key"), parse.head_file(layer, head).alias("file"), parse.cell_name(layer, head).alias("cell"))


@query("""WITH t AS (SELECT coalesce(config, 'none') AS phase, CASE WHEN NOT isnan(gen_seconds) AND NOT isinf(gen_seconds) AND gen_seconds >= 0 THEN gen_seconds END AS s FROM eval_rows)
  SELECT phase, count(s) AS n, round(coalesce(sum(s), 0), 4) AS total, round(avg(s), 5) AS mean FROM t GROUP BY phase HAVING count(s) > 0""")
def timers(spark: SparkSession, d: str) -> DataFrame:
    """Count, sum and mean of the times of each phase (config); phases without a valid time are hidden."""
    s = F.col("gen_seconds")
    ok = F.when(s.isNotNull() & ~F.isnan(s) & (s >= 0) & (s < F.lit(float("inf"))), s)
    rows = table(spark, d, "eval_rows").select(F.coalesce("config", F.lit("none")).alias("phase"), ok.alias("s"))
    return rows.groupBy("phase").agg(F.count("s").alias("n"), F.round(F.sum("s"), 4).alias("total"), F.round(F.avg("s"), 5).alias("mean")).where("n > 0")


@query("""SELECT 'hits' AS analysis, CAST(layer AS VARCHAR) AS size, kv_head, count(*) AS n, count(DISTINCT top_ix) AS positions FROM scan_hits GROUP BY layer, kv_head""")
def envelope_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Results written as JSON envelopes, one per layer, and read again."""
    rows = table(spark, d, "scan_hits").groupBy("layer", "kv_head").agg(F.count("*").alias("n"), F.countDistinct("top_ix").alias("positions"))
    at = stores.scratch(spark)
    stores.save_envelopes(status.envelope(rows.select("layer", "kv_head", "n", "positions"), "hits", {"kept": "all"}, F.col("layer").cast("string")), at)
    return status.read_envelope(stores.load_envelopes(spark, at), "kv_head: int, n: bigint, positions: bigint")


@query("""SELECT tier, capacity_tokens, CAST(list_position(['2k', '4k', '16k', '8k'], tier) AS INTEGER) AS place FROM tiers WHERE list_contains(['2k', '4k', '16k', '8k'], tier)""")
def size_order(spark: SparkSession, d: str) -> DataFrame:
    """The tiers in a fixed order; sizes that it doesn't name are left out."""
    return status.in_order(table(spark, d, "tiers").select("tier", "capacity_tokens"), "tier", ["2k", "4k", "16k", "8k"])


@query("""SELECT session_id, TRY_CAST(regexp_extract(session_id, '([0-9]+)$', 1) AS BIGINT) AS number, count(*) AS rows_, count(DISTINCT step) AS steps, s.session_id IS NOT NULL AND m.meta IS NOT NULL AS has_meta
  FROM decode_rows s LEFT JOIN session_meta m USING (session_id) GROUP BY ALL""")
def session_files(spark: SparkSession, d: str) -> DataFrame:
    """Recorded sessions, the number that ends their name, and whether their metadata are there."""
    rows = table(spark, d, "decode_rows").groupBy("session_id").agg(F.count("*").alias("rows_"), F.countDistinct("step").alias("steps"))
    meta = table(spark, d, "session_meta").select("session_id", F.lit(True).alias("m"))
    number = F.regexp_extract("session_id", r"(\d+)$", 1).try_cast("bigint")
    return rows.join(meta, "session_id", "left").select("session_id", number.alias("number"), "rows_", "steps", F.coalesce("m", F.lit(False)).alias("has_meta"))


@query("""WITH q AS (SELECT DISTINCT cache_id, layer, kv_head, q_head FROM decode_rows WHERE regexp_matches(printf('L%dH%d', layer, kv_head), '^L(3|15)H[0-9]+$'))
  SELECT cache_id, layer, kv_head, count(*) AS heads FROM q GROUP BY ALL""")
def cell_selection(spark: SparkSession, d: str) -> DataFrame:
    """Query heads of chosen cells: some by name, the others all pairs of layers and heads. Cells that hold nothing select nothing."""
    wanted = parse.cells(["L3H0", "l3h1"]) + [(15, h) for h in range(64)] + [(3, h) for h in range(2, 64)]
    rows = table(spark, d, "decode_rows").select(*views.CELL, "q_head").distinct()
    return status.select_cells(rows, sorted(set(wanted)), strict=False).groupBy(*views.CELL).agg(F.count("*").alias("heads"))
