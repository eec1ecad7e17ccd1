"""The given tables as the inputs of the operators: usable keys, queries, recorded retrievals, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.sources.session import table

CELL = ["cache_id", "layer", "kv_head"]
#: Numbers of a key, of a value, hits kept of a recorded retrieval, query heads of a KV head in a recording.
KEY_DIM, VALUE_DIM, KEPT, GROUP = 32, 8, 16, 2
#: Factor from inner product to logit in the examples.
SCALING = 0.125


def usable(v: Column, dim: int = KEY_DIM) -> Column:
    """dim finite numbers, not all zero."""
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == dim) & whole & F.exists(v, lambda x: x != 0)


def keys(spark: SparkSession, d: str) -> DataFrame:
    """cell, pos, key, value: every usable key once, however often it was stored (if with several vectors, the least).

    The kv table holds keys only; the value of a position is the second eight numbers of its key.
    """
    kv = table(spark, d, "kv").where(usable(F.col("key_vec")) & F.col("pos").isNotNull())
    once = kv.groupBy(*CELL, "pos").agg(F.min("key_vec").alias("k"))
    key = F.col("k").cast("array<double>")
    return once.select(*CELL, "pos", key.alias("key"), F.slice(key, VALUE_DIM + 1, VALUE_DIM).alias("value"))


def queries(spark: SparkSession, d: str) -> DataFrame:
    """The stated set of search queries: usable decode rows whose id is divisible by 100."""
    rows = table(spark, d, "decode_rows").where((F.col("q_row") % 100 == 0) & usable(F.col("q")))
    return rows.select("q_row", "session_id", *CELL, "q_head", "step", F.col("q").cast("array<double>").alias("q"))


def live_rows(spark: SparkSession, d: str) -> DataFrame:
    """All usable decode rows as the live keys of their session; each token's own vector stands for its key."""
    rows = table(spark, d, "decode_rows").where(usable(F.col("q")))
    q = F.col("q").cast("array<double>")
    return rows.select("q_row", "session_id", *CELL, "q_head", "step", q.alias("key"), F.slice(q, VALUE_DIM + 1, VALUE_DIM).alias("value"))


def retrieved(spark: SparkSession, d: str, kept: int = KEPT) -> DataFrame:
    """layer, q_head, step, rank, pos, score: the kept best hits of every scanned row.

    A recording in long form: padding (no or a negative position, no finite score) is dropped, a position
    counts once with its best score, ties go to the smaller position. The head of the scan is the query head.
    """
    s = F.col("top_sc").cast("double")
    ok = (F.col("top_ix") >= 0) & s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf")))
    by = ["layer", "kv_head", "p_row"]
    once = table(spark, d, "scan_hits").where(ok).groupBy(*by, "top_ix").agg(F.max(s).alias("score"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "top_ix"))
    best = once.withColumn("rank", rank).where(F.col("rank") <= kept)
    return best.select("layer", F.col("kv_head").alias("q_head"), F.col("p_row").alias("step"), "rank", F.col("top_ix").cast("bigint").alias("pos"), "score")


def position_values(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """rows with v0..v7 and k0..k7, value and key of their position.

    Recorded positions have no stored vectors; position p stands for embedding p modulo their number. The
    embeddings are joined by that number, so no task needs more than its share of them.
    """
    emb = table(spark, d, "embeddings")
    n = emb.agg((F.max("vec_id") + 1).alias("n_vec"))
    e = F.col("embedding")
    cols = [e[i].cast("double").alias(f"v{i}") for i in range(VALUE_DIM)] + [e[VALUE_DIM + i].cast("double").alias(f"k{i}") for i in range(VALUE_DIM)]
    at = rows.join(F.broadcast(n)).withColumn("vec_id", F.col("pos") % F.col("n_vec")).drop("n_vec")  # n is one row
    return at.join(emb.select("vec_id", *cols), "vec_id").drop("vec_id")
