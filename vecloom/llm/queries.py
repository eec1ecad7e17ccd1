"""The pN_ queries: each problem's operator over its whole tables, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm import garbled, nearest, packing, pairs, percentiles, tokens, topn, truncated
from vecloom.sources import table

TIMES = ["gen_seconds", "retrieval_seconds"]
PERCENTILES = [0.5, 0.9, 0.95, 0.99]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "eval_rows"), table(spark, d, "eval_examples"), table(spark, d, "documents"))


CELL = ["cache_id", "layer", "kv_head"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = nearest.top_k(table(spark, d, "decode_rows"), table(spark, d, "kv"), CELL, "q_row", "q", "pos", "key_vec", 32)
    return found.select("q_row", F.col("pos").alias("top_ix"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "scan_hits")
    return topn.top_n_per_group(hits, ["layer", "kv_head", "p_row"], "top_sc", "top_ix", 8).select("layer", "kv_head", "p_row", "place", "top_ix")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return truncated.truncated(table(spark, d, "eval_rows"), "row_id", "gen", "runner", "label", "gen_tokens")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """The share of truncated rows of every runner, its baseline of complete texts without a terminator, and the evidence."""
    out = truncated.by_source(table(spark, d, "eval_rows"), "row_id", "gen", "runner", "label", "gen_tokens")
    return out.withColumns({c: F.round(c, 6) for c in ("share", "baseline")})


KEYS = ["config", "run_bucket", "day"]


def _time_counts(spark: SparkSession, d: str) -> DataFrame:
    """Sketches by config, bucket and day, the finest that are asked for; all others are sums of these."""
    rows = table(spark, d, "eval_rows").select("config", F.col("bucket").alias("run_bucket"), F.to_date("started_at").alias("day"), *TIMES)
    return percentiles.sketch(rows, KEYS, TIMES)


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of both times by config, with and without bucket and day, all read off combined sketches of days."""
    out = percentiles.percentiles(percentiles.roll_up(_time_counts(spark, d), KEYS, [KEYS[:1], KEYS[:2], ["config", "day"], KEYS]), ["by", *KEYS], PERCENTILES)
    return out.withColumn("value", F.round("value", 6)).withColumnRenamed("column", "metric")


def p5_sketch(spark: SparkSession, d: str) -> DataFrame:
    """The counts by config and day, as they would be stored to be combined later."""
    days = percentiles.merge([_time_counts(spark, d)], ["config", "day"])
    return days.select("config", "day", F.col("column").alias("metric"), F.col("bucket").alias("bin"), F.col("count").alias("n"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"), "doc_id", "text")


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    """The ids of the garbled documents as restored, encoded again only near what was restored."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    fixed = p8_restored(spark, d).where(F.col("restored").isNotNull()).select("doc_id", "restored")
    both = docs.join(fixed, "doc_id").checkpoint()
    known = tokens.token_ids(both, "doc_id", "text")
    return tokens.edited_ids(both.join(known, "doc_id"), "doc_id", "text", "ids", "restored")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document, or piece of one that exceeds the capacity, with its container in each tier."""
    sizes = tokens.token_sizes(table(spark, d, "documents"), "doc_id", "text")
    return packing.pack(sizes, "doc_id", "size", table(spark, d, "tiers"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.report(p7_containers(spark, d), table(spark, d, "tiers"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled.garbled(table(spark, d, "documents"), "doc_id", "text", "source")


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with their original text where it can be had."""
    return garbled.restored(table(spark, d, "documents"), "doc_id", "text", "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p4_report, p5_percentiles, p5_sketch, p6_ids, p6_restored, p7_containers, p7_report, p8_found, p8_restored)}
