"""Stored caches, recordings, heads and prompts: explicit schemas, partitioned Parquet, checks on open."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.sources.session import shared_folder

KV_SCHEMA = "pos bigint, key array<float>, value array<float>, cache_id string, layer int, kv_head int"
QUERY_SCHEMA = "q_row bigint, session_id string, step bigint, q_head int, q array<float>, layer int"
HEAD_SCHEMA = "kv_head int, weight array<array<double>>, bias array<double>, mean array<double>, n_keys bigint, n_retrieved int, alpha double, gate_pass boolean, validated boolean, reason string, layer int"


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder that the cluster names for checkpoints."""
    return f"{shared_folder(spark)}/vecloom-{uuid.uuid4().hex}"


def save_cache(kv: DataFrame, path: str) -> None:
    """Keys and values by layer and head, one folder each, so that one head is read without the others."""
    kv.select("cache_id", "layer", "kv_head", "pos", "key", "value").write.mode("errorifexists").partitionBy("cache_id", "layer", "kv_head").option("compression", "zstd").parquet(path)


def load_cache(spark: SparkSession, path: str, layers: int | None = None) -> DataFrame:
    """A stored cache; fails if it doesn't hold the number of layers that the model has."""
    kv = spark.read.schema(KV_SCHEMA).parquet(path)
    if layers is not None:
        found = kv.select("layer").distinct().count()
        if found != layers:
            raise ValueError(f"{path} holds {found} layers, not {layers}")
    return kv


def read_head(spark: SparkSession, path: str, cache_id: str, layer: int, kv_head: int, columns: list[str]) -> DataFrame:
    """Some columns of one head; the filters prune the folders, the selection the columns."""
    return load_cache(spark, path).where((F.col("cache_id") == cache_id) & (F.col("layer") == layer) & (F.col("kv_head") == kv_head)).select(*columns)


def append_recording(rows: DataFrame, path: str, by: str = "layer") -> None:
    """Add rows to a recording; ragged rows need no padding in long form."""
    rows.write.mode("append").partitionBy(by).option("compression", "zstd").parquet(path)


def read_at(spark: SparkSession, path: str, positions: DataFrame, schema: str = QUERY_SCHEMA, key: str = "step") -> DataFrame:
    """The recorded rows at the given positions. Positions that the recording doesn't reach are an error."""
    rows = spark.read.schema(schema).parquet(path)
    top = rows.agg(F.max(key)).first()[0]
    least, most = positions.agg(F.min(key), F.max(key)).first()
    if most is not None and (top is None or least < 0 or most > top):
        raise ValueError(f"positions {least} to {most} lie outside the recording, which ends at {top}")
    return rows.join(positions.select(key).distinct(), key, "left_semi")


def save_heads(heads: DataFrame, path: str) -> None:
    """Replace the layers that heads holds and leave the others as they are."""
    heads.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer").parquet(path)


def load_heads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(HEAD_SCHEMA).parquet(path)


def export_active(heads: DataFrame, path: str) -> None:
    """The heads whose gate is open, as JSON lines, one folder for each layer."""
    heads.where(F.coalesce("gate_pass", F.lit(False))).write.mode("overwrite").partitionBy("layer").json(path)


def save_envelopes(docs: DataFrame, path: str) -> None:
    """Documents (size, json) as text, one folder per size."""
    docs.select("size", "json").write.mode("overwrite").partitionBy("size").text(path)


def load_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """json of stored documents; a folder that isn't there has none."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "json string")
    return spark.read.text(path, recursiveFileLookup=True).select(F.col("value").alias("json"))


def read_context(spark: SparkSession, path: str) -> DataFrame:
    """path, text: whole files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """prompt, kind: the lines of files that aren't blank; a line that begins with / is a control."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"\S"))
    return lines.select(F.col("value").alias("prompt"), F.when(F.col("value").startswith("/"), "control").otherwise("prompt").alias("kind"))


def upload_chunks(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """rows with chunk, the number of the upload they go with, `size` rows each in the given order, from 0.

    Rows are numbered without one task seeing all of them; equal ones in any order. size must be at least 1.
    """
    from vecloom.operators.corpus import ranked

    if size < 1:
        raise ValueError("a chunk holds at least one row")
    numbered = ranked(rows, [], [F.col(c) for c in order], "_place")
    return numbered.withColumn("chunk", F.floor((F.col("_place") - 1) / size).cast("bigint")).drop("_place")
