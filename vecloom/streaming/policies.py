"""The incremental operators as streams: recordings, what is new, admissions, decode steps.

Nothing is ever evicted from a cache, so being seen or admitted is the first qualifying row of a position:
duplicates are dropped by key, which keeps one small state per position and none per row. These states have no watermark:
they grow with the number of distinct positions, as the caches that they stand for do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vecloom.operators import logs, search
from vecloom.sources import stores

HIT_SCHEMA = "layer int, kv_head int, p_row bigint, chunk int, top_ix int, top_sc float, emitted_at timestamp"


def hits(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """The scan's hits as they arrive, without padding. path is a folder, or a pattern that names files or folders."""
    rows = spark.readStream.schema(HIT_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    s = F.col("top_sc")
    return rows.where((F.col("top_ix") >= 0) & s.isNotNull() & ~F.isnan(s) & (F.abs(s) != F.lit(float("inf"))))


def first_seen(rows: DataFrame, group: int) -> DataFrame:
    """layer, shard, pos of each position when its shard meets it first."""
    shard = F.floor(F.col("kv_head") / group).cast("int")
    return rows.select("layer", shard.alias("shard"), F.col("top_ix").cast("bigint").alias("pos")).dropDuplicates(["layer", "shard", "pos"])


def admissions(rows: DataFrame, group: int, least: float) -> DataFrame:
    """layer, shard, pos, since: the earliest step at which a position's score reaches `least`; update mode, late rows included."""
    shard = F.floor(F.col("kv_head") / group).cast("int")
    ok = rows.where(F.col("top_sc") >= least)
    return ok.groupBy("layer", shard.alias("shard"), F.col("top_ix").cast("bigint").alias("pos")).agg(F.min("p_row").alias("since"))


def late_counts(rows: DataFrame, delay: str, width: str) -> DataFrame:
    """layer, window, n of hits by time of emission; rows later than the delay are dropped with their closed windows."""
    return rows.withWatermark("emitted_at", delay).groupBy("layer", F.window("emitted_at", width)).agg(F.count("*").alias("n"))


def record(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a recording, each row exactly once, and stop when all that is there is written."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def run_to_end(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """What a stream in append mode yields from all that has arrived."""
    at = stores.scratch(spark)
    record(rows, f"{at}/out", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/out")


def latest(spark: SparkSession, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The last state of a stream in update mode whose value only falls: its updates written, the least one kept."""
    at = stores.scratch(spark)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")  # a batch that is run again replaces itself

    rows.writeStream.outputMode("update").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return spark.read.schema(schema).parquet(f"{at}/out").groupBy(*keys).agg(F.min(value).alias(value))


LIVE_SCHEMA = "session_id string, step bigint, kind string, q_row bigint, q array<double>, key array<double>, value array<double>"


def live_cache(events: DataFrame, scaling: float) -> DataFrame:
    """session_id, q_row, keys, lse, out: a session's live cache that grows with its events and begins anew at a reset.

    Events have the columns of LIVE_SCHEMA and a kind: "append" adds a key and its value, "query" attends to all keys appended before it
    or at its step, "reset" empties the cache. Within a batch they count by step, at one step resets first, then
    appends, then queries. A query that finds no key has a null output and the log mass of nothing. The state of a session are
    the keys since its last reset; of a session's steps one task keeps order, sessions are spread.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flat, values, dim, width = state.get if state.exists else ([], [], 0, 0)
        k = np.array(flat, np.float64).reshape(-1, dim or 1)
        v = np.array(values, np.float64).reshape(-1, width or 1)
        rows = pd.concat(list(batches), ignore_index=True)
        rows["_turn"] = rows["kind"].map({"reset": 0, "append": 1, "query": 2})
        out = []
        for kind, some in ((n[1], g) for n, g in rows.dropna(subset=["_turn"]).groupby(["step", "_turn"], sort=True)):
            if kind == 0:
                k, v = np.zeros((0, 1)), np.zeros((0, 1))
            elif kind == 1:
                more_k, more_v = np.stack(some["key"].to_list()).astype(np.float64), np.stack(some["value"].to_list()).astype(np.float64)
                k, v = (np.concatenate([k, more_k]), np.concatenate([v, more_v])) if len(k) else (more_k, more_v)
            else:
                for q_row, q in zip(some["q_row"], some["q"]):
                    if not len(k):
                        out.append((key[0], q_row, 0, -np.inf, None))
                        continue
                    s = k @ np.asarray(q, np.float64) * scaling
                    m = s.max()
                    w = np.exp(s - m)
                    out.append((key[0], q_row, len(k), m + np.log(w.sum()), (w @ v / w.sum()).tolist()))
        state.update((k.ravel().tolist(), v.ravel().tolist(), k.shape[1] if len(k) else 0, v.shape[1] if len(v) else 0))
        yield pd.DataFrame(out, columns=["session_id", "q_row", "keys", "lse", "out"])

    made = "session_id string, q_row bigint, keys bigint, lse double, out array<double>"
    kept = "k array<double>, v array<double>, dim int, width int"
    return events.groupBy("session_id").applyInPandasWithState(step, made, kept, "append", GroupStateTimeout.NoTimeout)


def weighted_admissions(rows: DataFrame, path: str, checkpoint: str, group: int, taus: list[float]) -> StreamingQuery:
    """tau, layer, shard, pos, since: positions admitted at their step's softmax weight, from a stream of whole steps.

    A step of a head must arrive in one batch, as its weights need all of its scores; late steps are admitted too. Updates
    are appended by batch, and the least `since` of a position holds.
    """

    def step(batch: DataFrame, number: int) -> None:
        hits = batch.select("layer", F.col("kv_head").alias("q_head"), F.col("p_row").alias("step"), F.col("top_ix").cast("bigint").alias("pos"), F.col("top_sc").cast("double").alias("score"))
        once = hits.groupBy("layer", "q_head", "step", "pos").agg(F.max("score").alias("score"))
        w = logs.sharded(logs.weighted(once), group).withColumn("tau", F.explode(F.array(*[F.lit(t) for t in taus])))
        since = w.where(F.col("w") >= F.col("tau")).groupBy("tau", "layer", "shard", "pos").agg(F.min("step").alias("since"))
        since.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()


def decode_loop(queries: DataFrame, keys: DataFrame, cell: list[str], k: int, scaling: float, dim: int, path: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch of queries attends to its k best keys of the frozen cache; outputs are appended."""

    def step(batch: DataFrame, number: int) -> None:
        top = search.exact_top_k(batch, keys, cell, k).join(batch.select("q_row", *cell), "q_row").join(keys.select(*cell, "pos", "value"), [*cell, "pos"])
        out = search.attend(top.withColumn("logit", F.col("score") * scaling), ["q_row"], dim)
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(step).start()
