"""Streams give what the batch gives."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import functions as F

from vecloom.operators import search
from vecloom.streaming import policies


def test_decode_loop_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    kv = spark.createDataFrame([("a", i, rng.normal(size=4).tolist(), rng.normal(size=2).tolist()) for i in range(60)], "c string, pos bigint, key array<double>, value array<double>")
    q = spark.createDataFrame([(i, "a", rng.normal(size=4).tolist()) for i in range(6)], "q_row bigint, c string, q array<double>")
    for k in range(2):
        q.where(F.col("q_row") % 2 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/q")
    stream = spark.readStream.schema(q.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/q")
    policies.decode_loop(stream, kv, ["c"], 5, 0.5, 2, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {r.q_row: r.lse for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    top = search.exact_top_k(q, kv, ["c"], 5).join(kv.select("pos", "value"), "pos").withColumn("logit", F.col("score") * 0.5)
    assert got == {r.q_row: r.lse for r in search.attend(top, ["q_row"], 2).collect()}


def test_first_seen_over_several_batches(spark, tmp_path):
    rows = [(3, h, t, 0, p, 5.0, None) for h in range(2) for t in range(4) for p in (t, t + 1)] + [(3, 0, 0, 0, -1, 5.0, None), (3, 0, 0, 0, None, 5.0, None), (3, 0, 0, 0, 9, float("nan"), None)]
    df = spark.createDataFrame(rows, policies.HIT_SCHEMA)
    for k in range(2):
        df.where(F.col("p_row") % 2 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/h")
    stream = policies.hits(spark, f"{tmp_path}/h", 1)
    assert sorted(r.pos for r in policies.run_to_end(spark, policies.first_seen(stream, 2)).collect()) == [0, 1, 2, 3, 4]
    since = {r.pos: r.since for r in policies.latest(spark, policies.admissions(policies.hits(spark, f"{tmp_path}/h", 1), 2, 4.0), ["layer", "shard", "pos"], "since").collect()}
    assert since == {0: 0, 1: 0, 2: 1, 3: 2, 4: 3}


def test_a_live_cache_grows_and_is_reset(spark, tmp_path):
    rng = np.random.default_rng(1)
    vec = lambda n: rng.normal(size=n).tolist()
    events = [("a", t, "append", None, None, vec(3), vec(2)) for t in range(6)] + [("a", t, "query", 10 + t, vec(3), None, None) for t in range(6)]
    events += [("a", 4, "reset", None, None, None, None), ("b", 2, "append", None, None, vec(3), vec(2)), ("b", 1, "query", 31, vec(3), None, None), ("b", 9, "query", 39, vec(3), None, None), ("c", 0, "other", None, None, None, None)]
    df = spark.createDataFrame(events, policies.LIVE_SCHEMA)
    for k in range(3):  # three batches in order of steps
        df.where(F.floor(F.col("step") / 2) == k if k < 2 else F.col("step") >= 4).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
        time.sleep(1.1)  # files are read in order of their time
    stream = spark.readStream.schema(policies.LIVE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    got = {r.q_row: r for r in policies.run_to_end(spark, policies.live_cache(stream, 0.5)).collect()}
    assert len(got) == 8
    assert got[31]["keys"] == 0 and got[31].out is None and got[31].lse == float("-inf") and got[39]["keys"] == 1
    for t in range(6):
        live = [e for e in events if e[0] == "a" and e[2] == "append" and (e[1] <= t) and (t < 4 or e[1] >= 4)]
        q = next(e[4] for e in events if e[3] == 10 + t)
        s = np.array([np.dot(q, e[5]) for e in live]) * 0.5
        w = np.exp(s - s.max())
        assert got[10 + t]["keys"] == len(live) and np.isclose(got[10 + t].lse, s.max() + np.log(w.sum())) and np.allclose(got[10 + t].out, w @ np.array([e[6] for e in live]) / w.sum())


def test_weighted_admissions_equal_the_batch(spark, tmp_path):
    from vecloom.operators import logs

    rng = np.random.default_rng(2)
    rows = [(3, h, t, 0, int(p), float(rng.normal() * 2), None) for h in range(2) for t in range(6) for p in rng.choice(8, 4, replace=False)]
    df = spark.createDataFrame(rows, policies.HIT_SCHEMA)
    for k in range(2):
        df.where(F.col("p_row") % 2 == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/h")
    policies.weighted_admissions(policies.hits(spark, f"{tmp_path}/h", 1), f"{tmp_path}/out", f"{tmp_path}/cp", 2, [0.1, 0.5]).awaitTermination()
    got = {(r.tau, r.layer, r.shard, r.pos): r.since for r in spark.read.parquet(f"{tmp_path}/out").groupBy("tau", "layer", "shard", "pos").agg(F.min("since").alias("since")).collect()}
    retr = df.select("layer", F.col("kv_head").alias("q_head"), F.col("p_row").alias("step"), F.lit(1).alias("rank"), F.col("top_ix").cast("bigint").alias("pos"), F.col("top_sc").cast("double").alias("score"))
    w = logs.sharded(logs.weighted(retr), 2)
    want = {}
    for tau in (0.1, 0.5):
        for r in w.where(F.col("w") >= tau).groupBy("layer", "shard", "pos").agg(F.min("step").alias("since")).collect():
            want[tau, r.layer, r.shard, r.pos] = r.since
    assert got == want and want
