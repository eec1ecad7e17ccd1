"""Nulls in any column, empty tables, ties, repeated rows and extra columns, for each core operator."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import corpus, logs, search, status, tail
from vecloom.sources import stores, views

KV = "cache_id string, layer int, kv_head int, pos bigint, key_vec array<float>, stored_at timestamp, n int, shard string"
RETR = "layer int, q_head int, step bigint, rank int, pos bigint, score double, shard string, w double, e int"


def test_unusable_vectors(spark, tmp_path):
    ok = [1.0] * 32
    rows = [("a", 1, 0, 1, ok), ("a", 1, 0, 1, ok), ("a", 1, 0, 2, None), ("a", 1, 0, 3, []), ("a", 1, 0, 4, [0.0] * 32), ("a", 1, 0, 5, [float("nan")] * 32), ("a", 1, 0, 6, ok[:-1]), ("a", 1, 0, 7, [*ok[:-1], None]), ("a", 1, 0, None, ok), (None, 1, 0, 8, ok)]
    spark.createDataFrame([(*r, None, 1, "x") for r in rows], KV).write.parquet(f"{tmp_path}/kv.parquet")
    assert sorted((r.cache_id or "", r.pos) for r in views.keys(spark, str(tmp_path)).collect()) == [("", 8), ("a", 1)]


def test_search_of_nothing(spark):
    kv = spark.createDataFrame([], "c string, pos bigint, key array<double>, value array<double>")
    q = spark.createDataFrame([(1, "a", [1.0]), (2, None, [1.0])], "q_row bigint, c string, q array<double>")
    assert search.exact_top_k(q, kv, ["c"], 3).count() == 0 == search.full_attention(q, kv, ["c"], 1.0, 1).count()
    assert search.exact_top_k(q.where("false"), kv, ["c"], 3).count() == 0
    assert tail.moments(kv, ["c"], 1).count() == 0


def test_logs_of_nothing_and_of_extra_columns(spark):
    empty = spark.createDataFrame([], RETR)
    for f in (logs.layer_reuse, logs.redundancy, logs.layer_coverage, lambda r: logs.heatmap(r, 100, 10), lambda r: logs.download_curve(r, 2), lambda r: logs.weight_mass_new(r, 2), lambda r: logs.threshold_policy(r, 2, [0.0]), lambda r: logs.coretrieval_edges(r, 2, 4, 2)):
        assert f(empty).count() == 0
    one = spark.createDataFrame([(3, 0, 0, 1, 5, 1.0, "x", 9.0, 1), (3, 0, 0, 2, 6, 1.0, "x", 9.0, 1)], RETR)
    assert [tuple(r) for r in logs.download_curve(one, 2).collect()] == [(0, 2)]
    assert logs.layer_reuse(one).first().retention is None
    assert [round(r.w, 6) for r in logs.weighted(one).collect()] == [0.5, 0.5]


def test_status_of_untidy_sessions(spark):
    rows = [("a", {"context_len": "5", "model": "m", "scaling": "8.0", "layers": "3, 7"}), ("b", None), ("c", {"context_len": "x", "model": "n", "scaling": "", "layers": "3,q"})]
    got = {r.session_id: r.problems for r in status.session_problems(spark.createDataFrame(rows, "session_id string, meta map<string,string>"), "m", 8.0, [3, 7]).collect()}
    assert got["a"] == [] and len(got["b"]) == 4 and got["c"] == ["context_len x", "model n", "scaling ", "layers 7 not recorded"]
    assert status.plan_batches(spark.createDataFrame([(None, 1), (1, None)], "layer int, kv_head int"), 2).count() == 0


def test_corpus_of_nulls(spark):
    docs = spark.createDataFrame([(1, "s", None, None, None), (2, None, "", 0, None), (3, "s", "### a\nb\n## c\nd 1234567", 24, "x/lib.rs"), (3, "s", "### a\nb\n## c\nd 1234567", 24, "x/lib.rs")], "doc_id bigint, source string, text string, n_chars int, rel string")
    assert corpus.round_robin(docs, "source", "rel", "doc_id").count() == 4
    assert sorted(r.body for r in corpus.sections(docs.where("doc_id = 3").limit(1), "doc_id", "text").collect()) == ["## c", "d 1234567"]
    n = corpus.needle_offsets(docs.select(F.lit("1234567").alias("code")), "code", docs, "source", "text", "doc_id").first()
    assert n.n == 2 and n.offset is None
    assert corpus.haystacks(docs, "source", "doc_id", "text", "n_chars", 10, "nothing").count() >= 1
    assert docs.where("false").select(corpus.signatures_udf("text")).count() == 0


def test_stores(spark, tmp_path):
    heads = lambda layer, a: spark.createDataFrame([(0, [[1.0]], [0.0], [0.0], 5, 16, a, True, True, "", layer), (1, None, None, None, 0, 16, a, None, False, None, layer)], stores.HEAD_SCHEMA)
    at = f"{tmp_path}/heads"
    stores.save_heads(heads(3, 0.5).unionByName(heads(7, 0.5)), at)
    stores.save_heads(heads(7, 1.0), at)
    assert sorted((r.layer, r.alpha) for r in stores.load_heads(spark, at).collect()) == [(3, 0.5), (3, 0.5), (7, 1.0), (7, 1.0)]
    stores.export_active(stores.load_heads(spark, at), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 2
    q = spark.createDataFrame([(1, "s", 4, 0, [1.0], 3)], stores.QUERY_SCHEMA)
    stores.append_recording(q, f"{tmp_path}/rec")
    stores.append_recording(q, f"{tmp_path}/rec")
    assert stores.read_at(spark, f"{tmp_path}/rec", spark.createDataFrame([(4,)], "step bigint")).count() == 2
    try:
        stores.read_at(spark, f"{tmp_path}/rec", spark.createDataFrame([(5,)], "step bigint"))
        raise AssertionError("a position outside the recording must be refused")
    except ValueError:
        pass
    (tmp_path / "p.txt").write_text("hello\n\n/full\nworld\n")
    assert [(r.prompt, r.kind) for r in stores.read_prompts(spark, f"{tmp_path}/p.txt").collect()] == [("hello", "prompt"), ("/full", "control"), ("world", "prompt")]
    assert stores.read_context(spark, f"{tmp_path}/p.txt").first().text.startswith("hello")


def scan_rows(spark, seed=3, cells=2, n=60, queries=9, dim=4):
    rng = np.random.default_rng(seed)
    kv = [(f"c{c}", p, (rng.integers(-2, 3, dim) / 2).tolist(), rng.normal(size=dim).tolist()) for c in range(cells) for p in range(n if c else 7)]
    qs = [(i, f"c{i % (cells + 1)}", rng.integers(-2, 3, dim).astype(float).tolist()) for i in range(queries)]
    return spark.createDataFrame(kv, "c string, pos bigint, key array<double>, value array<double>"), spark.createDataFrame(qs, "q_row bigint, c string, q array<double>"), kv, qs


@pytest.mark.parametrize("by_hash", [False, True])
@pytest.mark.parametrize("shard_rows", [1000, 16])
def test_cut_scan_equals_numpy(spark, by_hash, shard_rows):
    """With ties, a cell smaller than the cuts, a query without keys; cells of one shard and of several."""
    kv, q, keys, qs = scan_rows(spark)
    got = {(r.q_row, r.cut): r for r in tail.cut_scan(q, kv, ["c"], [1, 2, 5, 32], 0.7, 4, 5, by_hash, shard_rows).collect()}
    want = set()
    for i, c, v in qs:
        of = [k for k in keys if k[0] == c]
        if not of:
            continue
        s = np.array([np.dot(v, k[2]) for k in of]) * 0.7
        w, x = np.exp(s - s.max()), np.array([k[3] for k in of])
        order = sorted(range(len(of)), key=(lambda j: (hashlib.md5(str(of[j][1]).encode()).hexdigest(), of[j][1])) if by_hash else (lambda j: (-s[j], of[j][1])))
        for cut in (1, 2, 5, 32):
            if cut <= max(len(of), 5):
                r, some = got[i, cut], order[:cut]
                want.add((i, cut))
                assert np.allclose([r.m, r.bnd, r.dt, r.d, *r.nt, *r.exact], [s.max(), s[some].min(), w[some].sum(), w.sum(), *(w[some] @ x[some]), *(w @ x / w.sum())])
    assert set(got) == want
    assert tail.cut_scan(q, kv.where("false"), ["c"], [1], 1.0, 4).count() == 0 == tail.cut_scan(q.where("false"), kv, ["c"], [1], 1.0, 4).count()


def test_heads_without_a_map_pass_through(spark):
    rows = [(1, 2.0, 4.0, [1.0, 2.0], [3.0, 0.0], 6.0, 0.5, True), (2, 2.0, 4.0, [1.0, 2.0], [3.0, 0.0], 6.0, 0.5, False), (3, 2.0, 4.0, [1.0, 2.0], None, None, None, True), (4, 2.0, 4.0, [1.0, 2.0], [3.0, 0.0], 6.0, 0.0, True)]
    df = spark.createDataFrame(rows, "q_row bigint, m double, dt double, nt array<double>, uh array<double>, z double, alpha double, active boolean")
    live = spark.createDataFrame([(9, 0.0, [1.0, 1.0])], "q_row bigint, lse double, out array<double>")
    got = {r.q_row: (r.lse, r.out) for r in tail.apply(df, live).collect()}
    plain = (pytest.approx(2 + math.log(4)), [0.25, 0.5])
    assert got[1] == (pytest.approx(2 + math.log(7)), pytest.approx([10 / 7, 2 / 7])) and got[2] == plain == got[3] == got[4] and got[9] == (0.0, [1.0, 1.0])


def test_cut_statistics_equal_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [("h", 4, i % 3 > 0, rng.normal(size=3).tolist() if i != 5 else None, rng.normal(size=3).tolist(), rng.normal(size=3).tolist(), float(rng.uniform(1, 2)), float(rng.uniform(4, 5)), 2.0, float(rng.uniform(0.1, 1)), float(rng.uniform(0.1, 1))) for i in range(60)]
    df = spark.createDataFrame(rows, "h string, cut int, train boolean, u array<double>, uh array<double>, pred array<double>, z double, d double, dt double, none_err double, err double")
    r = tail.cut_statistics(df, ["h"]).first()
    rows = [x for x in rows if x[3]]
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    mean = np.mean([unit(x[3]) for x in rows if x[2]], 0)
    te = [x for x in rows if not x[2]]
    r2 = 1 - sum(((unit(x[3]) - x[5]) ** 2).sum() for x in te) / sum(((unit(x[3]) - mean) ** 2).sum() for x in te)
    const, phi = mean @ mean, np.mean([(x[7] - x[8]) / x[7] for x in te])
    err, none = np.array([x[10] for x in te]), np.array([x[9] for x in te])
    want = dict(
        err_mean=err.mean(), err_p90=np.quantile(err, 0.9), none_mean=none.mean(), worse=(err > none).mean(), phi=phi, const=const, r2=r2, leftover=(1 - const) * (1 - r2), pred=phi * np.sqrt((1 - const) * (1 - r2)),
        mass_ratio=np.median([x[6] / (x[7] - x[8]) for x in te]), cos_median=np.median([unit(x[3]) @ unit(x[4]) for x in te]), ratio=err.mean() / none.mean(),
    )
    for k, v in want.items():
        assert r[k] == pytest.approx(v), k


def test_fitted_mass_factor_is_applied(spark, medium_data):
    """tail_apply merges alpha * z where the gate passed, and leaves other heads as retrieval gave them."""
    from vecloom.plans import tail as plans

    gates, rows, live = plans._validated(spark, medium_data)
    on = {(r.layer, r.kv_head): r.gate_pass for r in gates.collect()}
    part = {r.q_row: (r.m, r.dt, r.z, r.alpha, on.get((r.layer, r.kv_head), False)) for r in rows.collect()}
    lived = {r.q_row: r.lse for r in live.collect()}
    got = {r.q_row: r.lse for r in plans.tail_apply(spark, medium_data).collect()}
    assert got and set(got) >= set(part)
    for k, (m, dt, z, alpha, active) in part.items():
        lse = m + math.log(dt + (alpha * z if active and z is not None else 0))
        assert got[k] == pytest.approx(np.logaddexp(lse, lived[k]) if k in lived else lse)


def test_needles_are_where_the_layout_says(spark):
    df = spark.createDataFrame([(1, 300, 0.0, "77"), (2, 300, 0.99, "1234567"), (3, 40, 1.0, "x"), (4, 300, None, "y"), (5, 900, 0.5, "ü")], "idx int, bucket int, depth double, label string")
    filler = "All is calm. "
    for n in (1, 3):
        rows = corpus.needles_in_filler(df, "idx", "bucket", "depth", "label", n, filler, "Number of %s: %s.", "Which number has %s?")
        for r in rows.withColumn("text", corpus.needle_text(filler)).collect():
            want = r.needles[r.target]
            assert len(r.needles) == n and r.target == min(int((r.depth or 0) * n), n - 1) and want.value == r.label and want.key in r.question
            assert len(r.text) == r.chars and r.text[r.offset :].startswith(f"Number of {want.key}: {r.label}.") and r.text.count("Number of") == n
    assert corpus.needles_in_filler(df.where("false"), "idx", "bucket", "depth", "label", 2, filler, "%s %s", "%s").count() == 0


def test_anchors_of_any_text(spark):
    docs = spark.createDataFrame([("a", "the old mill, the old mill", 1), ("a", "no", 2), ("b", "see the old mill here", 3), ("b", None, 4), (None, "oak the old mill", 5), ("b", "xoldmillx", 6)], "tier string, text string, n int")
    needles = spark.createDataFrame([(1, "the old mill"), (2, "e old m"), (3, "oak"), (4, ""), (5, None), (6, "absent thing"), (1, "the old mill"), (7, "old mill h")], "id int, anchor string")
    got = {(r.id, r.tier): (r.n, r.offset) for r in corpus.anchor_offsets(needles, "id", "anchor", docs, "tier", "text").collect()}
    assert got == {(1, "a"): (2, None), (1, "b"): (1, 4), (1, None): (1, 4), (2, "a"): (2, None), (2, "b"): (1, 6), (2, None): (1, 6), (3, None): (1, 0), (7, "b"): (1, 8)}


def test_files_of_a_corpus(spark):
    rows = [("lib/a/src/x.rs", True), ("lib/a/tests/x.rs", False), ("tests.rs", True), ("lib/a/x.txt", False), ("lib/api/made.rs", False), ("a/stop/x.rs", False), (None, False)]
    df = spark.createDataFrame(rows, "rel string, want boolean")
    for r in df.select("want", corpus.included(F.col("rel"), ".rs", ["tests"], ["made.rs"], ["/stop/"]).alias("got")).collect():
        assert r.got == r.want
    labels = spark.createDataFrame([("lib/a", 0), ("lib/a/b", 0), ("lib/ab", 1), ("lib", 1), ("src", 2), (None, 2)], "s string, want int")
    assert all(r.got == r.want for r in labels.select("want", corpus.group_rank(F.col("s"), ["lib/a", "lib"]).alias("got")).collect())


def test_choices_that_find_nothing_are_refused(spark, tmp_path):
    from vecloom.functions import parse

    rows = spark.createDataFrame([(3, 0, "s1"), (3, 1, "s2"), (3, 1, None)], "layer int, kv_head int, session_id string")
    assert parse.cells(["L3H0", " l15h2 "]) == [(3, 0), (15, 2)]
    assert status.select_cells(rows, [(3, 1)]).count() == 2 and status.select_cells(rows, [(3, 1), (9, 9)], strict=False).count() == 2
    assert status.recorded_sessions(rows, "session_id").count() == 3 and status.recorded_sessions(rows, "session_id", ["s1"]).count() == 1
    for bad in (lambda: parse.cells(["L3"]), lambda: status.select_cells(rows, [(9, 9)]), lambda: status.select_cells(rows, []), lambda: status.recorded_sessions(rows, "session_id", ["s1", "zz"]), lambda: search.retriever("best")):
        with pytest.raises(ValueError):
            bad()
    assert stores.load_envelopes(spark, f"{tmp_path}/none").count() == 0
    docs = status.envelope(rows.select("layer", "kv_head"), "x", {}, F.col("layer").cast("string"))
    stores.save_envelopes(docs, f"{tmp_path}/env")
    assert status.read_envelope(stores.load_envelopes(spark, f"{tmp_path}/env"), "kv_head: int").count() == 3
    chunked = stores.upload_chunks(spark.range(10).withColumn("k", 9 - F.col("id")), ["k"], 4)
    assert sorted((r.k, r.chunk) for r in chunked.collect()) == [(i, i // 4) for i in range(10)]


def test_a_cluster_must_name_its_shared_folder():
    from types import SimpleNamespace

    from vecloom.sources import ensure_checkpoint_dir

    conf = SimpleNamespace(get=lambda *a: None)
    empty = SimpleNamespace(isEmpty=lambda: True)
    sc = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: empty)))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_retrievers_by_name(spark):
    kv, q, _, _ = scan_rows(spark)
    exact = sorted(map(tuple, search.retriever("exact", 5)(q, kv, ["c"]).collect()))
    assert exact == sorted(map(tuple, search.retriever("ivf", 5, 99, 4)(q, kv, ["c"]).collect()))
    full = search.retriever("full")(q, kv, ["c"])
    assert sorted(map(tuple, full.where("rank <= 5").collect())) == exact and full.count() > len(exact)
    none = search.recall(kv.select(F.lit(1).alias("g"), "pos").where("false"), kv.select(F.lit(1).alias("g"), "pos").where("false"), ["g"], spark.createDataFrame([(1,)], "g int"))
    assert [tuple(r) for r in none.collect()] == [(1, 1.0)]
