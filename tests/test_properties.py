"""Properties that hold for any data: merges, top k, tails, recall, scores."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import parse, special, vec
from vecloom.functions import text as tx
from vecloom.operators import corpus, logs, search, status, tail

CELL = ["c"]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    keys = [(f"c{i % 2}", i, rng.normal(size=6).round(2).tolist(), rng.normal(size=3).round(2).tolist()) for i in range(300)]
    qs = [(10_000 + i, f"c{i % 3}", rng.normal(size=6).round(2).tolist()) for i in range(9)]
    kv = spark.createDataFrame(keys, "c string, pos bigint, key array<double>, value array<double>").cache()
    q = spark.createDataFrame(qs, "q_row bigint, c string, q array<double>").cache()
    return kv, q, keys, qs


def brute(keys, qs, k):
    out = {}
    for row, c, q in qs:
        s = sorted(((-float(np.dot(q, x)), p) for cc, p, x, _ in keys if cc == c))[:k]
        if s:
            out[row] = [p for _, p in s]
    return out


@pytest.mark.parametrize("sizes", [{}, {"shard_rows": 37, "block_rows": 2}])
def test_top_k_is_the_same_for_any_blocks(tables, sizes):
    kv, q, keys, qs = tables
    rows = search.exact_top_k(q, kv, CELL, 7, **sizes).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.q_row, r.rank)):
        got.setdefault(r.q_row, []).append(r.pos)
    assert got == brute(keys, qs, 7)  # c2 has no keys: no row


def test_top_k_takes_the_smaller_position_on_ties(spark):
    kv = spark.createDataFrame([("a", p, [1.0, 0.0], [1.0]) for p in range(50, 0, -1)], "c string, pos bigint, key array<double>, value array<double>")
    q = spark.createDataFrame([(1, "a", [2.0, 0.0])], "q_row bigint, c string, q array<double>")
    rows = search.exact_top_k(q, kv, CELL, 4, shard_rows=7).orderBy("rank").collect()
    assert [r.pos for r in rows] == [1, 2, 3, 4]


@pytest.mark.parametrize("shard_rows", [1000, 11])
def test_softmax_states_merge_to_the_unsplit_result(tables, shard_rows):
    kv, q, keys, qs = tables
    got = {r.q_row: r for r in search.full_attention(q, kv, CELL, 0.5, 3, shard_rows=shard_rows).collect()}
    for row, c, x in qs:
        mine = [(np.dot(x, k) * 0.5, v) for cc, _, k, v in keys if cc == c]
        if not mine:
            assert row not in got
            continue
        w = np.exp([s for s, _ in mine])
        assert got[row].lse == pytest.approx(math.log(w.sum()))
        assert got[row].out == pytest.approx((w[:, None] * np.array([v for _, v in mine])).sum(0) / w.sum())


def test_merging_two_partitions_equals_one_softmax(tables):
    kv, q, _, _ = tables
    scored = search.scores(q, kv, CELL).join(kv.select("pos", "value"), "pos").withColumn("logit", F.col("score"))
    one = {r.q_row: r for r in search.attend(scored, ["q_row"], 3).collect()}
    a, b = (search.attend(scored.where(cond), ["q_row"], 3) for cond in ("pos % 5 = 0", "pos % 5 <> 0"))
    for r in search.merge_partitions(a, b, ["q_row"]).collect():
        assert r.lse == pytest.approx(one[r.q_row].lse) and r.out == pytest.approx(one[r.q_row].out)
    whole = search.attend(scored, ["q_row"], 3)
    alone = {r.q_row: r for r in search.merge_partitions(whole, whole.where("false"), ["q_row"]).collect()}
    assert {k: v.lse for k, v in alone.items()} == {k: v.lse for k, v in one.items()}


def test_inverted_lists_are_exact_when_all_are_searched(tables):
    kv, q, _, _ = tables
    cents = search.sample_centroids(kv, CELL, 5)
    assigned = search.nearest_centroid(kv, cents, CELL)
    exact = search.exact_top_k(q, kv, CELL, 6)
    few, all_ = (search.recall(search.ivf_top_k(q, assigned, cents, CELL, 6, n), exact, ["q_row"]).agg(F.avg("recall")).first()[0] for n in (1, 5))
    assert all_ == 1.0 and 0 < few <= 1.0
    assert search.recall(exact, exact, ["q_row"]).agg(F.min("recall")).first()[0] == 1.0


def test_log_expressions(spark):
    inf = float("inf")
    df = spark.createDataFrame([(-inf, -inf), (0.0, -inf), (1.0, 2.0), (1000.0, 1000.0)], "a double, b double")
    got = [r[0] for r in df.select(vec.logaddexp(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([-inf, 0.0, math.log(math.e + math.e**2), 1000 + math.log(2)])
    x = np.array([-100.0, -40.0, -10.0, -5.7, -1.0, 0.0, 3.0])
    y = special.log_ndtr(x)
    assert np.isfinite(y).all() and special.log_ndtr(np.array([-np.inf]))[0] == -inf
    assert y[3:] == pytest.approx([math.log(0.5 * math.erfc(-v / math.sqrt(2))) for v in x[3:]], rel=1e-13)
    assert y[2] == pytest.approx(math.log(0.5 * math.erfc(10 / math.sqrt(2))), rel=1e-12)


def test_rotation_keeps_the_norm_and_can_be_undone(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0], 7)], "q array<double>, d bigint")
    freq = vec.rope_inv_freq(4)
    there = df.select("d", vec.rope_shift(F.col("q"), F.col("d"), freq).alias("q"))
    back = there.select(vec.rope_shift(F.col("q"), -F.col("d"), freq).alias("q")).first().q
    assert back == pytest.approx([1, 2, 3, 4, 5]) and there.first().q[4] == 5.0


def test_tail_without_mass_leaves_the_row_as_it_is(spark):
    df = spark.createDataFrame([([1.0, 2.0], 4.0, [9.0, 9.0], 0.0)], "n array<double>, d double, u array<double>, z double")
    out = df.select(tail.combine(F.col("n"), F.col("d"), F.col("u"), F.col("z")).alias("o")).first().o
    assert out == [0.25, 0.5]
    edge = spark.createDataFrame([(0.5, 0.0, 0, 1.0), (0.5, 0.0, 8, 1.0), (0.5, 4.0, 8, -1e9)], "mu double, var double, n bigint, b double")
    got = [r[0] for r in edge.select(tail.tail_mass(F.col("mu"), F.col("var"), F.col("n"), F.col("b"))).collect()]
    assert got[0] == -math.inf and got[1] == pytest.approx(math.log(8) + 0.5) and got[2] < -1e9


def test_moments_equal_numpy(tables):
    kv, _, keys, _ = tables
    for r in tail.moments(kv, CELL, 6).collect():
        x = np.array([k for c, _, k, _ in keys if c == r.c])
        assert r.n_keys == len(x) and r.mean == pytest.approx(x.mean(0)) and np.allclose(r["cov"], np.cov(x.T, bias=True))


def test_ridge_map_finds_a_linear_map(spark):
    rng = np.random.default_rng(1)
    w = rng.normal(size=(2, 3))
    rows = []
    for _ in range(400):
        q = rng.normal(size=3)
        u = w @ (q / np.linalg.norm(q))
        rows.append(("a", q.tolist(), (5 * u / np.linalg.norm(u)).tolist()))
    m = tail.ridge_map(spark.createDataFrame(rows, "c string, q array<double>, u array<double>"), CELL, 3, 2, 1e-9).first()
    q = np.array([0.3, -0.2, 0.9])
    pred = np.array(m.weight) @ (q / np.linalg.norm(q)) + np.array(m.bias)
    want = w @ q
    assert np.dot(pred, want) / np.linalg.norm(pred) / np.linalg.norm(want) > 0.95 and m.scale == pytest.approx(5.0)


def test_running_and_sliding_sums_equal_plain_windows(spark):
    random.seed(2)
    rows = [(g, s, random.randint(-5, 5)) for g in ("a", "b") for s in random.sample(range(60), 40)]
    df = spark.createDataFrame(rows, "g string, s bigint, x bigint")
    run = {(r.g, r.s): r.x for r in logs.running_sum(df, ["g"], "s", ["x"], block=7).collect()}
    win = {(r.g, r.s): r.x for r in logs.sliding_sum(df, ["g"], "s", ["x"], 5, block=8).collect()}
    for g, s, _ in rows:
        assert run[g, s] == sum(x for h, t, x in rows if h == g and t <= s)
        assert win[g, s] == sum(x for h, t, x in rows if h == g and s - 5 < t <= s)


def test_policies_equal_a_walk_through_the_steps(spark):
    random.seed(5)
    rows = []
    for t in range(12):
        for h in range(4):
            for rank, pos in enumerate(random.sample(range(15), 5)):
                rows.append((3, h, t, rank + 1, pos, 2.0 - rank * random.random()))
    df = spark.createDataFrame(rows, "layer int, q_head int, step bigint, rank int, pos bigint, score double")
    w = {}
    for la, h, t, _, p, s in rows:
        w[h, t, p] = math.exp(s) / sum(math.exp(x[5]) for x in rows if x[1] == h and x[2] == t)
    for tau in (0.0, 0.2, 0.3):
        lost = fetched = 0.0
        for shard in (0, 1):
            cache = set()
            for t in range(12):
                for h in (2 * shard, 2 * shard + 1):
                    cache |= {p for (a, b, p), x in w.items() if a == h and b == t and x >= tau}
                lost += sum(x for (a, b, p), x in w.items() if a // 2 == shard and b == t and p not in cache)
            fetched += len(cache)
        all_ = len({(a // 2, p) for a, _, p in w})
        r = logs.threshold_policy(df, 2, [tau]).first()
        assert r.download == pytest.approx(fetched / all_) and r.retained == pytest.approx(1 - lost / 48)
    for r in logs.layer_reuse(df).collect():
        assert 0 <= r.hit_ceiling <= 1 and 0 <= r.retention <= 1


def test_answer_scores(spark):
    rows = [("The cat, sat!", "the cat sat"), ("", ""), ("x", ""), ("", "x"), ("a a b", "a b b"), ("ＡＢＣ naïve", "abc NAÏVE"), ("q r s", "x y"), (None, "a"), ("a", None)]
    df = spark.createDataFrame(rows, "g string, r string").select("*", tx.normalized(F.col("g")).alias("ng"), tx.normalized(F.col("r")).alias("nr"))
    g, r = tx.tokens(F.col("ng")), tx.tokens(F.col("nr"))
    got = df.select(tx.token_f1(g, r), tx.token_f1(r, g), tx.rouge_l(g, r), tx.containment(F.col("ng"), F.col("nr"))).collect()
    assert [round(x[0], 4) for x in got] == [1.0, 1.0, 0.0, 0.0, 0.6667, 1.0, 0.0, 0.0, 0.0]
    assert all(x[0] == x[1] for x in got)
    assert [round(x[2], 4) for x in got] == [1.0, 1.0, 0.0, 0.0, 0.6667, 1.0, 0.0, 0.0, 0.0]
    assert [x[3] for x in got] == [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]
    assert special.lcs("a b c b d a b".split(), "b d c a b a".split()) == 4


def test_places_and_prefixes(spark):
    random.seed(7)
    rows = [(random.choice("aab"), f"src/{random.choice('xyz')}/{random.choice(['mod.rs', 'f.rs', 'lib.rs'])}", i, random.randint(1, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, rel string, id bigint, n int")
    got = {r.id: r.place for r in corpus.ranked(df, ["g"], [F.col("n"), F.col("id")], "place").collect()}
    for g in "ab":
        mine = sorted((n, i) for h, _, i, n in rows if h == g)
        assert [got[i] for _, i in mine] == list(range(1, len(mine) + 1))
    tiers = {r.tier: (r.files, r.total) for r in corpus.prefix_tiers(df, [F.col("id")], "n", {"t": 100, "all": 10**9}, {"c": 100}).collect()}
    total, run = 0, []
    for *_, n in rows:
        total += n
        run.append(total)
    k = next(i for i, t in enumerate(run) if t >= 100) + 1
    c = sum(t <= 100 for t in run)
    assert tiers == {"t": (k, run[k - 1]), "all": (200, run[-1]), "c": (c, run[c - 1])}
    assert corpus.ranked(df.where("false"), ["g"], [F.col("id")], "place").count() == 0


def test_signatures():
    src = """//! doc { not code
use a::b;
/// adds
pub fn add(a: u8, b: u8) -> u8 { let s = "}"; if a > b { a } else { b } }
pub struct P { x: u8, /* } */ y: char }
const C: Foo = Foo { a: '}' };
impl P {
    // c
    pub fn get(&self) -> u8 { self.x }
    fn set(&mut self) { { self.x = 1; } }
}


#[cfg(test)]
mod tests { fn t() { assert!(true) } }
trait T { fn f(&self); fn g(&self) -> u8 { 1 } }
"""
    out = corpus.signatures(src)
    assert "fn add(a: u8, b: u8) -> u8 { ... }" in out and "let s" not in out
    assert "pub struct P { x: u8, /* } */ y: char }" in out
    assert "const C: Foo = { ... }" in out or "const C: Foo = Foo { ... };" in out
    assert "pub fn get(&self) -> u8 { ... }" in out and "fn set(&mut self) { ... }" in out and "self.x" not in out
    assert "assert!" not in out and "fn g(&self) -> u8 { ... }" in out and "fn f(&self);" in out
    assert corpus.signatures("/* a /* b */ fn ghost() { 1 } c */\nfn x() { 2 }") == "/* a /* b */ fn ghost() { 1 } c */\nfn x() { ... }\n"
    assert corpus.signatures('const A: [u8; 2] = [1, 2];\nstatic B: T = { 7 };\nfn c() { let s = r#"} { "# ; }\nmacro_rules! m { () => { 1 } }') == 'const A: [u8; 2] = [1, 2];\nstatic B: T = { ... };\nfn c() { ... }\nmacro_rules! m { () => { 1 } }\n'
    assert corpus.signatures("#[cfg(not(test))]\nmod a { fn b() { 1 } }\n#[cfg(test)]\nmod t { fn c() { } }\nstruct S { x: u8 }") == "#[cfg(not(test))]\nmod a { fn b() { ... } }\nstruct S { x: u8 }\n"
    assert corpus.signatures("") == "\n" and corpus.signatures("fn broken( {") and "\n\n\n" not in out


def test_names(spark):
    df = spark.createDataFrame([("100k",), ("1M",), ("77",), (" 2K ",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(parse.size_to_tokens(F.col("s"))).collect()] == [100_000, 1_000_000, 77, 2000, None, None]
    cells = spark.createDataFrame([("L15H3",), ("l1h0",), ("L1",), ("",), (None,)], "s string").select(parse.parse_cell(F.col("s")).alias("c")).collect()
    assert [r.c and tuple(r.c) for r in cells] == [(15, 3), (1, 0), None, None, None]


def test_batches_keep_layers_together(spark):
    cells = [(la, h) for la, n in ((1, 2), (3, 2), (5, 5), (7, 1), (9, 3)) for h in range(n)]
    got = status.plan_batches(spark.createDataFrame(cells, "layer int, kv_head int"), 4).orderBy("layer", "kv_head").collect()
    out = {}
    for r in got:
        out.setdefault(r.batch, []).append((r.layer, r.kv_head))
    assert out == {0: [(1, 0), (1, 1), (3, 0), (3, 1)], 1: [(5, 0), (5, 1), (5, 2), (5, 3)], 2: [(5, 4)], 3: [(7, 0), (9, 0), (9, 1), (9, 2)]}
