from __future__ import annotations

import numpy as np
import pytest

from vecloom.llm import nearest

DIM = 6


def brute(qs, keys, k):
    out = {}
    for row, c, q in qs:
        seen = {}
        for cc, p, v in keys:
            if cc == c and p is not None and v is not None and len(v) == DIM and all(x is not None and np.isfinite(x) for x in v) and any(v):
                seen[p] = float(np.dot(np.float64(q), np.float64(v)))
        if seen and q is not None:
            out[row] = [p for p, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return out


@pytest.mark.parametrize("n", [1, 7, 3000])
def test_exact_at_factor_one(n):
    rng = np.random.default_rng(n)
    mid = rng.normal(size=(8, DIM)) * 3
    x = (mid[rng.integers(0, 8, n)] + rng.normal(size=(n, DIM)) * 0.3).round(2).astype(np.float32)
    q = rng.normal(size=(50, DIM)).round(2).astype(np.float32)
    p, s = nearest.search(q, np.arange(n) * 3, x, 10, factor=1.0, leaf=16, band=500)
    exact = q.astype(float) @ x.astype(float).T
    for i in range(50):
        want = sorted(range(n), key=lambda j: (-exact[i, j], j))[:10]
        assert p[i][p[i] >= 0].tolist() == [3 * j for j in want]
    loose, _ = nearest.search(q, np.arange(n) * 3, x, 10, leaf=16, band=500)
    assert np.mean([len(set(a) & set(b)) / len(set(b)) for a, b in zip(loose, p)]) > 0.97


def test_many_equal_vectors():
    x = np.tile(np.float32([[1, 2, 0, 0, 0, 0]]), (400, 1))
    x[200:] = [3, 0, 0, 0, 0, 0]
    pos = np.r_[np.arange(400)[::-1], [5, 5]]
    p, _ = nearest.search(np.float32([[1, 0, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0]]), pos, np.r_[x, x[pos[400:] * 0 + 399 - 5]], 10)
    assert p[0].tolist() == list(range(10)) and p[1].tolist() == list(range(200, 210))


@pytest.mark.parametrize("kind", ["signs", "integers", "units"])
def test_ties_are_exact_at_factor_one(kind):
    """Many different vectors of equal product: the tie goes by position, row by row."""
    rng = np.random.default_rng(5)
    n, dim = 4000, 16
    x = {"signs": rng.choice([-1.0, 1.0], (n, dim)), "integers": rng.integers(-3, 4, (n, dim)), "units": np.eye(dim)[rng.integers(0, dim, n)]}[kind].astype(np.float32)
    q = np.concatenate([np.eye(dim)[rng.integers(0, dim, 40)], rng.choice([-1.0, 1.0], (40, dim))]).astype(np.float32)
    pos = rng.permutation(n)
    x[~x.any(1)] = 1
    p, s = nearest.search(q, pos, x, 10, factor=1.0)
    exact = q.astype(float) @ x.astype(float).T
    for i in range(len(q)):
        want = np.lexsort((pos, -exact[i]))[:10]
        assert p[i].tolist() == pos[want].tolist() and s[i].tolist() == exact[i][want].tolist()


def test_a_floor_leaves_out_what_is_below():
    rng = np.random.default_rng(6)
    x, q = rng.normal(size=(3000, DIM)).astype(np.float32), rng.normal(size=(20, DIM)).astype(np.float32)
    p, s = nearest.search(q, np.arange(3000), x, 10, factor=1.0)
    some, t = nearest.search(q, np.arange(3000), x, 10, factor=1.0, floor=s[:, 4])
    assert (some[:, :5] == p[:, :5]).all() and (some[:, 5:] == -1).all()
    assert (nearest.search(q, np.arange(3000), x, 10, factor=1.0, floor=s[:, 0] + 1)[0] == -1).all()


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(1)
    y, z = rng.normal(size=(700, 4)).astype(np.float32), rng.normal(size=(30, 4)).astype(np.float32)
    t = nearest.Tree(y, 20)
    low = t.bounds(z)
    assert sorted(np.concatenate([r for r, _ in t.leaves])) == list(range(700))
    for k, (rows, _) in enumerate(t.leaves):
        d = np.sqrt(((z[:, None] - y[rows][None]) ** 2).sum(2)).min(1)
        assert (low[k] <= d + 1e-4).all()


def test_rows(spark):
    rng = np.random.default_rng(4)
    ok = lambda: rng.normal(size=DIM).round(1).tolist()
    keys = [("a" if i % 3 else "b", i, ok()) for i in range(200)]
    keys += keys[:40] + [("a", 900, None), ("a", 901, []), ("a", 902, [0.0] * DIM), ("a", 903, [float("nan")] + [1.0] * 5), ("a", 904, [1.0] * 5), ("a", None, ok()), ("few", 1, ok()), ("few", 2, ok()), (None, 3, ok()), ("a", 905, [None] + [1.0] * 5)]
    qs = [(i, "a" if i % 2 else "b", ok()) for i in range(30)] + [(40, "few", ok()), (41, "none", ok())]
    bad = [(50, "a", None), (51, "a", []), (52, "a", [0.0] * DIM), (53, "a", [float("nan")] * DIM), (None, "a", ok()), (54, None, ok())]
    kdf = spark.createDataFrame([(*k, "x", 1) for k in keys], "cell string, pos bigint, key_vec array<float>, shard string, block int")
    qdf = spark.createDataFrame([(*q, "x", 1) for q in [*qs, qs[0], *bad]], "q_row bigint, cell string, q array<float>, i string, n int")
    for sizes in ({}, {"shard_rows": 31, "block_rows": 7}):
        got = {}
        for r in nearest.top_k(qdf, kdf, ["cell"], "q_row", "q", "pos", "key_vec", DIM, 10, 1.0, **sizes).collect():
            got.setdefault(r.q_row, []).append((-r.score, r.pos))
        f32 = [(c, p, v and [x if x is None else float(np.float32(x)) for x in v]) for c, p, v in keys]
        assert {q: [p for _, p in sorted(v)] for q, v in got.items()} == brute([(r, c, [float(np.float32(x)) for x in q]) for r, c, q in qs], f32, 10)
    assert nearest.top_k(qdf, kdf.where("false"), ["cell"], "q_row", "q", "pos", "key_vec", DIM).count() == 0
    assert nearest.top_k(qdf.where("false"), kdf, ["cell"], "q_row", "q", "pos", "key_vec", DIM).count() == 0


def test_recall_on_the_tables(spark, medium):
    import compare
    from vecloom.llm import oracle, queries

    want = set(compare.connect(medium).execute(oracle.P2).fetchall())
    got = {tuple(r) for r in queries.p2_found(spark, medium).collect()}
    assert len(got & want) >= 0.99 * len(want) and len(got) == len(want)
