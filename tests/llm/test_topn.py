from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from vecloom.llm import topn

SCHEMA = "layer int, p_row bigint, top_ix int, top_sc float, place int, s string, code bigint"


def brute(rows, n):
    best = defaultdict(dict)
    for la, p, ix, sc, *_ in rows:
        if ix is not None and ix >= 0 and sc is not None and np.isfinite(sc):
            sc = float(np.float32(sc)) + 0.0
            best[la, p][ix] = max(sc, best[la, p].get(ix, -np.inf))
    return {g: [ix for ix, _ in sorted(b.items(), key=lambda x: (-x[1], x[0]))[:n]] for g, b in best.items()}


def result(df):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: r.place):
        out[r.layer, r.p_row].append(r.top_ix)
        assert r.place == len(out[r.layer, r.p_row])
    return dict(out)


def test_codes_keep_the_order():
    sc = np.array([-np.float32(3e38), -2.5, -1e-40, -0.0, 0.0, 1e-40, 1.0, 1.0000001, 3e38], np.float32)
    code = topn.encode(sc, np.zeros(len(sc), np.int32))
    assert code[3] == code[4] and (np.diff(np.delete(code, 3)) > 0).all()
    s, i = topn.decode(topn.encode(sc, np.full(len(sc), 7, np.int32)))
    assert (s == sc).all() and (i == 7).all()
    assert topn.encode(np.float32([1, 1]), np.array([3, 4]))[0] > topn.encode(np.float32([1, 1]), np.array([3, 4]))[1]


def test_bisection_equals_sorting():
    rng = np.random.default_rng(0)
    for n in (1, 3, 8):
        g = rng.integers(0, 50, 4000)
        g = np.r_[g, np.zeros(3000, int)]  # a hot group
        code = rng.permutation(len(g)).astype(np.int64) * rng.integers(1, 2**30) - 5
        keep = topn.bisect_top(g, code, n)
        for k in range(50):
            mine = np.sort(code[g == k])[::-1]
            assert sorted(code[(g == k) & keep], reverse=True) == mine[:n].tolist()


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_brute_force(spark, monkeypatch, parts):
    random.seed(parts)
    rows = []
    for _ in range(6000):
        hot = random.random() < 0.4
        la, p = (1, 0) if hot else (random.choice([1, 2, None]), random.randrange(60))
        sc = random.choice([random.choice([0.5, 1.0, -1.0, 0.0, -0.0]), random.gauss(0, 3), None, float("nan"), float("inf"), -float("inf")])
        rows.append((la, p if random.random() > 0.02 else None, random.choice([random.randrange(40), random.randrange(2**31), -1, None]), sc, 9, "x", 1))
    rows += rows[:500]  # exact duplicates
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    assert result(topn.top_n_per_group(df, ["layer", "p_row"], "top_sc", "top_ix", 8)) == brute(rows, 8)


def test_blocks_that_split_a_group(spark, monkeypatch):
    monkeypatch.setattr(topn, "BLOCK_ROWS", 1)
    rows = [(1, k % 2, k, float(k % 5), 0, "", 0) for k in range(300)]
    t = __import__("pyarrow").table({"g0": [1] * 5, "code": topn.encode(np.float32([1, 2, 3, 2, 1]), np.arange(5))})
    cut, _ = topn._cut(t, ["g0"], 2)
    assert topn.decode(cut.column("code").to_numpy())[1].tolist() == [2, 1]
    assert result(topn.top_n_per_group(spark.createDataFrame(rows, SCHEMA), ["layer", "p_row"], "top_sc", "top_ix", 3)) == brute(rows, 3)


def test_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert topn.top_n_per_group(df, ["layer"], "top_sc", "top_ix", 8).count() == 0
    with pytest.raises(ValueError):
        topn.top_n_per_group(df, ["layer"], "top_sc", "top_ix", 0)
