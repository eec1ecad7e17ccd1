from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from vecloom.llm import packing


def best(sizes, cap):
    """Fewest containers, by trying all orders of first fit."""
    out = len(sizes)
    for order in set(itertools.permutations(sizes)):
        boxes = []
        for s in order:
            for k, b in enumerate(boxes):
                if b + s <= cap:
                    boxes[k] += s
                    break
            else:
                boxes.append(s)
        out = min(out, len(boxes))
    return out


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=60), st.just(12))
def test_nothing_overflows_or_is_lost(sizes, cap):
    box = packing.assign(np.array(sizes, np.int64), cap)
    fill = Counter()
    for b, s in zip(box.tolist(), sizes):
        fill[b] += s
    assert len(box) == len(sizes) and all(v <= cap for v in fill.values())
    patterns = packing.plan(np.bincount(sizes, minlength=cap + 1)[: cap + 1], cap)
    assert Counter(s for s in sizes if s) == Counter({k: v for k, v in sum((Counter({x: c * t for x, c in Counter(p).items()}) for p, t in patterns), Counter()).items()})


def test_near_the_best():
    random.seed(2)
    for _ in range(25):
        sizes = [random.randint(1, 10) for _ in range(7)]
        assert packing.assign(np.array(sizes), 10).max() + 1 <= best(sizes, 10) + 1
    sizes = np.random.default_rng(0).integers(1, 700, 5000)
    n = packing.assign(sizes, 2048).max() + 1
    assert n <= 1.002 * -(-sizes.sum() // 2048)


def test_exact_complements():
    for sizes in ([6, 4], [5, 3, 2], [7, 1, 1, 1], [10]):
        assert packing.assign(np.array(sizes * 3), 10).max() == 2


def test_every_triple_is_found():
    """The largest member is the smallest of many that fit."""
    counts = np.zeros(1001, np.int64)
    counts[[205, 203, 101]] = 1
    counts[300:480] = 5
    counts[[304, 306, 408]] = 0  # none of the others makes 509 with one or two more
    s = packing.Sums(counts)
    assert s.single(509) is None and s.pair(509) is None and sorted(s.triple(509)) == [101, 203, 205]
    rng = random.Random(1)
    for _ in range(200):
        c = np.bincount([rng.randint(1, 40) for _ in range(8)], minlength=81)
        s, sizes = packing.Sums(c), [k for k in range(1, 81) for _ in range(c[k])]
        for gap in range(1, 81):
            for n, find in ((2, s.pair), (3, s.triple)):
                there = any(sum(x) == gap for x in itertools.combinations(sizes, n))
                got = find(gap)
                assert (got is not None) == there and (not got or sum(got) == gap and not Counter(got) - Counter(sizes))


def test_the_packing_follows_from_the_rows(spark):
    rows = [(k % 300, random.Random(k).randint(0, 40)) for k in range(900)] + [(5, 33)] * 400
    tiers = spark.createDataFrame([("s", 16)], "tier string, capacity_tokens int")
    df = spark.createDataFrame(rows, "id bigint, size int")
    made = [sorted(map(tuple, packing.pack(d, "id", "size", tiers, group_rows=200).collect())) for d in (df.repartition(3), df.orderBy("size").coalesce(1))]
    assert made[0] == made[1] and len({(r[1], r[2], r[3]) for r in made[0] if r[1][0] == "f"}) == sum(r[1][0] == "f" for r in made[0])


def test_rows(spark):
    rows = [(k, random.Random(k).choice([0, 3, 5, 8, 21, 40, 7]), "x", 0) for k in range(500)] + [(900, None, "x", 0), (901, -4, "x", 0), (None, 5, "x", 0), (7, 8, "x", 0), (7, 8, "x", 0)]
    df = spark.createDataFrame(rows, "id bigint, size int, container string, g int")
    tiers = spark.createDataFrame([("s", 10), ("l", 25), ("bad", 0), ("none", None)], "tier string, capacity_tokens int")
    got = packing.pack(df, "id", "size", tiers, group_rows=120).collect()
    assert {r.tier for r in got} == {"s", "l"}
    for tier, cap in (("s", 10), ("l", 25)):
        fill, pieces, whole = Counter(), defaultdict(list), Counter()
        for r in got:
            if r.tier == tier:
                fill[r.container] += r.size
                pieces[r.id].append((r.piece, r.size))
        assert max(fill.values()) <= cap
        want = Counter()
        for i, s, *_ in rows:
            want[i] += max(s or 0, 0)
        assert {i: sum(s for _, s in p) for i, p in pieces.items()} == dict(want)
        for i, s, *_ in rows:
            if i not in (7,):
                assert len(pieces[i]) == max(1, -(-max(s or 0, 0) // cap)), (i, s, pieces[i])
        assert not whole
    rep = {r.tier: r for r in packing.report(packing.pack(df, "id", "size", tiers), tiers).collect()}
    assert rep["s"].fill > 0.9 and rep["l"].fill > 0.9
    assert packing.pack(df.where("false"), "id", "size", tiers).count() == 0
    assert packing.pack(df, "id", "size", tiers.where("false")).count() == 0
