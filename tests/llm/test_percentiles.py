from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from vecloom.llm import percentiles as P

PS = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]


def rows():
    random.seed(4)
    out = []
    for g in ("a", "b", None):
        for k in range(400):
            x = random.choice([math.exp(random.gauss(0, 3)), -math.exp(random.gauss(0, 2)), 0.0, 1e-300, float("nan"), float("inf"), None, 1e9])
            out.append((g, k % 7, x, 1, 1, "x"))
    return out


def exact(values, p):
    v = sorted(x for x in values if x is not None and math.isfinite(x))
    return v[math.floor(p * (len(v) - 1))], len(v)


def test_error_bound_and_merge(spark):
    data = rows()
    df = spark.createDataFrame(data, "g string, day int, x double, count int, bucket int, column string").select("g", "day", "x")
    days = P.sketch(df, ["g", "day"], ["x"])
    merged = P.merge([days.where("day < 3"), days.where("day >= 3")], ["g"])
    for counts in (P.sketch(df, ["g"], ["x"]), merged):
        got = P.percentiles(counts, ["g"], PS).collect()
        assert len(got) == 3 * len(PS)
        for r in got:
            want, n = exact([x for g, _, x, *_ in data if g == r.g], r.p)
            assert r.n == n and abs(r.value - want) <= P.ALPHA * abs(want) * (1 + 1e-9) + P.LEAST


def test_bucket_edges(spark):
    xs = [P._gamma(P.ALPHA) ** k for k in (-400, -3, 0, 1, 7, 900)] + [1e-8, 1.7e308, 5e-324]
    df = spark.createDataFrame([(s * x,) for x in xs for s in (1.0, -1.0)], "x double")
    for r in df.select("x", P.value_of(P.bucket_of(F.col("x"))).alias("v")).collect():
        assert abs(r.v - r.x) <= P.ALPHA * abs(r.x) * (1 + 1e-6) + P.LEAST


def test_roll_up_equals_single_groupings(spark):
    df = spark.createDataFrame(rows(), "g string, day int, x double, a int, b int, c string").select("g", "day", "x")
    up = P.roll_up(P.sketch(df, ["g", "day"], ["x"]), ["g", "day"], [["g"], ["g", "day"]])
    got = {(r.g, r.day, r.bucket): r["count"] for r in up.where("by = 'g'").collect()}
    assert got == {(r.g, None, r.bucket): r["count"] for r in P.sketch(df, ["g"], ["x"]).collect()}


def test_nothing(spark):
    df = spark.createDataFrame([(None, float("nan")), (1, None)], "g int, x double")
    assert P.percentiles(P.sketch(df, ["g"], ["x"]), ["g"], PS).count() == 0
    with pytest.raises(ValueError):
        P.percentiles(P.sketch(df, ["g"], ["x"]), ["g"], [1.5])


def test_the_least_value_is_a_parameter(spark):
    df = spark.createDataFrame([(1e-12,), (1e-12,), (5.0,)], "x double")
    for least, want in ((P.LEAST, 0.0), (1e-15, 1e-12)):
        got = P.percentiles(P.sketch(df, [], ["x"], least=least), [], [0.5]).first().value
        assert abs(got - want) <= 0.01 * want
