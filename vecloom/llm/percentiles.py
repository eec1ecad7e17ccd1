"""Problem 5: percentiles of large columns from mergeable counts in signed logarithmic buckets.

A value x falls in bucket sign(x) * k with k = ceil(log_g |x|), where g = (1 + a) / (1 - a). The middle of
a bucket, 2 g^k / (1 + g), differs from every value in it by at most the share a. A sketch is a table of
(keys, column, bucket, count): sketches of days or partitions are combined by adding counts, and a
percentile is read off the running count over the buckets in order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative error of a percentile.
ALPHA = 0.01
#: Values nearer to zero than this are counted as zero.
LEAST = 1e-9


def _gamma(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    return (1 + alpha) / (1 - alpha)


def _shift() -> int:
    """Added to k, so that the bucket of a value that isn't zero never becomes 0."""
    return 1_000_000


def bucket_of(x: Column, alpha: float = ALPHA, least: float = LEAST) -> Column:
    """Signed bucket number; buckets sort as the values do. 0 is the zero bucket."""
    k = F.ceil(F.log(F.abs(x)) / F.lit(math.log(_gamma(alpha)))).cast("int") + _shift()
    return F.when(F.abs(x) < least, F.lit(0)).when(x > 0, k).otherwise(-k)


def value_of(bucket: Column, alpha: float = ALPHA) -> Column:
    """The middle of a bucket, within the share alpha of every value that is counted in it."""
    g = _gamma(alpha)
    size = F.pow(F.lit(g), (F.abs(bucket) - _shift()).cast("double")) * F.lit(2 / (1 + g))
    return F.when(bucket == 0, F.lit(0.0)).when(bucket > 0, size).otherwise(-size)


def sketch(df: DataFrame, keys: list[str], columns: list[str], alpha: float = ALPHA, least: float = LEAST) -> DataFrame:
    """keys, column, bucket, count: the counts of the finite values of each column.

    Null, NaN and infinite values aren't counted; negative values are, in the buckets below zero. A null in
    a key is a key of its own. The counts are summed before the shuffle, so a hot key costs no more than its
    buckets in each task. Values nearer to zero than `least` count as zero: there the relative bound doesn't hold.
    """
    one = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns]))
    x = F.col("v.x")
    return (
        df.select(*keys, one.alias("v"))
        .where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
        .groupBy(*keys, F.col("v.column").alias("column"), bucket_of(x, alpha, least).alias("bucket"))
        .agg(F.count("*").alias("count"))
    )


def merge(sketches: list[DataFrame], keys: list[str]) -> DataFrame:
    """One sketch of several (days, partitions), grouped by keys, which may be fewer than they have."""
    all_ = sketches[0]
    for s in sketches[1:]:
        all_ = all_.unionByName(s)
    return all_.groupBy(*keys, "column", "bucket").agg(F.sum("count").alias("count"))


def roll_up(counts: DataFrame, keys: list[str], groupings: list[list[str]]) -> DataFrame:
    """by, keys, column, bucket, count: the sketch merged for each grouping of its keys in one shuffle.

    by names the keys of the grouping, joined by a comma; keys outside the grouping are null.
    """
    types = {k: counts.schema[k].dataType for k in keys}
    of = F.explode(F.array(*[F.struct(F.lit(", ".join(g)).alias("by"), *[(F.col(k) if k in g else F.lit(None).cast(types[k])).alias(k) for k in keys]) for g in groupings]))
    each = counts.select(of.alias("of"), "column", "bucket", "count").select("of.*", "column", "bucket", "count")
    return each.groupBy("by", *keys, "column", "bucket").agg(F.sum("count").alias("count"))


def percentiles(counts: DataFrame, keys: list[str], ps: list[float], alpha: float = ALPHA) -> DataFrame:
    """keys, column, n, p, value: for each p the value at rank floor(p (n - 1)) of the n counted values.

    The value lies within the share alpha of the true value at that rank. A group has as many rows in the
    window as it has buckets: by the range of a DOUBLE at most some 70,000 at alpha 0.01, whatever the data.
    """
    if not ps or any(not 0 <= p <= 1 for p in ps):
        raise ValueError("percentiles must lie between 0 and 1")
    by = Window.partitionBy(*keys, "column")
    upto = F.sum("count").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("count").over(by)
    run = counts.withColumn("upto", upto).withColumn("n", total)
    p = F.explode(F.array(*[F.lit(float(v)) for v in ps]))
    return (
        run.select(*keys, "column", "n", "upto", "count", "bucket", p.alias("p"))
        .where((F.floor(F.col("p") * (F.col("n") - 1)) < F.col("upto")) & (F.floor(F.col("p") * (F.col("n") - 1)) >= F.col("upto") - F.col("count")))
        .select(*keys, "column", "n", "p", value_of(F.col("bucket"), alpha).alias("value"))
    )
