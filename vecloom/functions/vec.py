"""Vectors as array columns, and log-domain arithmetic. A null vector, or one of another length, gives null."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def neg_inf() -> Column:
    return F.lit(float("-inf"))


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value evaluated once: Spark would compute it anew wherever, and as often as, a lambda names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def dot(a: Column, b: Column) -> Column:
    """Inner product, summed from the first number to the last."""
    s = F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), s)


def norm(a: Column) -> Column:
    return let(a, lambda v: F.sqrt(dot(v, v)))


def scale(a: Column, k: Column) -> Column:
    return let(k, lambda c: F.transform(doubles(a), lambda x: x * c))


def unit(a: Column) -> Column:
    """a over its norm, the norm floored at 1e-30."""
    return let(a, lambda v: scale(v, F.lit(1.0) / F.greatest(norm(v), F.lit(1e-30))))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(doubles(a), doubles(b), lambda x, y: x - y)


def l2(a: Column, b: Column) -> Column:
    return norm(sub(a, b))


def cosine(a: Column, b: Column) -> Column:
    """Null where either is the null vector or all zero."""
    of = lambda x, y: let(norm(x) * norm(y), lambda n: F.when(n > 0, dot(x, y) / n))
    return let(a, lambda x: let(b, lambda y: of(x, y)))


def rel_err(out: Column, exact: Column) -> Column:
    """|out - exact| / |exact|."""
    return l2(out, exact) / norm(exact)


def matvec(rows: Column, v: Column) -> Column:
    """Matrix (array of rows) times vector."""
    return let(v, lambda x: F.transform(rows, lambda r: dot(r, x)))


def ln(x: Column) -> Column:
    """Natural logarithm, minus infinity at 0 and below (Spark's own gives null)."""
    return F.when(x <= 0, neg_inf()).otherwise(F.log(x))


def logaddexp(a: Column, b: Column) -> Column:
    """ln(e^a + e^b); minus infinity if both are."""
    top = F.greatest(a, b)
    return F.when(top == neg_inf(), neg_inf()).otherwise(top + F.log1p(F.exp(-F.abs(a - b))))


def merge_out(a: Column, lse_a: Column, b: Column, lse_b: Column) -> Column:
    """The output of two merged softmax partitions: each weighted by e^(its lse - the common lse)."""
    lse = logaddexp(lse_a, lse_b)
    wa = F.when(lse_a == neg_inf(), F.lit(0.0)).otherwise(F.exp(lse_a - lse))
    wb = F.when(lse_b == neg_inf(), F.lit(0.0)).otherwise(F.exp(lse_b - lse))
    return add(scale(a, wa), scale(b, wb))


def rope_inv_freq(head_dim: int, theta: float = 10_000.0, factor: float = 1.0) -> list[float]:
    """Inverse frequencies of the rotated pairs (i, i + rot/2)."""
    rot = int(head_dim * factor)
    return [1.0 / theta ** (i / rot) for i in range(0, rot, 2)]


def rope_shift(q: Column, delta: Column, inv_freq: list[float]) -> Column:
    """q rotated forward by delta positions; dimensions beyond the rotated ones stay."""
    n = len(inv_freq)
    freq = F.array(*[F.lit(f) for f in inv_freq])
    at = lambda i: F.element_at(doubles(q), i + F.lit(1))
    angle = lambda i: delta.cast("double") * F.element_at(freq, i + F.lit(1))
    idx = F.sequence(F.lit(0), F.lit(n - 1))
    first = F.transform(idx, lambda i: at(i) * F.cos(angle(i)) - at(i + F.lit(n)) * F.sin(angle(i)))
    second = F.transform(idx, lambda i: at(i) * F.sin(angle(i)) + at(i + F.lit(n)) * F.cos(angle(i)))
    return F.concat(first, second, F.slice(doubles(q), F.lit(2 * n + 1), F.greatest(F.size(q) - F.lit(2 * n), F.lit(0))))


def log_spaced(ctx: int, n: int) -> list[int]:
    """Distinct whole numbers from 1 to ctx - 1, evenly spaced in their logarithm."""
    if ctx < 2 or n < 2:
        return [1]
    top = math.log2(ctx - 1)
    return sorted({int(2 ** (top * i / (n - 1))) for i in range(n)})
