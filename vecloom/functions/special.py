"""Functions that Spark lacks, as vectorised Arrow UDFs."""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def log_ndtr(x: np.ndarray) -> np.ndarray:
    """ln of the standard normal distribution function, accurate far into both tails; whole arrays at a time.

    With z = |x| / sqrt 2, the smaller tail is exp(-z^2) times a power series of positive terms taken from one half
    (z < 2), or times a continued fraction (beyond).
    """
    x = np.asarray(x, np.float64)
    z = np.where(np.isfinite(x), np.abs(x) / math.sqrt(2), 0.0)
    near, far = np.minimum(z, 2.0), np.maximum(z, 2.0)
    term = near * (2 / math.sqrt(math.pi))
    series = term.copy()
    for k in range(1, 48):
        term = term * (2 * near * near / (2 * k + 1))
        series += term
    tail_near = np.log(0.5 - 0.5 * np.exp(-near * near) * series)
    fraction = far.copy()
    for k in range(90, 0, -1):
        fraction = far + (0.5 * k) / fraction
    tail_far = -far * far - np.log(fraction) - 0.5 * math.log(4 * math.pi)
    tail = np.where(z < 2, tail_near, tail_far)
    out = np.where(x > 0, np.log1p(-np.exp(tail)), tail)
    return np.where(np.isnan(x), np.nan, np.where(np.isposinf(x), 0.0, np.where(np.isneginf(x), -np.inf, out)))


@F.pandas_udf(T.DoubleType())
def _log_ndtr(x: pd.Series) -> pd.Series:
    return pd.Series(log_ndtr(x.to_numpy(dtype=np.float64, na_value=np.nan)))


def log_ndtr_col(x: Column) -> Column:
    return _log_ndtr(x)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility form NFKC; null stays null."""
    return s.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one row of the table at a time."""
    if len(b) > len(a):
        a, b = b, a
    code: dict[str, int] = {}
    y = np.fromiter((code.setdefault(t, len(code)) for t in b), np.int64, len(b))
    row = np.zeros(len(y) + 1, np.int64)
    for t in a:
        k = code.get(t)
        if k is not None:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == k, row[:-1] + 1, 0)))
    return int(row[-1])


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    """LCS of the words of two texts, separated by blanks; 0 where one is null or empty. Texts travel as strings, not as arrays."""
    return pd.Series([lcs(x.split(" "), y.split(" ")) if x and y else 0 for x, y in zip(a, b)], dtype="int32")


@F.pandas_udf(T.IntegerType())
def common_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """How many words two texts have in common, each as often as it is in both; one walk over each text."""

    def common(x: str, y: str) -> int:
        left = Counter(x.split(" "))
        n = 0
        for w in y.split(" "):
            if left[w] > 0:
                left[w] -= 1
                n += 1
        return n

    return pd.Series([common(x, y) if x and y else 0 for x, y in zip(a, b)], dtype="int32")
