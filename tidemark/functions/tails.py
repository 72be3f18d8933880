"""Tail probabilities and quantiles of the normal, t, F and Kendall distributions, on numpy arrays and as columns."""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def beta_fraction(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if not 0 < x < 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / max(abs(1 - (a + b) * x / (a + 1)), TINY) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    out = d
    for k in range(1, 400):
        for term in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d, c = 1 + term * d, 1 + term / c
            d, c = 1 / (d if abs(d) > TINY else TINY), c if abs(c) > TINY else TINY
            step = d * c
            out *= step
        if abs(step - 1) < 1e-15:
            break
    return front * out


def t_two_sided(t: float, df: float) -> float:
    return beta_fraction(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_fraction(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def t_quantile(p: float, df: float) -> float:
    """The p quantile (p over one half), by bisection on the tail."""
    lo, hi = 0.0, 1.0
    while 1 - t_two_sided(hi, df) / 2 < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - t_two_sided(mid, df) / 2 < p else (lo, mid)
    return (lo + hi) / 2


@functools.cache
def kendall_counts(n: int) -> tuple[int, ...]:
    """How many permutations of n have 0, 1, 2 ... inversions."""
    counts = [1]
    for k in range(2, n + 1):
        sums = np.cumsum(np.array(counts, dtype=object))
        size = len(counts) + k - 1
        counts = [(sums[min(i, len(sums) - 1)] - (sums[i - k] if i >= k else 0)) for i in range(size)]
    return tuple(int(c) for c in counts)


def kendall_two_sided(s: float, n: int, ties: float = 0.0) -> float | None:
    """p of the pair score s: exact up to n = 50 without ties, else normal with the variance corrected by ties = sum t(t-1)(2t+5)."""
    if n < 4:
        return None
    if n <= 50 and ties == 0:
        counts, total = kendall_counts(n), math.factorial(n)
        least = min((n * (n - 1) // 2 - int(s)) // 2, (n * (n - 1) // 2 + int(s)) // 2)
        return min(1.0, 2 * sum(counts[: least + 1]) / total)
    var = (n * (n - 1) * (2 * n + 5) - ties) / 18
    return normal_two_sided(s / math.sqrt(var)) if var > 0 else None


def _column(fn, *columns: Column) -> Column:
    """fn, applied to each row of Arrow batches: one row per cell, not per observation."""

    @F.pandas_udf("double")
    def run(*args: pd.Series) -> pd.Series:
        rows = zip(*args, strict=True)
        return pd.Series([None if any(pd.isna(x) for x in r) else fn(*r) for r in rows], dtype="float64")

    return run(*columns)


def p_t(t: Column, df: Column) -> Column:
    return _column(t_two_sided, t, df)


def p_f(f: Column, d1: Column, d2: Column) -> Column:
    return _column(f_upper, f, d1.cast("double"), d2.cast("double"))


def p_kendall(s: Column, n: Column, ties: Column) -> Column:
    return _column(lambda s, n, t: kendall_two_sided(s, int(n), t), s.cast("double"), n, ties.cast("double"))


def q_t(p: float, df: Column) -> Column:
    return _column(lambda d: t_quantile(p, d), df.cast("double"))
