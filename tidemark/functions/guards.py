"""Column helpers that keep NULL as the only missing value."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Named = str | Column


def col(c: Named) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: Named, sentinels: Sequence[float] = ()) -> Column:
    """NULL for NaN, infinities and sentinel values."""
    c = col(c).cast("double")
    ok = ~F.isnan(c) & (F.abs(c) != float("inf"))
    for s in sentinels:
        ok &= c != float(s)
    return F.when(ok, c)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def root(c: Column) -> Column:
    """Square root of what is negative by rounding alone."""
    return F.sqrt(F.greatest(c, F.lit(0.0)))


def weighted_mean(x: Named, w: Named) -> Column:
    """An aggregate: sum(w x) / sum(w) over the rows that have both."""
    x, w = col(x), col(w)
    return ratio(F.sum(x * w), F.sum(F.when(x.isNotNull(), w)))


def histogram_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """0 ... bins-1, bins closed on the left and the last one on both sides; 0 where low = high."""
    return F.when(low == high, F.lit(0)).otherwise(F.least(F.floor(ratio((x - low) * bins, high - low)), F.lit(bins - 1))).cast("int")


def plus(shift: Column | None, c: Column, fun: Callable[[Column], Column] | None) -> Column:
    """fun(c + shift), each where given."""
    c = c if shift is None else c + shift
    return c if fun is None else fun(c)
