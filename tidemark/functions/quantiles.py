"""Exact percentiles of large groups, selected by brackets of a sketch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import spooled

#: The sketch's ranks are right within 1 / ACCURACY of a group; brackets reach twice as far to either side.
ACCURACY, REACH = 4000, 2 / 4000
#: Groups of no more values than this are counted value by value.
SMALL = 20_000


def _sketched(rows: DataFrame, keys: Sequence[str], at: Sequence[float]) -> DataFrame:
    """(keys, n, __s): each group's size, and values near the given shares of it. Written, so that a second pass joins a table of known size."""
    shares = F.array(*(F.lit(min(1.0, max(0.0, float(p)))) for p in at))
    return spooled(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("__v", shares, F.lit(ACCURACY)).alias("__s")), "quantiles")


def _counted(rows: DataFrame, sketch: DataFrame, keys: Sequence[str], brackets: Column) -> DataFrame:
    """(keys, n, __v, __from, __to): the values inside brackets (an array of (lo, hi)) with the ranks that they take.

    Of the values outside only their number per gap between brackets is kept, so what is shuffled is small; a task adds up its own first.
    """
    narrow = F.when(F.col("n") > SMALL, brackets)
    known = sketch.withColumn("__b", narrow).withColumn("__c", F.array_sort(F.array_distinct(F.flatten(F.transform("__b", lambda b: F.array(b["lo"], b["hi"]))))))
    v = F.col("__v")
    gap = F.coalesce(F.size(F.filter("__c", lambda c: c < v)), F.lit(0))
    inside = F.col("__b").isNull() | F.exists("__b", lambda b: v.between(b["lo"], b["hi"]))
    joined = rows.join(known.drop("__s"), list(keys)) if keys else rows.crossJoin(F.broadcast(known.drop("__s")))
    held = joined.groupBy(*keys, "n", F.when(F.col("__c").isNull(), 0).otherwise(gap).alias("__g"), F.when(inside, v).alias("__v")).agg(F.count(F.lit(1)).alias("__k"))
    upto = F.sum("__k").over(W.partitionBy(*keys).orderBy("__g", F.asc_nulls_first("__v")).rowsBetween(W.unboundedPreceding, 0))
    return held.withColumn("__to", upto).withColumn("__from", F.col("__to") - F.col("__k")).select(*keys, "n", "__v", "__from", "__to")


def _bracket(lo: int, hi: int) -> Column:
    return F.struct(F.get("__s", F.lit(lo)).alias("lo"), F.get("__s", F.lit(hi)).alias("hi"))


def _at(place: Column) -> Column:
    """An aggregate: the value that takes this rank. A value outside of its bracket would be a sketch that broke its bound."""
    here = (F.col("__from") <= place) & (F.col("__to") > place)
    return F.max(F.when(here, F.coalesce(F.col("__v"), F.raise_error(F.lit("a percentile lies outside of its bracket")).cast("double"))))


def _between(lo: Column, hi: Column, part: Column) -> Column:
    return F.when(lo == hi, lo).otherwise((1 - part) * lo + part * hi)


def _rows(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float]) -> DataFrame:
    """(keys, n, q): the percentiles at of each group's values, interpolated as percentile does, in an array; NULLs don't count.

    df is read twice: once for a sketch that gives two bounds round each percentile, once for the number of values below and
    those between the bounds. No task holds a group. Groups whose key is NULL have no row.
    """
    rows = _rows(df, keys, value)
    sketch = _sketched(rows, keys, [p + s for p in at for s in (-REACH, REACH)])
    counted = _counted(rows, sketch, keys, F.array(*(_bracket(2 * k, 2 * k + 1) for k in range(len(at)))))
    place = [(F.col("n") - 1) * F.lit(float(p)) for p in at]
    found = [f(p).alias(f"__{side}{k}") for k, p in enumerate(place) for side, f in (("lo", lambda p: _at(F.floor(p))), ("hi", lambda p: _at(F.ceil(p))))]
    got = counted.groupBy(*keys, "n").agg(*found)
    return got.select(*keys, "n", F.array(*(_between(F.col(f"__lo{k}"), F.col(f"__hi{k}"), p - F.floor(p)) for k, p in enumerate(place))).alias("q"))


#: Steps of the grids that tell how far ties at the cuts can move the middle.
STEPS = 20


def clipped_median(df: DataFrame, keys: Sequence[str], value: str, low: float = 0.05, high: float = 0.95, least: int = 0) -> DataFrame:
    """(keys, n, low, high, kept, median): of each group the percentiles low and high, how many values lie between them, and their median.

    All come from one sketch and one pass, as in quantiles. How many values lie below the lower cut depends on ties there; the sketch
    bounds it, and so the middle's bracket. Groups of least values or fewer stay whole; the median of none is NULL.
    """
    rows = _rows(df, keys, value)
    under = [low * k / STEPS for k in range(STEPS)]
    over = [1 - (1 - high) * k / STEPS for k in range(STEPS)]
    span = ((low + 1) - high) / 2
    middle = [(low + high) / 2 - span + span * k / STEPS for k in range(2 * STEPS + 1)]
    shares = [low - REACH, low + REACH, high - REACH, high + REACH, *under, *over, *middle]
    sketch = _sketched(rows, keys, shares)
    s = lambda k: F.get("__s", F.lit(k) if isinstance(k, int) else k)
    part = lambda first, n: F.slice("__s", first + 1, n)
    # at least this share lies below the lower cut, at most that share up to the upper one; the grids' steps are even
    m, n = F.size(F.filter(part(4, STEPS), lambda v: v < s(0))), F.size(F.filter(part(4 + STEPS, STEPS), lambda v: v > s(3)))
    below = F.when(m > 0, F.greatest(F.lit(0.0), (m - 1) * (low / STEPS) - REACH)).otherwise(0.0)
    upto = F.when(n > 0, F.least(F.lit(1.0), 1 - (n - 1) * ((1 - high) / STEPS) + REACH)).otherwise(1.0)
    near = 4 + 2 * STEPS
    place = lambda share: (share - middle[0]) / (middle[1] - middle[0])
    lo = s(near + F.greatest(F.lit(0), F.floor(place((below + high) / 2 - 3 * REACH))).cast("int"))
    hi = s(near + F.least(F.lit(2 * STEPS), F.ceil(place((low + upto) / 2 + 3 * REACH))).cast("int"))
    counted = _counted(rows, sketch, keys, F.array(_bracket(0, 1), _bracket(2, 3), F.struct(lo.alias("lo"), hi.alias("hi"))))
    w = W.partitionBy(*keys)
    ranks = {"__a": (F.col("n") - 1) * F.lit(float(low)), "__b": (F.col("n") - 1) * F.lit(float(high))}
    got = counted
    for name, place in ranks.items():
        got = got.withColumn(name, _between(_at(F.floor(place)).over(w), _at(F.ceil(place)).over(w), place - F.floor(place)))
    whole = F.col("n") <= least
    got = got.withColumn("__below", F.when(whole, F.lit(0)).otherwise(F.min(F.when(F.col("__v") >= F.col("__a"), F.col("__from"))).over(w)))
    got = got.withColumn("kept", F.when(whole, F.col("n")).otherwise(F.max(F.when(F.col("__v") <= F.col("__b"), F.col("__to"))).over(w)) - F.col("__below"))
    place = F.col("__below") + (F.col("kept") - 1) / 2
    found = got.groupBy(*keys, "n", F.col("__a").alias("low"), F.col("__b").alias("high"), "kept").agg(_at(F.floor(place)).alias("__lo"), _at(F.ceil(place)).alias("__hi"))
    return found.select(*keys, "n", "low", "high", "kept", F.when(F.col("kept") > 0, (F.col("__lo") + F.col("__hi")) / 2).alias("median"))
