"""The numbers of a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import quantiles


def column_profile(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """n, mean, sd (ddof 1), min, max."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"))


def field_profile(df: DataFrame, keys: Sequence[str], cells: int, value: str = "value") -> DataFrame:
    """mean, sd (ddof 0), min, max, median, and the valid part of the grid's cells in percent."""
    middle = quantiles(df, keys, value, (0.5,)).select(*keys, F.col("q")[0].alias("median"))
    got = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"), (100 * F.count(value) / cells).alias("coverage"))
    return got.join(middle, list(keys), "left").select(*keys, "mean", "sd", "min", "max", "median", "coverage")


def best_and_worst(df: DataFrame, key: str, value: str, k: int = 3) -> DataFrame:
    """The k groups with the largest values and the k with the smallest; best if both."""
    best = df.orderBy(F.desc(value), key).limit(k).withColumn("side", F.lit("best"))
    worst = df.orderBy(value, key).limit(k).withColumn("side", F.lit("worst"))
    return best.unionByName(worst.join(best.select(key), key, "left_anti").select(best.columns))


def overall_summary(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """The mean per keys, and the mean of those with NULL keys."""
    each = df.groupBy(*keys).agg(F.avg(value).alias("mean"))
    return each.unionByName(each.agg(F.avg("mean").alias("mean")).select(*(F.lit(None).cast(each.schema[k].dataType).alias(k) for k in keys), "mean"))
