"""Places of rows in the order of long groups, and samples by stride."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import spooled

#: Rows that a task orders, about, and the most ranges that a group is cut into.
RANGE_ROWS, MOST_RANGES = 1 << 20, 1 << 10
#: How many points of a series a figure of each kind takes.
LIMITS = {"distribution": 50_000, "kde": 10_000, "points": 200}


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], range_rows: int) -> DataFrame:
    """df with __p and __n, under names that no column of df has meanwhile."""
    x = F.col(order[0])
    x = (x.cast("timestamp") if dict(df.dtypes)[order[0]].startswith(("timestamp", "date")) else x).cast("double")
    own = {c: c if c in keys else f"__o_{c}" for c in df.columns}
    rows = df.select(*(F.col(c).alias(o) for c, o in own.items()), x.alias("__x"))
    steps = F.array(*(F.lit(k / MOST_RANGES) for k in range(1, MOST_RANGES)))
    parts = F.least(F.lit(MOST_RANGES), F.ceil(F.col("__n") / range_rows)).cast("int")
    every = F.transform(F.sequence(F.lit(1), F.greatest(parts - 1, F.lit(1))), lambda k: F.get("__s", (k * MOST_RANGES / parts).cast("int") - 1))
    cuts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__x", steps, F.lit(4 * MOST_RANGES)).alias("__s"))
    cuts = spooled(cuts.select(*keys, "__n", F.when(parts > 1, F.array_distinct(every)).otherwise(F.array().cast("array<double>")).alias("__s")), "ranges")
    joined = rows.join(cuts, list(keys)) if keys else rows.crossJoin(F.broadcast(cuts))
    ranged = joined.withColumn("__r", F.coalesce(F.size(F.filter("__s", lambda c: c < F.col("__x"))), F.lit(0))).drop("__s")
    sizes = ranged.groupBy(*keys, "__r").agg(F.count(F.lit(1)).alias("__k"))
    before = spooled(sizes.select(*keys, "__r", (F.sum("__k").over(W.partitionBy(*keys).orderBy("__r")) - F.col("__k")).alias("__before")), "range-sizes")
    within = F.row_number().over(W.partitionBy(*keys, "__r").orderBy(*(own[c] for c in order))) - 1
    placed = ranged.withColumn("__w", within).join(before, [*keys, "__r"])
    return placed.select(*(F.col(o).alias(c) for c, o in own.items()), (F.col("__before") + F.col("__w")).alias("__p"), "__n")


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, range_rows: int = RANGE_ROWS, position: str = "position", total: str = "n") -> DataFrame:
    """df with position (from 0 in the order of its group, NULLs first) and n (rows of the group).

    A group is cut into ranges of the first column of order, a number or a time, by a sketch; rows are numbered within their range, and the
    ranges before are added up. So no task orders a long group. Rows equal in all of order share no position, but which comes first isn't defined.
    """
    return _placed(df, keys, order, range_rows).withColumnsRenamed({"__p": position, "__n": total})


def stride_sample(df: DataFrame, keys: Sequence[str], order: Sequence[str], limit: int = LIMITS["distribution"], *, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Of each group every step-th row from the first on, limit at most, where step is its rows over limit; groups of limit rows or fewer, and all for a limit below 1, whole."""
    if limit < 1:
        return df
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / limit))
    placed = _placed(df, keys, order, range_rows)
    return placed.filter((F.col("__p") % step == 0) & (F.col("__p") < step * limit)).select(df.columns)
