"""Pairs of simulated and reference values, and which of them count."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.guards import finite
from ..functions.quantiles import quantiles


def pair(sims: DataFrame, refs: DataFrame, on: Sequence[str] = ("variable", "cell", "time"), *, sim: str = "source", ref: str = "source", value: str = "value") -> DataFrame:
    """(sim, ref, *on, s, o): every sim with every ref where both have a finite value. One equi-join serves all pairs."""
    left = sims.select(F.col(sim).alias("sim"), *on, finite(value).alias("s")).filter("s IS NOT NULL")
    right = refs.select(F.col(ref).alias("ref"), *on, finite(value).alias("o")).filter("o IS NOT NULL")
    return left.join(right, list(on))


def pair_aligned(sims: DataFrame, refs: DataFrame, on: Sequence[str] = ("variable", "cell", "time"), *, value: str = "value") -> DataFrame:
    """As pair, but rows whose value is missing on either side stay, with NULLs in both: the common time axis."""
    left = sims.select(F.col("source").alias("sim"), *on, finite(value).alias("s"))
    right = refs.select(F.col("source").alias("ref"), *on, finite(value).alias("o"))
    both = F.col("s").isNotNull() & F.col("o").isNotNull()
    return left.join(right, list(on)).withColumns({c: F.when(both, F.col(c)) for c in ("s", "o")})


def one_sided(sims: DataFrame, refs: DataFrame, on: Sequence[str] = ("variable", "cell", "time")) -> DataFrame:
    """Keys that only one side has (strict alignment asks for none), with that side."""
    left = sims.select(*on).distinct().withColumn("in_sim", F.lit(1))
    right = refs.select(*on).distinct().withColumn("in_ref", F.lit(1))
    return left.join(right, list(on), "full_outer").filter("in_sim IS NULL OR in_ref IS NULL").select(*on, F.when(F.col("in_sim").isNull(), "ref").otherwise("sim").alias("side"))


def pair_stations(sims: DataFrame, refs: DataFrame, normalised: str, *, station: str = "station_id", time: str = "time", value: str = "value") -> DataFrame:
    """Station pairs by exact time, and by the period that holds it (day, month ...) for stations without any exact match."""
    exact = pair(sims, refs, [station, time], value=value)
    done = exact.select(station, "sim", "ref").distinct()
    stamp = lambda df: df.withColumn(time, F.date_trunc(normalised, time))
    again = pair(stamp(sims), stamp(refs), [station, time], value=value).join(done, [station, "sim", "ref"], "left_anti")
    return exact.unionByName(again.select(exact.columns))


def axes(df: DataFrame, on: Sequence[str] = ("variable", "cell", "time")) -> DataFrame:
    """(variable, source, time): the times of each source, whether or not a value stands there."""
    return df.select(*(c for c in on if c == "variable"), "source", "time").distinct()


def axis_findings(sims: DataFrame, refs: DataFrame, on: Sequence[str] = ("variable", "cell", "time")) -> DataFrame:
    """(variable, source, finding) of sims whose axis is not the reference's: another length, other times, or no time in common."""
    by = [c for c in on if c == "variable"]
    s, r = axes(sims, on), axes(refs, on).drop("source").distinct().withColumn("__r", F.lit(1))
    there = r.groupBy(*by).agg(F.count(F.lit(1)).alias("__want"))
    got = s.join(r, [*by, "time"], "left").groupBy(*by, "source").agg(F.count(F.lit(1)).alias("__have"), F.count("__r").alias("__both"))
    known = got.join(there, by) if by else got.crossJoin(F.broadcast(there))
    finding = F.when(F.col("__both") == 0, "no time in common").when(F.col("__have") != F.col("__want"), "another length").when(F.col("__both") != F.col("__have"), "other times")
    return known.select(*by, "source", finding.alias("finding")).filter("finding IS NOT NULL")


def unified_mask(sims: DataFrame, refs: DataFrame, on: Sequence[str] = ("variable", "cell", "time"), *, value: str = "value", strict: bool = False) -> DataFrame:
    """The refs at whose place no sim of the variable lacks a finite value. No order of the sims matters.

    A sim has a say only at the times of its own axis: a short sim doesn't cut the others, and a time that no sim has stays. A row with
    a NULL value is on the axis. A sim without a time in common fails the job; with strict so does any axis that isn't the reference's.
    """
    by = [c for c in on if c == "variable"]
    valid = sims.filter(finite(value).isNotNull()).groupBy(*on).agg(F.countDistinct("source").alias("__have"))
    asked = axes(sims, on).groupBy(*by, "time").agg(F.count(F.lit(1)).alias("__ask"))
    wrong = axis_findings(sims, refs, on).filter("true" if strict else "finding = 'no time in common'")
    said = wrong.agg(F.min(F.concat_ws(" ", "source", "finding")).alias("__wrong"))
    kept = refs.join(asked, [*by, "time"], "left").join(valid, list(on), "left").filter(F.coalesce("__ask", F.lit(0)) == F.coalesce("__have", F.lit(0))).select(refs.columns)
    fine = F.when(F.col("__wrong").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("axes differ: "), F.col("__wrong"))).cast("boolean"))
    return kept.crossJoin(F.broadcast(said)).filter(fine).drop("__wrong")


def clip(df: DataFrame, keys: Sequence[str], value: str = "value", low: float = 0.05, high: float = 0.95, least: int = 0) -> DataFrame:
    """Rows whose value lies between two percentiles of their group; groups of least rows or fewer stay whole."""
    kept = df.filter(F.col(value).isNotNull())
    bounds = quantiles(kept, keys, value, (low, high)).withColumnsRenamed({"q": "__q", "n": "__n"})
    return kept.join(bounds, list(keys)).filter((F.col("__n") <= least) | F.col(value).between(F.col("__q")[0], F.col("__q")[1])).drop("__q", "__n")


def plausible(df: DataFrame, name: str = "name", value: str = "value", low: float = -100.0, high: float = 100.0) -> DataFrame:
    """Percent biases outside [low, high] go; other names stay."""
    return df.filter(~F.col(name).isin("percent_bias", "absolute_percent_bias") | F.col(value).between(low, high))


def key_findings(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, finding): keys that are repeated on a side or missing on one. No rows means that the key sets are equal."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("l"))
    b = right.groupBy(key).agg(F.count(F.lit(1)).alias("r"))
    finding = F.when(F.col("l").isNull(), "missing left").when(F.col("r").isNull(), "missing right").when((F.col("l") > 1) | (F.col("r") > 1), "repeated")
    return a.join(b, key, "full_outer").select(key, finding.alias("finding")).filter("finding IS NOT NULL")


def align_to(base: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """The rows of other in base's key set, with NULLs where it has none."""
    return base.select(key).join(other, key, "left")


def complete_rows(frames: dict[str, DataFrame], on: Sequence[str], value: str = "value") -> DataFrame:
    """One column per frame, outer-merged, kept only for cells (the keys but time) with no missing value at all."""
    merged = None
    for name, df in frames.items():
        one = df.select(*on, finite(value).alias(name))
        merged = one if merged is None else merged.join(one, list(on), "full_outer")
    cells = [c for c in on if c != "time"]
    whole = F.count_if(~F.greatest(*(F.col(n).isNull() for n in frames), F.lit(False)))
    n = W.partitionBy(*cells)
    return merged.withColumn("__whole", whole.over(n) == F.count(F.lit(1)).over(n)).filter("__whole").drop("__whole")


def unfinished(tasks: DataFrame, ledger: DataFrame, on: Sequence[str] = ("variable", "sim", "ref", "hash")) -> DataFrame:
    """Tasks that the ledger has no equal row of."""
    return tasks.join(ledger, list(on), "left_anti")
