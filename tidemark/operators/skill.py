"""Metrics and scores of pairs (s, o) per group of keys, from few shared aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.guards import histogram_bin, plus, ratio, root
from ..sources.scratch import spooled

#: Mergeable moments, as SQL aggregates: one partial aggregation gives them all.
MOMENTS = {
    "n": "count(1)", "s_sum": "sum(s)", "o_sum": "sum(o)", "s_mean": "avg(s)", "o_mean": "avg(o)",
    "s_sd": "stddev_pop(s)", "o_sd": "stddev_pop(o)", "o_var": "var_pop(o)", "o_var1": "var_samp(o)", "cov": "covar_pop(s, o)",
    "d_sum": "sum(s - o)", "d_mean": "avg(s - o)", "d_abs": "avg(abs(s - o))", "d_sq": "avg((s - o) * (s - o))", "d_sd": "stddev_pop(s - o)", "d_var": "var_pop(s - o)",
    "s_max": "max(s)", "s_min": "min(s)", "o_max": "max(o)", "o_min": "min(o)",
}
#: Sums that need the reference's mean of the group, __om.
DEVIATIONS = {
    "a_sum": "sum(abs(s - o))", "b_sum": "sum(abs(o - __om))", "sse": "sum((s - o) * (s - o))",
    "spread": "sum((abs(s - __om) + abs(o - __om)) * (abs(s - __om) + abs(o - __om)))",
}

m = F.col


def _r() -> Column:
    return ratio(m("cov"), m("s_sd") * m("o_sd"))


def _kge(*parts: Column) -> Column:
    return 1 - F.sqrt(sum(((p - 1) * (p - 1) for p in parts), F.lit(0.0)))


def _br2() -> Column:
    """r2 damped by the slope of s on o; NULL where either is constant."""
    b = ratio(m("cov"), m("o_var"))
    return F.when(F.abs(b) <= 1, F.abs(b) * _r() * _r()).otherwise(ratio(_r() * _r(), F.abs(b)))


#: name -> column over the moments (and, for those in NEED_MEAN, the deviations).
METRICS: dict[str, Callable[[], Column]] = {
    "bias": lambda: m("d_mean"),
    "percent_bias": lambda: 100 * ratio(m("d_sum"), m("o_sum")),
    "absolute_percent_bias": lambda: 100 * ratio(F.abs(m("d_sum")), F.abs(m("o_sum"))),
    "mean_absolute_error": lambda: m("d_abs"),
    "RMSE": lambda: root(m("d_sq")),
    "ubRMSE": lambda: m("d_sd"),
    "CRMSD": lambda: root(m("s_sd") * m("s_sd") + m("o_sd") * m("o_sd") - 2 * m("s_sd") * m("o_sd") * _r()),
    "correlation": _r,
    "correlation_R2": lambda: _r() * _r(),
    "ubcorrelation": _r,
    "ubcorrelation_R2": lambda: _r() * _r(),
    "L": lambda: F.exp(-5 * ratio(m("d_sq"), m("o_var"))),
    "NSE": lambda: 1 - ratio(m("d_sq"), m("o_var")),
    "ubNSE": lambda: 1 - ratio(m("d_var"), m("o_var")),
    "KGE": lambda: _kge(_r(), ratio(m("s_sd"), m("o_sd")), ratio(m("s_mean"), m("o_mean"))),
    "KGESS": lambda: (METRICS["KGE"]() + 0.41) / 1.41,
    "ubKGE": lambda: _kge(_r(), ratio(m("s_sd"), m("o_sd"))),
    "rv": lambda: ratio(m("s_sd"), m("o_sd")) - 1,
    "pc_max": lambda: ratio(m("s_max") - m("o_max"), F.abs(m("o_max"))),
    "pc_min": lambda: ratio(m("s_min") - m("o_min"), F.abs(m("o_min"))),
    "pc_ampli": lambda: ratio(m("s_max") - m("s_min"), m("o_max") - m("o_min")) - 1,
    "br2": _br2,
    "smpi": lambda: ratio(m("d_mean") * m("d_mean"), m("o_var1")),
    "dr": lambda: F.when(m("a_sum") <= 2 * m("b_sum"), 1 - ratio(m("a_sum"), 2 * m("b_sum"))).otherwise(ratio(2 * m("b_sum"), m("a_sum")) - 1) + F.when(m("b_sum") == 0, F.lit(None).cast("double")).otherwise(0.0),
    "index_agreement": lambda: 1 - ratio(m("sse"), m("spread")),
    "nBiasScore": lambda: F.exp(-ratio(F.abs(m("d_mean")), m("o_sd"))),
    "nRMSEScore": lambda: F.exp(-ratio(m("d_sd"), m("o_sd"))),
}
NEED_MEAN = {"dr", "index_agreement"}
ALL_METRICS = [*(n for n in METRICS if not n.startswith("n") and n != "index_agreement"), "APFB", "cp", "kappa_coeff", "MFM_omega", "MFM_varphi", "MFM_eta", "MFM"]
ALL_SCORES = ["nBiasScore", "nRMSEScore", "nPhaseScore", "nIavScore", "nSpatialScore", "nSeasonalityScore", "index_agreement", "Overall_Score"]
SCORE_WEIGHTS = {"nBiasScore": 1, "nRMSEScore": 2, "nPhaseScore": 1, "nIavScore": 1, "nSpatialScore": 1}


def register(name: str, build: Callable[[], Column]) -> None:
    """Add a metric of one's own, as a column over the moments."""
    METRICS[name] = build


def transformed(pairs: DataFrame, keys: Sequence[str], fun: Callable[[Column], Column] | None = None, epsilon_type: str | None = None, epsilon: float = 0.0) -> DataFrame:
    """pairs with fun(x + e) for s and o; e is a hundredth of the reference's mean ("pushpalatha"), a part of it ("factor"), or constant."""
    mean = F.avg("o").over(W.partitionBy(*keys))
    shift = {"pushpalatha": mean / 100, "factor": mean * epsilon, "constant": F.lit(float(epsilon)), None: None}[epsilon_type]
    return pairs.withColumns({c: plus(shift, F.col(c), fun) for c in ("s", "o")})


def moments(pairs: DataFrame, keys: Sequence[str], *, with_mean: bool = False) -> DataFrame:
    """The moments of each group; with_mean also the sums about the reference's mean.

    The means are aggregated first and joined back, one row per group, so only partial sums are
    shuffled as long as the means fit a broadcast, and rows are never sorted by group.
    """
    if not with_mean:
        return pairs.groupBy(*keys).agg(*(F.expr(c).alias(n) for n, c in MOMENTS.items()))
    about = pairs.join(pairs.groupBy(*keys).agg(F.avg("o").alias("__om")), list(keys))
    return about.groupBy(*keys).agg(*(F.expr(c).alias(n) for n, c in (MOMENTS | DEVIATIONS).items()))


def metrics(pairs: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """keys with one column per name: metrics of METRICS, all from one aggregation."""
    found = moments(pairs, keys, with_mean=bool(NEED_MEAN & set(names)))
    return found.select(*keys, *(METRICS[n]().alias(n) for n in names))


def apfb(pairs: DataFrame, keys: Sequence[str], *, start_month: int = 1, per_year: bool = False, time: str = "time") -> DataFrame:
    """Annual peak-flow bias: the mean over (water) years of (max s - max o) / max o; years with max o = 0 don't count."""
    year = F.year(time) if start_month == 1 else F.year(time) + (F.month(time) >= start_month).cast("int")
    years = pairs.groupBy(*keys, year.alias("year")).agg(F.max("s").alias("s"), F.max("o").alias("o")).select(*keys, "year", ratio(F.col("s") - F.col("o"), F.col("o")).alias("APFB"))
    return years if per_year else years.groupBy(*keys).agg(F.avg("APFB").alias("APFB"))


def persistence(aligned: DataFrame, keys: Sequence[str], *, time: str = "time") -> DataFrame:
    """cp: 1 - sum (s_t - o_t)^2 / sum (o_t - o_t-1)^2 where all three are valid. Masked steps of the axis stay in it."""
    before = F.lag("o").over(W.partitionBy(*keys).orderBy(time))
    steps = aligned.withColumn("__b", before).filter("s IS NOT NULL AND o IS NOT NULL AND __b IS NOT NULL")
    return steps.groupBy(*keys).agg((1 - ratio(F.expr("sum((s - o) * (s - o))"), F.expr("sum((o - __b) * (o - __b))"))).alias("cp"))


def kappa(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Cohen's kappa of the whole parts of s and o."""
    table = pairs.groupBy(*keys, F.col("s").cast("int").alias("a"), F.col("o").cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = W.partitionBy(*keys)
    table = table.withColumns({"all": F.sum("n").over(total), "na": F.sum("n").over(W.partitionBy(*keys, "a")), "nb": F.sum("n").over(W.partitionBy(*keys, "b"))})
    agreed = table.groupBy(*keys).agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)) / F.max("all")).alias("po"), F.max("all").alias("all"))
    side = lambda c, n: table.select(*keys, F.col(c).alias("__k"), F.col(f"n{c}").alias(n)).distinct()
    chance = side("a", "x").join(side("b", "y"), [*keys, "__k"]).groupBy(*keys).agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    pe = F.coalesce("xy", F.lit(0)) / (F.col("all").cast("double") * F.col("all"))
    return agreed.join(chance, list(keys), "left").select(*keys, F.when(F.abs(1 - pe) >= 1e-10, (F.col("po") - pe) / (1 - pe)).alias("kappa_coeff"))


def _entropy(p: Column) -> Column:
    return -F.sum(F.when(p > 0, p * F.log(p)))


def shared_bins(pairs: DataFrame, keys: Sequence[str], bins: int) -> DataFrame:
    """(keys, bin, ns, no, n): counts of s and o in bins of their common range."""
    w = W.partitionBy(*keys)
    ranged = pairs.withColumns({"__lo": F.least(F.min("s").over(w), F.min("o").over(w)), "__hi": F.greatest(F.max("s").over(w), F.max("o").over(w)), "n": F.count(F.lit(1)).over(w)})
    both = F.explode(F.array(*(F.struct(F.lit(i).alias("is_s"), histogram_bin(F.col(c), F.col("__lo"), F.col("__hi"), bins).alias("bin")) for i, c in ((1, "s"), (0, "o")))))
    return ranged.select(*keys, "n", (F.col("__lo") == F.col("__hi")).alias("flat"), both.alias("x")).groupBy(*keys, "n", "flat", F.col("x.bin").alias("bin")).agg(F.sum("x.is_s").alias("ns"), F.sum(1 - F.col("x.is_s")).alias("no"))


def mfm(pairs: DataFrame, keys: Sequence[str], *, bins: int = 10, time: str = "time") -> DataFrame:
    """MFM_omega (phase and error), MFM_varphi (entropies), MFM_eta (histogram overlap) and MFM, their distance from 1.

    omega takes a Fourier transform of each group's series in order of time, which runs as numpy on
    the group; the others are aggregates. Series under 3 values give NULL.
    """
    shared = shared_bins(pairs, keys, bins)
    ps, po = F.col("ns") / F.col("n"), F.col("no") / F.col("n")
    together = shared.groupBy(*keys).agg(F.max("n").alias("n"), (F.sum(F.least("ns", "no")) / F.sum("no")).alias("MFM_eta"), F.abs(_entropy(ps) - _entropy(po)).alias("hs"))
    w = W.partitionBy(*keys)
    own = pairs.select(*keys, *(histogram_bin(F.col(c), F.min(c).over(w), F.max(c).over(w), bins).alias(f"b{c}") for c in "so"))
    own = own.select(*keys, F.explode(F.array(*(F.struct(F.lit(i).alias("__k"), F.col(f"b{c}").alias("__b")) for i, c in enumerate("so")))).alias("__x")).groupBy(*keys, "__x.__k", "__x.__b").agg(F.count(F.lit(1)).alias("__c"))
    own = own.withColumn("__p", F.col("__c") / F.sum("__c").over(W.partitionBy(*keys, "__k"))).groupBy(*keys, "__k").agg(_entropy(F.col("__p")).alias("__h"))
    own = own.groupBy(*keys).agg(F.abs(F.sum(F.when(F.col("__k") == 0, F.col("__h")).otherwise(-F.col("__h")))).alias("hu"))
    joined = together.join(own, list(keys)).join(omega(pairs, keys, time=time), list(keys))
    enough = F.col("n") >= 3
    out = joined.select(*keys, "MFM_omega", F.when(enough, F.exp(-F.greatest("hs", "hu"))).alias("MFM_varphi"), F.when(enough, F.col("MFM_eta")).alias("MFM_eta"))
    return out.withColumn("MFM", 1 - F.sqrt(sum(((1 - F.col(f"MFM_{x}")) * (1 - F.col(f"MFM_{x}")) for x in ("omega", "varphi", "eta")), F.lit(0.0)) / 3))


def omega_of(s: np.ndarray, o: np.ndarray) -> float | None:
    """cos(phase difference / 4) exp(-mean |s-o| / |mean o|), the phases taken at the reference's strongest frequency from the second on."""
    if len(o) < 3 or (mean := abs(o.mean())) == 0:
        return None
    shift = 0.0
    if len(o) >= 4:
        fs, fo = np.fft.rfft(s), np.fft.rfft(o)
        k = 2 + int(np.argmax(np.abs(fo[2:])))
        shift = math.remainder(np.angle(fs[k]) - np.angle(fo[k]), 2 * math.pi)
    return math.cos(shift / 4) * math.exp(-np.abs(s - o).mean() / mean)


def omega(pairs: DataFrame, keys: Sequence[str], *, time: str = "time") -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keys).schema.fields)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        return pd.DataFrame([[*key, omega_of(pdf["s"].to_numpy(), pdf["o"].to_numpy())]], columns=[*keys, "MFM_omega"])

    return pairs.select(*keys, F.col(time).alias("t"), "s", "o").groupBy(*keys).applyInPandas(run, f"{fields}, MFM_omega double")


def month_table(pairs: DataFrame, keys: Sequence[str], *, time: str = "time") -> DataFrame:
    """Per group and calendar month: counts, means and variances, from which the seasonal scores follow."""
    return pairs.groupBy(*keys, F.month(time).alias("month")).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{c}_{n}") for c in "so" for n, f in (("mean", F.avg), ("var", F.var_pop))))


def seasonal_scores(months: DataFrame, keys: Sequence[str]) -> DataFrame:
    """nPhaseScore, nIavScore and nSeasonalityScore from a month table. The first of equal peaks counts."""
    peak = lambda c: F.max(F.struct(F.col(f"{c}_mean"), -F.col("month")))["col2"] * -1
    swing = lambda c: F.max(f"{c}_mean") - F.min(f"{c}_mean")
    iav = lambda c: root(ratio(F.sum(F.col("n") * F.col(f"{c}_var")), F.sum("n")))
    got = months.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in "so" for n, f in (("peak", peak), ("swing", swing), ("iav", iav))))
    phase = F.when((F.col("swing_s") > 0) & (F.col("swing_o") > 0), (1 + F.cos((F.col("peak_s") - F.col("peak_o")) * (2 * math.pi / 12))) / 2)
    return got.select(
        *keys, phase.alias("nPhaseScore"),
        F.exp(-ratio(F.abs(F.col("iav_s") - F.col("iav_o")), F.col("iav_o"))).alias("nIavScore"),
        F.exp(-F.abs(ratio(F.col("swing_s") - F.col("swing_o"), F.col("swing_o")))).alias("nSeasonalityScore"),
    )


def spatial_score(means: DataFrame, field: Sequence[str], s: str = "s_mean", o: str = "o_mean") -> DataFrame:
    """nSpatialScore per field (variable, sim, ref), from one mean per cell."""
    r = ratio(F.covar_pop(s, o), F.stddev_pop(s) * F.stddev_pop(o))
    spread = ratio(F.stddev_pop(s), F.stddev_pop(o))
    return means.groupBy(*field).agg(ratio(2 * (1 + r), F.pow(spread + ratio(F.lit(1.0), spread), 2)).alias("nSpatialScore"))


def overall(weights: Mapping[str, float] = SCORE_WEIGHTS) -> Column:
    """The weighted mean of the scores that are there."""
    return ratio(sum((w * F.coalesce(F.col(n), F.lit(0.0)) for n, w in weights.items()), F.lit(0.0)), sum((F.when(F.col(n).isNotNull(), float(w)).otherwise(0.0) for n, w in weights.items()), F.lit(0.0)))


def scores(pairs: DataFrame, field: Sequence[str], cell: Sequence[str], *, time: str = "time") -> DataFrame:
    """All scores per field and cell, with the per-cell means of both sides.

    Means, moments about them, months and the field of means each need the pairs. So the pairs are written once, and what they come from is read once; so is the table of cells.
    """
    keys = [*field, *cell]
    pairs = spooled(pairs.select(*keys, time, "s", "o"), "pairs")
    means = moments(pairs, keys, with_mean=True)
    own = spooled(means.select(*keys, "s_mean", "o_mean", *(METRICS[n]().alias(n) for n in ("nBiasScore", "nRMSEScore", "index_agreement"))), "cells")
    joined = own.join(seasonal_scores(month_table(pairs, keys, time=time), keys), keys).join(spatial_score(own, field), list(field))
    return joined.withColumn("Overall_Score", overall())


def unpivot(wide: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(keys, name, value): one row per metric or score."""
    return wide.unpivot(list(keys), list(names), "name", "value")
