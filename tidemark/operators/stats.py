"""Statistics of series x (or pairs x, y) per group of keys."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.guards import histogram_bin, ratio, root
from ..sources.scratch import spooled


def fields(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema.fields)


def basic(df: DataFrame, keys: Sequence[str], x: str = "value") -> DataFrame:
    """Mean, median, max, min, sum (0 for nothing), standard deviation and variance (ddof 1)."""
    return df.groupBy(*keys).agg(F.avg(x).alias("mean"), F.median(x).alias("median"), F.max(x).alias("max"), F.min(x).alias("min"), F.coalesce(F.sum(x), F.lit(0.0)).alias("sum"), F.stddev_samp(x).alias("sd"), F.var_samp(x).alias("var"))


def z_score(df: DataFrame, keys: Sequence[str], x: str = "value") -> DataFrame:
    """(x - mean) / sd (ddof 0) as z, NULL where sd < 1e-10."""
    w = W.partitionBy(*keys)
    sd = F.stddev_pop(x).over(w)
    return df.withColumn("z", F.when(sd >= 1e-10, (F.col(x) - F.avg(x).over(w)) / sd))


def correlation(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.groupBy(*keys).agg(ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("correlation"), F.covar_samp(x, y).alias("covariance"))


def autocorrelation(df: DataFrame, keys: Sequence[str], x: str = "value", time: str = "time") -> DataFrame:
    """Correlation with the next step; NULL under 3 samples."""
    nxt = F.lead(x).over(W.partitionBy(*keys).orderBy(time))
    got = df.select(*keys, F.col(x).alias("x"), nxt.alias("y"))
    n = got.groupBy(*keys).agg(F.count("x").alias("n"))
    return n.join(correlation(got, keys), list(keys), "left").select(*keys, F.when(F.col("n") >= 3, F.col("correlation")).alias("autocorrelation"))


def hellinger(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", bins: int = 20) -> DataFrame:
    """sqrt(1 - sum sqrt(p q)) over bins of the common range; 0 if both are one constant, NULL under 2 values."""
    w = W.partitionBy(*keys)
    lo, hi = F.least(F.min(x).over(w), F.min(y).over(w)), F.greatest(F.max(x).over(w), F.max(y).over(w))
    ranged = df.withColumns({"__lo": lo, "__hi": hi, "__n": F.count(F.lit(1)).over(w)})
    both = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), histogram_bin(F.col(c), F.col("__lo"), F.col("__hi"), bins).alias("b")) for i, c in enumerate((x, y)))))
    counts = ranged.select(*keys, "__n", both.alias("v")).groupBy(*keys, "__n", "v.b").agg(F.sum(1 - F.col("v.i")).alias("p"), F.sum("v.i").alias("q"))
    overlap = F.sum(F.sqrt(F.col("p").cast("double") * F.col("q")) / F.col("__n"))
    return counts.groupBy(*keys).agg(F.when(F.max("__n") >= 2, root(1 - overlap)).alias("hellinger"))


def functional_response(df: DataFrame, keys: Sequence[str], v: str = "v", u: str = "u", bins: int = 25) -> DataFrame:
    """exp(-RMSE(v, mean of its u bin) / |mean v|). Bins of u are closed on the right, so the smallest u lies in none."""
    w = W.partitionBy(*keys)
    lo, hi = F.min(u).over(w), F.max(u).over(w)
    binned = df.withColumns({"__lo": lo, "__hi": hi}).withColumn("__b", F.ceil(ratio((F.col(u) - F.col("__lo")) * bins, F.col("__hi") - F.col("__lo"))))
    off = F.col(v) - F.avg(v).over(W.partitionBy(*keys, "__b"))
    got = binned.withColumn("__sq", F.when(F.col("__b") > 0, off * off)).groupBy(*keys).agg(F.avg("__sq").alias("sq"), F.avg(v).alias("mean"), F.count(F.lit(1)).alias("n"))
    return got.select(*keys, F.when((F.col("n") >= 2) & (F.abs("mean") >= 1e-12), F.exp(-ratio(F.sqrt("sq"), F.abs("mean")))).alias("functional_response"))


def _kendall_of(x: np.ndarray) -> tuple[int, int, float, float]:
    """(score, n, tie term, tied pairs) of a series: pairs that rise less those that fall, counted by merging in n log n."""
    n = len(x)
    _, counts = np.unique(x, return_counts=True)
    ties, tied = (counts * (counts - 1) * (2 * counts + 5)).sum(), (counts * (counts - 1) / 2).sum()
    ranks, score = np.unique(x, return_inverse=True)[1], 0
    parts = [ranks[i : i + 1] for i in range(n)]
    while len(parts) > 1:
        merged = []
        for a, b in zip(parts[::2], parts[1::2], strict=False):
            score += int(np.searchsorted(a, b, "left").sum() - (len(a) * len(b) - np.searchsorted(a, b, "right").sum()))
            merged.append(np.sort(np.concatenate([a, b]), kind="stable"))
        parts = merged + (parts[-1:] if len(parts) % 2 else [])
    return score, n, float(ties), float(tied)


def mann_kendall(df: DataFrame, keys: Sequence[str], x: str = "value", time: str = "time", alpha: float = 0.05) -> DataFrame:
    """Kendall's tau against time: n, score, tau, trend (its sign), p, significant. Under 4 values all but n and score are NULL.

    A series is ordered and scored by merging, n log n, in one task per group. Its ties come from the same values: a
    second run of the lineage may sum up in another order, and values at the edge of a step would differ.
    """
    kept = df.filter(F.col(x).isNotNull()).select(*keys, F.col(time).alias("__t"), F.col(x).cast("double").alias("__x"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        score, n, ties, tied = _kendall_of(pdf.sort_values("__t", kind="stable")["__x"].to_numpy())
        return pd.DataFrame([[*key, n, score, ties, tied]], columns=[*keys, "n", "score", "ties", "tied"])

    scored = kept.groupBy(*keys).applyInPandas(run, f"{fields(df, keys)}, n long, score long, ties double, tied double")
    pairs = scored.withColumn("all", F.col("n") * (F.col("n") - 1) / 2)
    # tau-b: ties of x alone, as time has none
    return pairs.withColumn("p", tails.p_kendall(F.col("score"), F.col("n"), F.col("ties"))).select(
        *keys, "n", "score", F.when(F.col("n") >= 4, ratio(F.col("score"), F.sqrt(F.col("all") * (F.col("all") - F.col("tied"))))).alias("tau"),
        F.when(F.col("n") >= 4, F.signum(F.col("score").cast("double"))).alias("trend"), "p", (F.col("p") < alpha).alias("significant"),
    )


def three_cornered_hat(wide: DataFrame, keys: Sequence[str], sources: Sequence[str]) -> DataFrame:
    """Error standard deviations of three or more sources, sd_<source> and relative_<source> (percent of mean |x|).

    d_ij are variances of differences over rows complete in all. With S_i the sum over j and T that of all pairs,
    v_i = (S_i - T / (N-1)) / (N-2). All NULL under 3 rows or where a variance is clearly negative.
    """
    n = len(sources)
    if n < 3:
        raise ValueError("three sources at least")
    whole = wide.dropna(subset=list(sources))
    pairs = list(combinations(range(n), 2))
    got = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.var_samp(F.col(sources[i]) - F.col(sources[j])).alias(f"d{i}_{j}") for i, j in pairs), *(F.avg(F.abs(s)).alias(f"m_{s}") for s in sources))
    total = sum((F.col(f"d{i}_{j}") for i, j in pairs), F.lit(0.0))
    top = F.greatest(*(F.col(f"d{i}_{j}") for i, j in pairs))
    for k, s in enumerate(sources):
        own = sum((F.col(f"d{i}_{j}") for i, j in pairs if k in (i, j)), F.lit(0.0))
        got = got.withColumn(f"v_{s}", (own - total / (n - 1)) / (n - 2))
    fine = (F.col("n") >= 3) & (F.least(*(F.col(f"v_{s}") for s in sources)) >= -F.greatest(F.lit(1e-12), 1e-10 * top))
    scaled = fine & (F.least(*(F.col(f"m_{s}") for s in sources)) >= 1e-10)
    return got.select(*keys, *(F.when(fine, root(F.col(f"v_{s}"))).alias(f"sd_{s}") for s in sources), *(F.when(scaled, 100 * ratio(root(F.col(f"v_{s}")), F.col(f"m_{s}"))).alias(f"relative_{s}") for s in sources))


def welch(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """(n, t, df, p) of the difference of means over rows valid in both."""
    got = df.dropna(subset=[x, y]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{k}{i}") for i, c in enumerate((x, y)) for k, f in (("m", F.avg), ("v", F.var_samp))))
    a, b = F.col("v0") / F.col("n"), F.col("v1") / F.col("n")
    freedom = ratio((a + b) * (a + b) * (F.col("n") - 1), a * a + b * b)
    return got.select(*keys, "n", ratio(F.col("m0") - F.col("m1"), F.sqrt(a + b)).alias("t"), freedom.alias("df")).withColumn("p", tails.p_t(F.col("t"), F.col("df")))


def global_rank(df: DataFrame, by: str, bins: int = 200) -> DataFrame:
    """(by, rank): each value with the number of rows that have it or a smaller one, computed by ranges and never in one task.

    Equal values are one row from the first aggregate on. The range bounds are quantiles of them; what lies before
    a range is added up over the ranges' counts.
    """
    values = df.groupBy(by).agg(F.count(F.lit(1)).alias("__c"))
    cuts = values.agg(F.percentile_approx(by, F.array(*(F.lit(k / bins) for k in range(1, bins))), 10_000)).first()[0] or []
    bounds = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    ranged = values.withColumn("__r", F.size(F.filter(bounds, lambda c: c < F.col(by))))
    before = ranged.groupBy("__r").agg(F.sum("__c").alias("__s")).select("__r", (F.sum("__s").over(W.orderBy("__r")) - F.col("__s")).alias("__before"))
    own = F.sum("__c").over(W.partitionBy("__r").orderBy(by))
    return ranged.withColumn("__own", own).join(F.broadcast(before), "__r").select(by, (F.col("__own") + F.col("__before")).alias("rank"))


def false_discovery(tests: DataFrame, keys: Sequence[str], p: str = "p", alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg over all rows together: threshold, significant and, per keys, the share of significant tests.

    The tests are written once: the threshold is one of their p, and a second run of sums in another order would miss it by a digit.
    """
    tests = spooled(tests, "tests")
    valid = tests.filter(F.col(p).isNotNull())
    n = valid.count()
    passed = global_rank(valid, p).filter(F.col(p) <= F.col("rank") * (alpha / max(1, n)))
    threshold = passed.agg(F.coalesce(F.max(p), F.lit(0.0)).alias("threshold"))
    marked = tests.crossJoin(F.broadcast(threshold)).withColumn("significant", F.coalesce((F.col(p) <= F.col("threshold")) & (F.col("threshold") > 0), F.lit(False)))
    return marked.withColumn("proportion", F.avg(F.col("significant").cast("int")).over(W.partitionBy(*keys)))


def anova_one_way(df: DataFrame, keys: Sequence[str], y: str, predictors: Sequence[str]) -> DataFrame:
    """The smallest p of one-way analyses of y by quartile groups of each predictor, times their number: predictor, f, p.

    The rows are written once: a quartile may be one of the values, and a second run of sums in another order would put that one into the next group.
    """
    long = spooled(df.select(*keys, y, *predictors), "series").unpivot([*keys, y], list(predictors), "predictor", "x").filter(F.col("x").isNotNull() & F.col(y).isNotNull())
    by = [*keys, "predictor"]
    q = long.groupBy(*by).agg(F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    part = F.when(F.col("x") <= F.col("q")[0], 0).when(F.col("x") <= F.col("q")[1], 1).when(F.col("x") <= F.col("q")[2], 2).otherwise(3)
    groups = long.join(q, by).groupBy(*by, part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v")).filter("n >= 2")
    mean = F.sum(F.col("n") * F.col("m")).over(W.partitionBy(*by)) / F.sum("n").over(W.partitionBy(*by))
    sums = groups.withColumn("g", mean).groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within")).filter("k >= 2")
    f = sums.select(*by, (F.col("k") - 1).alias("d1"), (F.col("n") - F.col("k")).alias("d2"), ratio(F.col("between") / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f"))
    tested = f.withColumn("p", tails.p_f(F.col("f"), F.col("d1"), F.col("d2"))).filter("p IS NOT NULL")
    best = tested.groupBy(*keys).agg(F.min(F.struct("p", "predictor", "f")).alias("b"), F.count(F.lit(1)).alias("tests"))
    return best.select(*keys, F.col("b.predictor").alias("predictor"), F.col("b.f").alias("f"), F.least(F.lit(1.0), F.col("b.p") * F.col("tests")).alias("p"))


def _two_way_of(y: np.ndarray, x: np.ndarray, names: Sequence[str]) -> list[tuple]:
    """Type-II sums of squares of main effects and pairwise interactions, and of the residual."""
    scale = lambda a: (a - a.min(0)) / np.where(np.ptp(a, axis=0) > 0, np.ptp(a, axis=0), 1)
    x, y = scale(x), scale(y)
    terms = [(i,) for i in range(len(names))] + list(combinations(range(len(names)), 2))
    column = {t: np.prod(x[:, t], axis=1) for t in terms}

    def rss(used) -> float:
        a = np.column_stack([np.ones(len(y)), *(column[t] for t in used)])
        return float(((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2).sum())

    full, df = rss(terms), len(y) - len(terms) - 1
    if df < 1:
        return []
    out = []
    for t in terms:
        others = [u for u in terms if u != t and not set(t) < set(u)]
        ss = max(0.0, rss(others) - rss([*others, t]))
        f = ss / (full / df) if full > 0 else float("nan")
        out.append((":".join(names[i] for i in t), ss, f, tails.f_upper(f, 1, df) if f == f else float("nan")))
    return [*out, ("residual", full, float("nan"), float("nan"))]


def anova_two_way(df: DataFrame, keys: Sequence[str], y: str, predictors: Sequence[str]) -> DataFrame:
    """(term, sum_sq, f, p) per group, by least squares on the group in one task."""
    whole = df.select(*keys, y, *predictors).dropna()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _two_way_of(pdf[y].to_numpy(float), pdf[list(predictors)].to_numpy(float), predictors)
        return pd.DataFrame([[*key, *r] for r in rows], columns=[*keys, "term", "sum_sq", "f", "p"])

    got = whole.groupBy(*keys).applyInPandas(run, f"{fields(df, keys)}, term string, sum_sq double, f double, p double")
    return got.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("f", "p")})


def pls1(x: np.ndarray, y: np.ndarray, components: int) -> np.ndarray:
    """Coefficients of a partial least squares regression on standardised columns (NIPALS)."""
    x, y = x.copy(), y.copy()
    w, p, q = [], [], []
    for _ in range(components):
        a = x.T @ y
        if (norm := np.linalg.norm(a)) < 1e-12:
            break
        a /= norm
        t = x @ a
        tt = t @ t
        w.append(a)
        p.append(x.T @ t / tt)
        q.append(y @ t / tt)
        x, y = x - np.outer(t, p[-1]), y - t * q[-1]
    if not w:
        return np.zeros(x.shape[1])
    w, p = np.array(w).T, np.array(p).T
    return w @ np.linalg.solve(p.T @ w, np.array(q))


def _pls_of(y: np.ndarray, x: np.ndarray, most: int, folds: int) -> tuple[int, np.ndarray, float, np.ndarray, float] | None:
    """(components, coefficients, intercept, p, R2); the number of components has the best score over folds forward in time.

    None for a constant predictor or series, and where values less components less 1 leave no degree of freedom.
    """
    sx, sy = x.std(0, ddof=0), y.std()
    if not (sx > 0).all() or not sy > 0:
        return None
    u, v = (x - x.mean(0)) / sx, (y - y.mean()) / sy
    n, size = len(y), len(y) // (folds + 1)

    def score(k: int) -> float:
        got = []
        for f in range(1, folds + 1):
            train, test = slice(0, n - (folds + 1 - f) * size), slice(n - (folds + 1 - f) * size, n - (folds - f) * size)
            mu, mv = u[train].mean(0), v[train].mean()
            guess = (u[test] - mu) @ pls1(u[train] - mu, v[train] - mv, k) + mv
            rest = ((v[test] - v[test].mean()) ** 2).sum()
            got.append(1 - ((v[test] - guess) ** 2).sum() / rest if rest > 0 else 0.0)
        return float(np.mean(got))

    best = max(range(1, min(most, x.shape[1]) + 1), key=score) if size >= 2 else 1
    b = pls1(u, v, best)
    left = v - u @ b
    rest, freedom = float((v**2).sum()), n - best - 1
    if freedom < 1:
        return None
    spread = np.sqrt(np.maximum(0, np.diag(np.linalg.pinv(u.T @ u)) * (left @ left) / freedom))
    p = np.array([tails.t_two_sided(c / s, freedom) if s > 0 else np.nan for c, s in zip(b, spread, strict=True)])
    return best, b, float(y.mean()), p, 1 - float(left @ left) / rest if rest > 0 else np.nan


def partial_least_squares(df: DataFrame, keys: Sequence[str], y: str, predictors: Sequence[str], *, time: str = "time", most: int = 10, folds: int = 5) -> DataFrame:
    """(predictor, components, coefficient, intercept, p, r2, anomaly) per group: standardised PLS1, on the group in one task; all NULL where a predictor is constant or too few values are left."""
    whole = df.select(*keys, F.col(time).alias("__t"), y, *predictors).dropna()
    columns = [*keys, "predictor", "components", "coefficient", "intercept", "p", "r2", "anomaly"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__t")
        x, v = pdf[list(predictors)].to_numpy(float), pdf[y].to_numpy(float)
        if len(v) < 3:
            return pd.DataFrame(columns=columns)
        if (found := _pls_of(v, x, most, folds)) is None:
            return pd.DataFrame([[*key, name, *[None] * 6] for name in predictors], columns=columns)
        k, b, mean, p, r2 = found
        sx = x.std(0)
        return pd.DataFrame([[*key, name, k, b[i], mean, p[i], r2, b[i] * v.std() / sx[i] if sx[i] > 0 else np.nan] for i, name in enumerate(predictors)], columns=columns)

    return whole.groupBy(*keys).applyInPandas(run, f"{fields(df, keys)}, predictor string, components int, coefficient double, intercept double, p double, r2 double, anomaly double")


def rolling_mean(df: DataFrame, keys: Sequence[str], size: int, x: str = "value", time: str = "time") -> DataFrame:
    """The mean of the last size values, NULL until there are so many, or if one is missing."""
    w = W.partitionBy(*keys).orderBy(time).rowsBetween(1 - size, 0)
    return df.withColumn("rolling", F.when(F.count(x).over(w) == size, F.avg(x).over(w)))


def difference(df: DataFrame, keys: Sequence[str], x: str = "value", time: str = "time") -> DataFrame:
    """x less the value before; each group's first row goes."""
    w = W.partitionBy(*keys).orderBy(time)
    return df.withColumns({"diff": F.col(x) - F.lag(x).over(w), "__n": F.row_number().over(w)}).filter("__n > 1").drop("__n")
