import itertools
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import tails
from tidemark.functions.quantiles import quantiles
from tidemark.operators import compare, stats
from tidemark.plans import stat_queries


def series(spark, values, keys=(1,)):
    rows = [(k, datetime(2000, 1, 1) + timedelta(days=i), None if v is None else float(v)) for k in keys for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cell int, time timestamp_ntz, value double")


def test_tails():
    assert tails.t_two_sided(-1.2649110640673518, 3.4482758620689653) == pytest.approx(0.2846272, abs=1e-6)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-7)
    assert tails.f_upper(4.0, 1, 10) == pytest.approx(tails.t_two_sided(2.0, 10), abs=1e-12)
    assert tails.normal_two_sided(1.959963985) == pytest.approx(0.05, abs=1e-9)
    perms = list(itertools.permutations(range(5)))
    inversions = [sum(a > b for a, b in itertools.combinations(p, 2)) for p in perms]
    assert tails.kendall_counts(5) == tuple(inversions.count(k) for k in range(11))
    extreme = sum(abs(10 - 2 * i) >= 8 for i in inversions) / 120
    assert tails.kendall_two_sided(8, 5) == pytest.approx(extreme)
    assert tails.kendall_two_sided(3, 3) is None


def test_mann_kendall(spark):
    got = stats.mann_kendall(series(spark, range(10)), ["cell"]).first()
    assert (got.n, got.score, got.tau, got.trend) == (10, 45, 1.0, 1.0)
    assert got.p == pytest.approx(2 / math.factorial(10)) and got.significant
    rng = np.random.default_rng(3)
    x = rng.integers(0, 5, 60)
    got = stats.mann_kendall(series(spark, x), ["cell"]).first()
    assert got.score == sum(np.sign(x[j] - x[i]) for i in range(60) for j in range(i + 1, 60))
    short = stats.mann_kendall(series(spark, [1, 2, 3]), ["cell"]).first()
    assert short.p is None and short.trend is None


def test_three_cornered_hat_of_orthogonal_columns(spark):
    base = np.linalg.qr(np.column_stack([np.ones(40), np.random.default_rng(0).normal(size=(40, 3))]))[0][:, 1:]
    x = base * np.sqrt(39) * np.array([1, 2, 3]) + 100
    df = spark.createDataFrame([(1, *map(float, r)) for r in x], "cell int, a double, b double, c double")
    got = stats.three_cornered_hat(df, ["cell"], ["a", "b", "c"]).first()
    assert [got.sd_a, got.sd_b, got.sd_c] == pytest.approx([1, 2, 3], rel=1e-6)


def test_welch_and_false_discovery(spark):
    df = spark.createDataFrame([(1, x, y) for x, y in [(1.0, 2.0), (2.0, 3.0), (3.0, 5.0)]], "cell int, x double, y double")
    assert stats.welch(df, ["cell"]).first().p == pytest.approx(0.2846272, abs=1e-6)
    p = [0.001, 0.008, 0.039, 0.041, 0.3, 0.9, None]
    tests = spark.createDataFrame([(i % 2, v) for i, v in enumerate(p)], "cell int, p double")
    got = stats.false_discovery(tests, ["cell"]).collect()
    assert {r.threshold for r in got} == {0.008}
    assert sorted(r.p for r in got if r.significant) == [0.001, 0.008]
    same = spark.createDataFrame([(1, 1.0, 1.0)] * 3, "cell int, x double, y double")
    assert [r.significant for r in stats.false_discovery(stats.welch(same, ["cell"]), ["cell"]).collect()] == [False]


def test_global_rank_is_the_rank(spark):
    df = spark.range(3000).select(F.col("id"), (F.pmod(F.xxhash64("id"), F.lit(500)) / 10).alias("p"))
    p = sorted(r.p for r in df.collect())
    got = {r.p: r["rank"] for r in stats.global_rank(df, "p", bins=17).collect()}
    assert got == {v: k for k, v in enumerate(p, 1)}


def test_quantiles_by_ranges_are_exact(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 10 != 0, F.when(F.col("id") % 3 == 1, F.lit(7.0)).otherwise(F.pmod(F.xxhash64("id"), F.lit(900)) / 7.0)).alias("v"))
    at = (0.0, 0.05, 0.25, 0.5, 0.95, 1.0)
    got = {r.g: r for r in quantiles(df, ["g"], "v", at).collect()}
    for g in range(3):
        v = np.array([r.v for r in df.filter(F.col("g") == g).collect() if r.v is not None])
        assert got[g].n == len(v) and np.allclose(got[g].q, np.quantile(v, at), rtol=1e-12)


def test_replicates_draw_with_replacement(monkeypatch):
    monkeypatch.setattr(compare, "BLOCK", 64)
    compare.drawn.cache_clear()
    n, reps = 1000, 400
    w = np.concatenate([compare.drawn(7, n, k, reps, 3) for k in range(-(-n // 64))], axis=1)
    assert w.shape == (reps, n) and (w.sum(1) == n).all()
    # of draws with replacement each count has mean 1, variance 1 - 1/n, and two counts the covariance -1/n
    assert abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.01 and abs((w.sum(0) / reps).std() - (1 / reps) ** 0.5) < 0.005
    halves = w[:, :512].sum(1)
    assert abs(halves.mean() - 512) < 4 and abs(halves.var() - n * 0.512 * 0.488) < 60
    assert (compare.drawn(7, n, 3, reps, 3) == w[:, 192:256]).all() and (compare.drawn(8, n, 3, reps, 3) != w[:, 192:256]).any()
    compare.drawn.cache_clear()


def index_of(s, o, w):
    n = w.sum()
    m = (w * o).sum() / n
    var = (w * (o - m) ** 2).sum() / (n - 1)
    return ((w * s).sum() / n - m) ** 2 / var


def test_bootstraps_match_plain_ones_from_the_same_draws(spark, monkeypatch):
    # one block here, as tasks of the session don't see the patch
    rng = np.random.default_rng(0)
    data = {c: (rng.normal(1 + c, 1, 60), rng.normal(0, 1 + c, 60)) for c in range(4)}
    rows = [("R", "A", c, 1.0 + c, datetime(2000 + t // 12, t % 12 + 1, 1), float(s[t]), float(o[t])) for c, (s, o) in data.items() for t in range(60 if c else 50)]
    df = spark.createDataFrame(rows, "ref string, sim string, cell int, w double, time timestamp_ntz, s double, o double")
    got = [compare.smpi_bootstrap(df.repartition(n), ["ref", "sim"], "cell", replicates=50).first() for n in (1, 4)]
    draws = compare.drawn(0, 60, 0, 50, 0)
    x = [sum((1.0 + c) * index_of(s[: 60 if c else 50], o[: 60 if c else 50], draws[b][: 60 if c else 50]) for c, (s, o) in data.items()) / 10 for b in range(50)]
    for r in got:
        assert (r.low, r.high) == pytest.approx(np.quantile(x, (0.05, 0.95)).tolist()) and r.low < r.value < r.high
    own = compare.smpi_stations(df.withColumnRenamed("cell", "station_id"), ["ref", "sim"], replicates=50).first()
    unit = {r.cell: r.u for r in df.select("cell", F.xxhash64(F.col("ref"), F.col("sim"), F.col("cell").cast("string"), F.lit(0)).alias("u")).distinct().collect()}
    bounds = []
    for c, (s, o) in data.items():
        n = 60 if c else 50
        draws = compare.drawn(unit[c], n, 0, 50, 0)
        bounds.append(np.quantile([index_of(s[:n], o[:n], draws[b]) for b in range(50)], (0.05, 0.95)))
    assert (own.low, own.high) == pytest.approx(np.mean(bounds, axis=0).tolist())


def test_a_long_series_is_resampled_by_blocks(spark):
    rng = np.random.default_rng(1)
    n = 3 * compare.BLOCK + 100
    s, o = rng.normal(1, 1, n), rng.normal(0, 1, n)
    df = spark.createDataFrame([("R", "A", 1, k, float(s[k]), float(o[k])) for k in range(n)], "ref string, sim string, station_id int, time int, s double, o double").repartition(5)
    got = compare.smpi_stations(df, ["ref", "sim"], replicates=20).first()
    unit = df.select(F.xxhash64(F.lit("R"), F.lit("A"), F.lit("1"), F.lit(0))).first()[0]
    draws = np.concatenate([compare.drawn(unit, n, k, 20, 0) for k in range(4)], axis=1)
    assert (got.low, got.high) == pytest.approx(np.quantile([index_of(s, o, d) for d in draws], (0.05, 0.95)).tolist())


def test_windows(spark):
    got = [r.rolling for r in stats.rolling_mean(series(spark, [1, 3, 5]), ["cell"], 2).orderBy("time").collect()]
    assert got == [None, 2.0, 4.0]
    assert [r.rolling for r in stats.rolling_mean(series(spark, [1, None, 5, 7]), ["cell"], 2).orderBy("time").collect()] == [None, None, None, 6.0]
    assert [r["diff"] for r in stats.difference(series(spark, [1, 3, 6]), ["cell"]).orderBy("time").collect()] == [2.0, 3.0]
    assert stats.autocorrelation(series(spark, [1, 2]), ["cell"]).first().autocorrelation is None


def test_pair_statistics(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 2.0, 4.0), (1, 3.0, 6.0)], "cell int, x double, y double")
    got = stats.correlation(df, ["cell"]).first()
    assert got.covariance == pytest.approx(2.0) and got.correlation == pytest.approx(1.0)
    flat = spark.createDataFrame([(1, 5.0, 5.0)] * 4, "cell int, x double, y double")
    assert stats.hellinger(flat, ["cell"]).first().hellinger == pytest.approx(0.0)
    apart = spark.createDataFrame([(1, 0.0, 1.0)] * 4, "cell int, x double, y double")
    assert stats.hellinger(apart, ["cell"]).first().hellinger == pytest.approx(1.0)
    zero = spark.createDataFrame([(1, v, float(u)) for u, v in enumerate([-1.0, 1.0, -1.0, 1.0])], "cell int, v double, u double")
    assert stats.functional_response(zero, ["cell"], bins=2).first().functional_response is None


def test_regressions(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=80), rng.normal(size=80)
    y = 2 * a - b + rng.normal(0, 0.1, 80)
    rows = [(1, datetime(2000, 1, 1) + timedelta(days=i), float(y[i]), float(a[i]), float(b[i])) for i in range(80)]
    df = spark.createDataFrame(rows, "cell int, time timestamp_ntz, y double, a double, b double")
    pls = {r.predictor: r for r in stats.partial_least_squares(df, ["cell"], "y", ["a", "b"]).collect()}
    assert pls["a"].anomaly == pytest.approx(2, abs=0.1) and pls["b"].anomaly == pytest.approx(-1, abs=0.1) and pls["a"].r2 > 0.99
    one = stats.anova_one_way(df, ["cell"], "y", ["a", "b"]).first()
    assert one.predictor == "a" and one.p < 1e-6
    two = {r.term: r for r in stats.anova_two_way(df, ["cell"], "y", ["a", "b"]).collect()}
    assert set(two) == {"a", "b", "a:b", "residual"} and two["a"].p < 1e-6 and two["residual"].p is None


def test_regression_of_parts_by_degrees_of_freedom(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(40, 2))
    y = x @ [1.5, -0.5] + rng.normal(0, 0.3, 40)
    k, b, _, p, r2 = stats._pls_of(y, x, 1, 5)
    u, v = (x - x.mean(0)) / x.std(0), (y - y.mean()) / y.std()
    w = u.T @ v / np.linalg.norm(u.T @ v)
    t = u @ w
    plain = w * (t @ v) / (t @ t)
    left = v - u @ plain
    spread = np.sqrt(np.diag(np.linalg.inv(u.T @ u)) * (left @ left) / (40 - 1 - 1))
    assert k == 1 and b == pytest.approx(plain) and p == pytest.approx([tails.t_two_sided(c / s, 38) for c, s in zip(plain, spread, strict=True)]) and r2 == pytest.approx(1 - left @ left / 40)
    rows = [(c, i, float(y[i]), float(x[i, 0]), 2.0 if c == 1 else float(x[i, 1])) for c, n in ((0, 40), (1, 40), (2, 3)) for i in range(n)]
    got = stats.partial_least_squares(spark.createDataFrame(rows, "cell int, time int, y double, a double, b double"), ["cell"], "y", ["a", "b"]).collect()
    assert all(r.coefficient is None and r.components is None and r.p is None for r in got if r.cell == 1) and sum(r.cell == 1 for r in got) == 2
    assert all(r.coefficient is not None for r in got if r.cell != 1)


def counted(spark, df, column):
    """df and an accumulator of how often a value of the column was computed."""
    seen = spark.sparkContext.accumulator(0)

    def touch(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(touch, "double").asNondeterministic()(column)), seen


def test_kendall_takes_score_and_ties_from_one_reading(spark):
    x = [1, 1, 2, 3, 3, 3, 2, 5]
    df, seen = counted(spark, series(spark, x), "value")
    got = stats.mann_kendall(df, ["cell"]).collect()
    score = sum(np.sign(b - a) for a, b in itertools.combinations(x, 2))
    assert seen.value == 8 and got[0].tau == pytest.approx(score / np.sqrt(28 * 23))


def test_false_discovery_compares_p_with_itself(spark):
    tests = spark.createDataFrame([(i % 3, i / 1000) for i in range(1, 31)], "cell int, p double")
    df, seen = counted(spark, tests, "p")
    got = stats.false_discovery(df, ["cell"]).collect()
    assert seen.value == 30 and all(r.significant and r.threshold == 0.03 for r in got)


def test_anova_compares_quartiles_with_the_same_values(spark):
    rows = [(c, float((7 * i + c) % 9), float(i)) for c in range(3) for i in range(9)]
    df, seen = counted(spark, spark.createDataFrame(rows, "cell int, y double, x double"), "x")
    assert len(stats.anova_one_way(df, ["cell"], "y", ["x"]).collect()) == 3 and seen.value == 27


def test_kendall_of_equal_values_is_as_in_its_sql(spark, tmp_path):
    """One cell rises in steps, the other stays within one step, where the SQL divides 0 by 0."""
    duckdb = pytest.importorskip("duckdb")
    items = [(s, datetime(2000 + m // 12, 1 + m % 12, 5), price, 0.0, 0.0) for m in range(60) for s, price in ((1, 30_000.0 + 150 * m), (2, 30_000.0 + m))]
    spark.createDataFrame(items, "l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 0), (2, 1)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    db = duckdb.connect()
    for t in ("lineitem", "supplier"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(map(str, db.execute(stat_queries.SQL["st10_mann_kendall_ties"]).fetchall()))
    got = stat_queries.QUERIES["st10_mann_kendall_ties"](spark, str(tmp_path)).collect()
    assert sorted(str(tuple(r)) for r in got) == want and len(want) == 8
    assert all(math.isnan(r.tau) and math.isnan(r.p) and r.significant is False for r in got if r.cell == 1)
