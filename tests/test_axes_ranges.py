"""Masks with axes, percentiles by brackets, positions and strides, against plain versions."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import positions as places
from tidemark.functions import quantiles as selection
from tidemark.operators import compare, pairing, skill
from tidemark.sources import tables

SERIES = "variable string, source string, cell int, time int, value double"


def masked(spark, sims, refs, **options):
    rows = lambda x: spark.createDataFrame([("v", *r) for r in x], SERIES)
    got = pairing.unified_mask(rows(sims), rows(refs), **options).collect()
    return sorted((r.cell, r.time) for r in got)


def test_a_short_sim_does_not_cut_the_others(spark):
    refs = [("R", 0, t, 1.0) for t in (1, 2)]
    assert masked(spark, [("A", 0, 1, 1.0), ("A", 0, 2, 1.0), ("B", 0, 1, 1.0)], refs) == [(0, 1), (0, 2)]
    # a missing value on the sim's axis counts, and so does a cell that the sim lacks at a time it has
    assert masked(spark, [("A", 0, 1, 1.0), ("A", 0, 2, None), ("B", 0, 1, 1.0)], refs) == [(0, 1)]
    assert masked(spark, [("A", 0, 1, 1.0), ("A", 1, 2, 5.0)], refs) == [(0, 1)]
    assert masked(spark, [("A", 0, 1, float("nan"))], refs) == [(0, 2)]
    assert masked(spark, [], refs) == [(0, 1), (0, 2)]


def test_strict_masks_and_sims_out_of_time_refuse(spark):
    refs = [("R", 0, t, 1.0) for t in (1, 2)]
    whole, short, apart = [("A", 0, 1, 1.0), ("A", 0, 2, 1.0)], [("B", 0, 1, 1.0)], [("C", 0, 7, 1.0)]
    assert masked(spark, whole, refs, strict=True) == [(0, 1), (0, 2)]
    with pytest.raises(PySparkException, match="B another length"):
        masked(spark, whole + short, refs, strict=True)
    with pytest.raises(PySparkException, match="C no time in common"):
        masked(spark, whole + apart, refs)


def groups(rng):
    return {
        "normal": rng.normal(size=9000), "tied below": np.concatenate([np.zeros(5000), rng.normal(5, 1, 4000)]), "tied above": np.concatenate([np.full(7000, 9.0), rng.normal(size=3000)]),
        "one value": np.full(9000, 3.0), "few": rng.normal(size=7), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "coarse": rng.integers(0, 6, 12_000).astype(float),
        "far": np.concatenate([rng.normal(size=5000), [-1e300, 1e300]]), "cut by ties": np.concatenate([np.full(450, 1.0), np.full(100, 2.0), rng.uniform(3, 4, 9450)]),
    }


@pytest.mark.parametrize("small", [8_000, 20_000])
def test_quantiles_and_clipped_medians_are_exact(spark, monkeypatch, small):
    monkeypatch.setattr(selection, "SMALL", small)
    known = groups(np.random.default_rng(4))
    df = spark.createDataFrame([(g, float(v)) for g, x in known.items() for v in x] + [("normal", None), ("nothing", None)], "g string, v double").repartition(7)
    at = (0.0, 0.05, 0.37, 0.5, 0.95, 1.0)
    got = {r.g: r for r in selection.quantiles(df, ["g"], "v", at).collect()}
    middle = {r.g: r for r in selection.clipped_median(df, ["g"], "v").collect()}
    assert set(got) == set(middle) == set(known)
    for g, x in known.items():
        assert got[g].n == len(x) and got[g].q == pytest.approx(np.quantile(x, at).tolist(), rel=1e-12), g
        lo, hi = np.quantile(x, (0.05, 0.95))
        kept = x[(x >= lo) & (x <= hi)]
        assert (middle[g].kept, middle[g].low, middle[g].high) == (len(kept), pytest.approx(lo), pytest.approx(hi)), g
        assert middle[g].median == (pytest.approx(np.median(kept)) if len(kept) else None), g
    whole = {r.g: r for r in selection.clipped_median(df, ["g"], "v", least=10).collect()}
    assert whole["few"].median == pytest.approx(np.median(known["few"])) and whole["few"].kept == 7


def test_little_is_shuffled_for_quantiles_of_a_long_group(spark):
    df = spark.range(400_000).select(F.lit(1).alias("g"), F.rand(3).alias("v"))
    rows = selection._rows(df, ["g"], "v")
    at = [p + s for p in (0.05, 0.5) for s in (-selection.REACH, selection.REACH)]
    counted = selection._counted(rows, selection._sketched(rows, ["g"], at), ["g"], F.array(selection._bracket(0, 1), selection._bracket(2, 3)))
    assert counted.count() < 400_000 * 4 * 2 * selection.REACH
    assert counted.agg(F.max("__to")).first()[0] == 400_000


@pytest.mark.parametrize("limit", [0, 1, 7, 100, 999, 1000, 5000])
def test_strides(spark, limit):
    rng = np.random.default_rng(limit)
    known = {"a": rng.permutation(1000), "b": rng.permutation(64), "c": np.array([5])}
    df = spark.createDataFrame([(g, int(x), float(x) / 3, "position") for g, v in known.items() for x in v], "g string, t int, v double, n string")
    got = places.stride_sample(df, ["g"], ["t"], limit, range_rows=16).collect()
    for g, v in known.items():
        order = np.sort(v)
        want = order if limit <= 0 or len(order) <= limit else order[:: max(1, len(order) // limit)][:limit]
        assert sorted(r.t for r in got if r.g == g) == want.tolist()
    assert got[0].asDict().keys() == {"g", "t", "v", "n"}


def test_positions_with_ties_nulls_and_times(spark):
    df = spark.createDataFrame([(k % 5 if k % 7 else None, k) for k in range(300)], "x int, id int").withColumn("t", F.timestamp_seconds(F.col("x")))
    for by in (["x", "id"], ["t", "id"]):
        got = {r.id: r.position for r in places.positions(df, [], by, range_rows=10).collect()}
        want = sorted(range(300), key=lambda k: (-1 if k % 7 == 0 else k % 5, k))
        assert [got[k] for k in want] == list(range(300))


def test_densities_of_large_groups_are_near_the_direct_sums(spark):
    rng = np.random.default_rng(8)
    known = {"large": np.concatenate([rng.normal(0, 1, 6000), rng.normal(6, 0.3, 3000)]), "small": rng.normal(size=50)}
    df = spark.createDataFrame([(g, float(v), 3) for g, x in known.items() for v in x] + [("large", None, 1), ("flat", 2.0, 1), ("flat", 2.0, 1)], "g string, v double, n int").repartition(5)
    got = compare.density(df, ["g"], points=40, value="v").collect()
    assert {r.g for r in got} == {"large", "small"}
    for g, v in known.items():
        h = v.std(ddof=1) * len(v) ** -0.2
        at = np.linspace(v.min(), v.max(), 40)
        want = np.exp(-(((at[:, None] - v) / h) ** 2) / 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))
        mine = [d for _, d in sorted((r.x, r.density) for r in got if r.g == g)]
        bound = (((v.max() - v.min()) / (compare.BINS - 1)) / h) ** 2 / 8 / (h * np.sqrt(2 * np.pi)) if g == "large" else 1e-12
        assert np.abs(np.array(mine) - want).max() <= bound


def test_bucketed_tables_are_paired_without_an_exchange(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [("v", s, c, t, float(c * t)) for s in ("R", "A", "B") for c in range(9) for t in range(20)]
        df = spark.createDataFrame(rows, SERIES)
        on = ["variable", "cell", "time"]
        sims, refs = (tables.bucketed(df.filter(w), n, f"file://{tmp_path}/{n}", on, 4) for w, n in (("source <> 'R'", "paired_sims"), ("source = 'R'", "paired_refs")))
        got = pairing.pair(sims, refs, on)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert got.count() == 2 * 9 * 20 and got.filter("s <> o").count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS paired_sims")
        spark.sql("DROP TABLE IF EXISTS paired_refs")


def test_scores_read_their_source_once(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [("R", "A", c, f"{2000 + t // 12}-{t % 12 + 1:02d}-01", float(rng.normal()), float(rng.normal())) for c in range(3) for t in range(36)]
    spark.createDataFrame(rows, "ref string, sim string, cell int, time string, s double, o double").withColumn("time", F.to_date("time")).write.parquet(f"{tmp_path}/source")
    got = skill.scores(spark.read.parquet(f"{tmp_path}/source"), ["ref", "sim"], ["cell"])
    assert f"{tmp_path}/source" not in got._jdf.queryExecution().optimizedPlan().toString() + got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 3 and got.filter("Overall_Score IS NULL").count() == 0
