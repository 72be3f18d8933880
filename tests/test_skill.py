"""Small series with known answers."""

import math
from datetime import datetime

import numpy as np
import pytest

from tidemark.operators import skill

NULL = None


def pairs(spark, s, o, start=(2000, 1)):
    rows = []
    for k, (x, y) in enumerate(zip(s, o, strict=True)):
        month = start[1] - 1 + k
        if x is not None and y is not None:
            rows.append((1, datetime(start[0] + month // 12, month % 12 + 1, 1), float(x), float(y)))
    return spark.createDataFrame(rows, "k int, time timestamp_ntz, s double, o double")


@pytest.mark.parametrize(
    ("name", "s", "o", "want"),
    [
        ("bias", [1.5, 2.5, 3.5, 4.5, 5.5], [1, 2, 3, 4, 5], 0.5),
        ("RMSE", [2, 3, 4], [1, 2, 3], 1.0),
        ("correlation", [2, 4, 6, 8, 10], [1, 2, 3, 4, 5], 1.0),
        ("correlation", [10, 8, 6, 4, 2], [1, 2, 3, 4, 5], -1.0),
        ("correlation", [1, 2, 3], [5, 5, 5], NULL),
        ("NSE", [1, 2, 3], [5, 5, 5], NULL),
        ("pc_max", [1, NULL, 3], [1, 2, 4], -0.25),
        ("pc_min", [1, NULL, 3], [1, 2, 4], 0.0),
        ("pc_ampli", [1, NULL, 3], [1, 2, 4], -1 / 3),
        ("pc_max", [-3, -1], [-4, -2], 0.5),
        ("absolute_percent_bias", [-1, -2], [-2, -3], 40.0),
        ("percent_bias", [1, 2], [-1, 1], NULL),
        ("nBiasScore", [2, NULL, 4], [1, 2, 3], math.exp(-1)),
        ("KGE", [1, 2, 3], [1, 2, 3], 1.0),
        ("L", [1, 2, 3], [1, 2, 3], 1.0),
        ("dr", [1, 2, 3], [1, 2, 3], 1.0),
        ("dr", [9, 9, 9], [1, 2, 3], 4 / 21 - 1),
        ("index_agreement", [1, 2, 3], [1, 2, 3], 1.0),
        ("CRMSD", [1, 2, 4], [1, 2, 4], 0.0),
    ],
)
def test_metrics_with_known_answers(spark, name, s, o, want):
    got = skill.metrics(pairs(spark, s, o), ["k"], [name]).first()[name]
    assert got == (pytest.approx(want, abs=1e-9) if want is not None else None)


def test_all_moment_metrics_match_numpy(spark):
    rng = np.random.default_rng(0)
    o = rng.gamma(2, 3, 60)
    s = o * 1.1 + rng.normal(0, 1, 60)
    got = skill.metrics(pairs(spark, s, o), ["k"], list(skill.METRICS)).first()
    r = np.corrcoef(s, o)[0, 1]
    kge = 1 - math.sqrt((r - 1) ** 2 + (s.std() / o.std() - 1) ** 2 + (s.mean() / o.mean() - 1) ** 2)
    slope = np.polyfit(o, s, 1)[0]
    want = {
        "mean_absolute_error": np.abs(s - o).mean(), "ubRMSE": (s - o).std(), "NSE": 1 - ((s - o) ** 2).sum() / ((o - o.mean()) ** 2).sum(), "KGE": kge, "KGESS": (kge + 0.41) / 1.41,
        "rv": s.std() / o.std() - 1, "br2": r * r * abs(slope) if abs(slope) <= 1 else r * r / abs(slope), "smpi": (s.mean() - o.mean()) ** 2 / o.var(ddof=1),
        "ubNSE": 1 - (((s - s.mean()) - (o - o.mean())) ** 2).sum() / ((o - o.mean()) ** 2).sum(), "correlation_R2": r * r,
    }
    for name, value in want.items():
        assert got[name] == pytest.approx(value, rel=1e-9), name


def test_seasonal_scores(spark):
    o, s = [1, 3] * 12, [1, 5] * 12
    got = skill.seasonal_scores(skill.month_table(pairs(spark, s, o), ["k"]), ["k"]).first()
    assert got.nSeasonalityScore == pytest.approx(math.exp(-1))
    assert got.nPhaseScore == pytest.approx(1.0)
    flat = skill.seasonal_scores(skill.month_table(pairs(spark, [2] * 24, [2] * 24), ["k"]), ["k"]).first()
    assert flat.nPhaseScore is None


def test_mfm_matches_numpy(spark):
    rng = np.random.default_rng(1)
    o = 5 + np.sin(np.arange(48) * math.pi / 6) + rng.normal(0, 0.2, 48)
    s = 5 + np.sin((np.arange(48) - 1) * math.pi / 6)
    got = skill.mfm(pairs(spark, s, o), ["k"]).first()
    edges = np.linspace(min(s.min(), o.min()), max(s.max(), o.max()), 11)
    hs, ho = np.histogram(s, edges)[0], np.histogram(o, edges)[0]
    entropy = lambda c: -sum(p * math.log(p) for p in c / c.sum() if p > 0)
    hu = abs(entropy(np.histogram(s, 10)[0]) - entropy(np.histogram(o, 10)[0]))
    assert got.MFM_eta == pytest.approx(np.minimum(hs, ho).sum() / ho.sum())
    assert got.MFM_varphi == pytest.approx(math.exp(-max(abs(entropy(hs) - entropy(ho)), hu)))
    assert 0 < got.MFM_omega < 1
    assert got.MFM == pytest.approx(1 - math.sqrt(((1 - got.MFM_omega) ** 2 + (1 - got.MFM_varphi) ** 2 + (1 - got.MFM_eta) ** 2) / 3))


def test_kappa_and_user_metric(spark):
    df = pairs(spark, [0, 0, 1, 1, 1], [0, 1, 1, 1, 0])
    po, pe = 3 / 5, (2 * 2 + 3 * 3) / 25
    assert skill.kappa(df, ["k"]).first().kappa_coeff == pytest.approx((po - pe) / (1 - pe))
    from pyspark.sql import functions as F

    skill.register("twice_bias", lambda: 2 * F.col("d_mean"))
    assert skill.metrics(df, ["k"], ["twice_bias"]).first().twice_bias == pytest.approx(0.0)
    del skill.METRICS["twice_bias"]


def test_persistence_keeps_masked_steps(spark):
    rows = [(1, datetime(2000, 1, d), float(s) if s is not None else None, float(o) if o is not None else None) for d, s, o in [(1, 1, 1), (2, None, None), (3, 4, 3), (4, 6, 5)]]
    df = spark.createDataFrame(rows, "k int, time timestamp_ntz, s double, o double")
    assert skill.persistence(df, ["k"]).first().cp == pytest.approx(1 - 1 / 4)
