"""Queries over metrics and scores (MT, SC), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.guards import weighted_mean
from ..operators import skill
from . import domain
from .domain import FIELD, KEYS, SQL_GRID, SQL_METRICS, SQL_PARTS

QUERIES, SQL = {}, {}


def _metric_query(names):
    def run(spark, sf_dir):
        got = skill.metrics(domain.grid_pairs(spark, sf_dir), KEYS, names)
        return got.select(*KEYS, *(F.round(n, 4).alias(n) for n in names))

    columns = ", ".join(f'round({SQL_METRICS[n]}, 4) AS "{n}"' for n in names)
    return run, f"WITH {SQL_GRID} SELECT ref, sim, cell, {columns} FROM moments"


for number, name in enumerate(["bias", "percent_bias", "absolute_percent_bias", "mean_absolute_error", "RMSE", "ubRMSE", "CRMSD", "correlation", "correlation_R2", "ubcorrelation", "ubcorrelation_R2", "L", "NSE", "ubNSE", "KGE", "KGESS", "rv", "pc_max", "pc_min", "pc_ampli"], 1):
    QUERIES[f"mt{number}_{name}"], SQL[f"mt{number}_{name}"] = _metric_query([name])
for key, name in (("mt22", "br2"), ("mt25", "smpi"), ("mt31", "ubKGE"), ("sc1", "nBiasScore"), ("sc2", "nRMSEScore")):
    QUERIES[f"{key}_{name}"], SQL[f"{key}_{name}"] = _metric_query([name])
QUERIES["mt_all_moments"], SQL["mt_all_moments"] = _metric_query(list(SQL_METRICS))


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


WIDE = ["bias", "RMSE", "correlation", "KGE", "nBiasScore", "nRMSEScore"]


@query(f"WITH {SQL_PARTS} SELECT ref, sim, cell, " + ", ".join(f'round({SQL_METRICS[n]}, 3) AS "{n}"' for n in WIDE) + " FROM moments")
def mt_wide_grid(spark, sf_dir):
    """Every part a cell: the number of cells grows with the data."""
    got = skill.metrics(domain.grid_pairs(spark, sf_dir, parts=True), KEYS, WIDE)
    return got.select(*KEYS, *(F.round(n, 3).alias(n) for n in WIDE))


SQL_ABOUT = f"""{SQL_GRID}, about AS (SELECT p.*, o_mean AS om FROM pairs p JOIN moments USING (ref, sim, cell)),
dev AS (SELECT ref, sim, cell, sum(abs(s - o)) AS a, 2 * sum(abs(o - om)) AS b, sum((s - o) ** 2) AS sse, sum((abs(s - om) + abs(o - om)) ** 2) AS spread FROM about GROUP BY 1, 2, 3)"""


@query(f"WITH {SQL_ABOUT} SELECT ref, sim, cell, round(CASE WHEN b = 0 THEN NULL WHEN a <= b THEN 1 - a / b ELSE b / a - 1 END, 6) AS dr FROM dev")
def mt24_dr(spark, sf_dir):
    return skill.metrics(domain.grid_pairs(spark, sf_dir), KEYS, ["dr"]).withColumn("dr", F.round("dr", 6))


@query(f"WITH {SQL_ABOUT} SELECT ref, sim, cell, round(1 - sse / nullif(spread, 0), 6) AS index_agreement FROM dev")
def sc7_index_agreement(spark, sf_dir):
    return skill.metrics(domain.grid_pairs(spark, sf_dir), KEYS, ["index_agreement"]).withColumn("index_agreement", F.round("index_agreement", 6))


@query(f"""WITH {SQL_GRID}, y AS (SELECT ref, sim, cell, year(time) + (month(time) >= 10)::INT AS y, max(s) AS ms, max(o) AS mo FROM pairs GROUP BY 1, 2, 3, 4)
SELECT ref, sim, cell, round(avg((ms - mo) / nullif(mo, 0)), 6) AS "APFB" FROM y GROUP BY 1, 2, 3""")
def mt21_APFB(spark, sf_dir):
    return skill.apfb(domain.grid_pairs(spark, sf_dir), KEYS, start_month=10).withColumn("APFB", F.round("APFB", 6))


@query(f"""WITH {SQL_GRID}, y AS (SELECT ref, sim, cell, year(time) AS year, max(s) AS ms, max(o) AS mo FROM pairs GROUP BY 1, 2, 3, 4)
SELECT ref, sim, cell, year, round((ms - mo) / nullif(mo, 0), 6) AS "APFB" FROM y""")
def mt21_APFB_per_year(spark, sf_dir):
    return skill.apfb(domain.grid_pairs(spark, sf_dir), KEYS, per_year=True).withColumn("APFB", F.round("APFB", 6))


@query(f"""WITH {SQL_GRID}, b AS (SELECT *, lag(o) OVER (PARTITION BY ref, sim, cell ORDER BY time) AS b FROM pairs)
SELECT ref, sim, cell, round(1 - sum((s - o) ** 2) / nullif(sum((o - b) ** 2), 0), 6) AS cp FROM b WHERE b IS NOT NULL GROUP BY 1, 2, 3""")
def mt23_cp(spark, sf_dir):
    return skill.persistence(domain.grid_pairs(spark, sf_dir), KEYS).withColumn("cp", F.round("cp", 6))


SQL_BINS = f"""{SQL_GRID}, lim AS (SELECT ref, sim, cell, least(min(s), min(o)) AS lo, greatest(max(s), max(o)) AS hi, count(*) AS n FROM pairs GROUP BY 1, 2, 3),
b AS (SELECT ref, sim, cell, n, CASE WHEN lo = hi THEN 0 ELSE least(floor((s - lo) * 10 / (hi - lo)), 9) END AS bs, CASE WHEN lo = hi THEN 0 ELSE least(floor((o - lo) * 10 / (hi - lo)), 9) END AS bo FROM pairs JOIN lim USING (ref, sim, cell)),
h AS (SELECT ref, sim, cell, n, bin, sum(i) AS ns, sum(1 - i) AS no FROM (SELECT ref, sim, cell, n, bs AS bin, 1 AS i FROM b UNION ALL SELECT ref, sim, cell, n, bo, 0 FROM b) GROUP BY 1, 2, 3, 4, 5)"""


@query(f"WITH {SQL_BINS} SELECT ref, sim, cell, round(sum(least(ns, no)) / sum(no), 6) AS \"MFM_eta\" FROM h GROUP BY 1, 2, 3, n HAVING n >= 3")
def mt28_MFM_eta(spark, sf_dir):
    return skill.mfm(domain.grid_pairs(spark, sf_dir), KEYS).select(*KEYS, F.round("MFM_eta", 6).alias("MFM_eta")).filter("MFM_eta IS NOT NULL")


SQL_VARPHI = f"""{SQL_BINS}, shared AS (SELECT ref, sim, cell, abs(-sum(CASE WHEN ns > 0 THEN (ns / n) * ln(ns / n) ELSE 0 END) + sum(CASE WHEN no > 0 THEN (no / n) * ln(no / n) ELSE 0 END)) AS hs, sum(least(ns, no)) / sum(no) AS eta FROM h GROUP BY 1, 2, 3),
lim2 AS (SELECT ref, sim, cell, min(s) AS sl, max(s) AS sh, min(o) AS ol, max(o) AS oh, count(*) AS n FROM pairs GROUP BY 1, 2, 3),
own AS (SELECT ref, sim, cell, n, 's' AS k, CASE WHEN sl = sh THEN 0 ELSE least(floor((s - sl) * 10 / (sh - sl)), 9) END AS bin FROM pairs JOIN lim2 USING (ref, sim, cell)
  UNION ALL SELECT ref, sim, cell, n, 'o', CASE WHEN ol = oh THEN 0 ELSE least(floor((o - ol) * 10 / (oh - ol)), 9) END FROM pairs JOIN lim2 USING (ref, sim, cell)),
c AS (SELECT ref, sim, cell, n, k, bin, count(*) / n AS p FROM own GROUP BY 1, 2, 3, 4, 5, 6),
e AS (SELECT ref, sim, cell, n, k, -sum(p * ln(p)) AS h FROM c GROUP BY 1, 2, 3, 4, 5),
u AS (SELECT ref, sim, cell, n, abs(sum(CASE WHEN k = 's' THEN h ELSE -h END)) AS hu FROM e GROUP BY 1, 2, 3, 4),
varphi AS (SELECT ref, sim, cell, exp(-greatest(hs, hu)) AS varphi, eta FROM shared JOIN u USING (ref, sim, cell) WHERE n >= 3)"""
SQL_OMEGA = """num AS (SELECT *, row_number() OVER w - 1 AS j, count(*) OVER (PARTITION BY ref, sim, cell) AS n FROM pairs WINDOW w AS (PARTITION BY ref, sim, cell ORDER BY time)),
fou AS (SELECT ref, sim, cell, k, sum(s * cos(2 * pi() * ((k * j) % n) / n)) AS sc, sum(s * sin(2 * pi() * ((k * j) % n) / n)) AS ss, sum(o * cos(2 * pi() * ((k * j) % n) / n)) AS oc, sum(o * sin(2 * pi() * ((k * j) % n) / n)) AS os
  FROM num, range(2, 200) AS r(k) WHERE k <= n // 2 GROUP BY 1, 2, 3, 4),
top AS (SELECT ref, sim, cell, arg_max(atan2(-ss, sc) - atan2(-os, oc), oc * oc + os * os) AS turn FROM fou GROUP BY 1, 2, 3),
omega AS (SELECT ref, sim, cell, CASE WHEN n >= 3 THEN cos(coalesce(turn - 2 * pi() * round(turn / (2 * pi())), 0) / 4) * exp(-d_abs / nullif(abs(o_mean), 0)) END AS omega FROM moments LEFT JOIN top USING (ref, sim, cell))"""


@query(f'WITH {SQL_VARPHI} SELECT ref, sim, cell, round(varphi, 6) AS "MFM_varphi" FROM varphi')
def mt27_MFM_varphi(spark, sf_dir):
    return skill.mfm(domain.grid_pairs(spark, sf_dir), KEYS).select(*KEYS, F.round("MFM_varphi", 6).alias("MFM_varphi")).filter("MFM_varphi IS NOT NULL")


@query(f'WITH {SQL_GRID}, {SQL_OMEGA} SELECT ref, sim, cell, round(omega, 6) AS "MFM_omega" FROM omega')
def mt26_MFM_omega(spark, sf_dir):
    return skill.omega(domain.grid_pairs(spark, sf_dir), KEYS).withColumn("MFM_omega", F.round("MFM_omega", 6))


@query(f"""WITH {SQL_VARPHI}, {SQL_OMEGA} SELECT ref, sim, cell, round(omega, 6) AS "MFM_omega", round(varphi, 6) AS "MFM_varphi", round(eta, 6) AS "MFM_eta",
round(1 - sqrt(((1 - omega) ** 2 + (1 - varphi) ** 2 + (1 - eta) ** 2) / 3), 6) AS "MFM" FROM omega JOIN varphi USING (ref, sim, cell)""")
def mt29_MFM(spark, sf_dir):
    return skill.mfm(domain.grid_pairs(spark, sf_dir), KEYS).select(*KEYS, *(F.round(c, 6).alias(c) for c in ("MFM_omega", "MFM_varphi", "MFM_eta", "MFM")))


@query(f"""WITH {SQL_GRID}, q AS (SELECT ref, sim, floor(s / 4000)::INT AS a, floor(o / 4000)::INT AS b FROM pairs),
t AS (SELECT ref, sim, count(*) AS n, count(*) FILTER (a = b) AS same FROM q GROUP BY 1, 2), x AS (SELECT ref, sim, a AS k, count(*) AS c FROM q GROUP BY 1, 2, 3),
y AS (SELECT ref, sim, b AS k, count(*) AS c FROM q GROUP BY 1, 2, 3), e AS (SELECT ref, sim, sum(x.c * y.c) AS xy FROM x JOIN y USING (ref, sim, k) GROUP BY 1, 2)
SELECT ref, sim, round((same / n - coalesce(xy, 0) / (n * n)) / (1 - coalesce(xy, 0) / (n * n)), 6) AS kappa_coeff FROM t LEFT JOIN e USING (ref, sim)""")
def mt32_kappa(spark, sf_dir):
    coded = domain.grid_pairs(spark, sf_dir).withColumns({c: F.floor(F.col(c) / 4000).cast("double") for c in ("s", "o")})
    return skill.kappa(coded, FIELD).withColumn("kappa_coeff", F.round("kappa_coeff", 6))


@query(f"""WITH {SQL_GRID}, e AS (SELECT p.ref, p.sim, cell, ln(s + o_mean / 100) AS s, ln(o + o_mean / 100) AS o FROM pairs p JOIN moments USING (ref, sim, cell)),
a AS (SELECT *, avg(o) OVER (PARTITION BY ref, sim, cell) AS om FROM e), d AS (SELECT ref, sim, cell, sum(abs(s - o)) AS a, 2 * sum(abs(o - om)) AS b FROM a GROUP BY 1, 2, 3)
SELECT ref, sim, cell, round(CASE WHEN b = 0 THEN NULL WHEN a <= b THEN 1 - a / b ELSE b / a - 1 END, 6) AS dr FROM d""")
def mt33_transformed_dr(spark, sf_dir):
    logs = skill.transformed(domain.grid_pairs(spark, sf_dir), KEYS, F.ln, "pushpalatha")
    return skill.metrics(logs, KEYS, ["dr"]).withColumn("dr", F.round("dr", 6))


@query(f"""WITH {SQL_GRID}, y AS (SELECT ref, sim, cell, year(time) AS y, max(sqrt(s + 5000)) AS ms, max(sqrt(o + 5000)) AS mo FROM pairs GROUP BY 1, 2, 3, 4)
SELECT ref, sim, cell, round(avg((ms - mo) / nullif(mo, 0)), 6) AS "APFB" FROM y GROUP BY 1, 2, 3""")
def mt33_transformed_APFB(spark, sf_dir):
    roots = skill.transformed(domain.grid_pairs(spark, sf_dir), KEYS, F.sqrt, "constant", 5000)
    return skill.apfb(roots, KEYS).withColumn("APFB", F.round("APFB", 6))


@query(f"""WITH {SQL_GRID}, e AS (SELECT p.ref, p.sim, cell, ln(s + o_mean * 0.1) AS s, ln(o + o_mean * 0.1) AS o FROM pairs p JOIN moments USING (ref, sim, cell)),
b AS (SELECT ref, sim, cell, abs(covar_pop(s, o) / nullif(var_pop(o), 0)) AS b, covar_pop(s, o) / nullif(stddev_pop(s) * stddev_pop(o), 0) AS r FROM e GROUP BY 1, 2, 3)
SELECT ref, sim, cell, round(CASE WHEN b <= 1 THEN b * r * r ELSE r * r / b END, 6) AS br2 FROM b""")
def mt33_transformed_br2(spark, sf_dir):
    logs = skill.transformed(domain.grid_pairs(spark, sf_dir), KEYS, F.ln, "factor", 0.1)
    return skill.metrics(logs, KEYS, ["br2"]).withColumn("br2", F.round("br2", 6))


@query(f"""WITH {SQL_GRID}, b AS (SELECT ref, sim, cell, 1 / s AS s, 1 / o AS o, lag(1 / o) OVER (PARTITION BY ref, sim, cell ORDER BY time) AS b FROM pairs)
SELECT ref, sim, cell, round(1 - sum((s - o) ** 2) / nullif(sum((o - b) ** 2), 0), 6) AS cp FROM b WHERE b IS NOT NULL GROUP BY 1, 2, 3""")
def mt33_transformed_cp(spark, sf_dir):
    inverse = skill.transformed(domain.grid_pairs(spark, sf_dir), KEYS, lambda c: 1 / c)
    return skill.persistence(inverse, KEYS).withColumn("cp", F.round("cp", 6))


SQL_MONTHS = f"""{SQL_GRID}, mon AS (SELECT ref, sim, cell, month(time) AS m, count(*) AS n, avg(s) AS ms, avg(o) AS mo, var_pop(s) AS vs, var_pop(o) AS vo FROM pairs GROUP BY 1, 2, 3, 4),
sea AS (SELECT ref, sim, cell, arg_max(m, (ms, -m)) AS ps, arg_max(m, (mo, -m)) AS po, max(ms) - min(ms) AS ws, max(mo) - min(mo) AS wo,
  sqrt(sum(n * vs) / sum(n)) AS is_, sqrt(sum(n * vo) / sum(n)) AS io FROM mon GROUP BY 1, 2, 3)"""


def _seasonal(name):
    def run(spark, sf_dir):
        months = skill.month_table(domain.grid_pairs(spark, sf_dir), KEYS)
        return skill.seasonal_scores(months, KEYS).select(*KEYS, F.round(name, 6).alias(name))

    return run


for key, name, sql in (
    ("sc3", "nPhaseScore", "CASE WHEN ws > 0 AND wo > 0 THEN (1 + cos((ps - po) * 2 * pi() / 12)) / 2 END"),
    ("sc4", "nIavScore", "exp(-abs(is_ - io) / nullif(io, 0))"),
    ("sc6", "nSeasonalityScore", "exp(-abs((ws - wo) / nullif(wo, 0)))"),
):
    QUERIES[f"{key}_{name}"] = _seasonal(name)
    SQL[f"{key}_{name}"] = f'WITH {SQL_MONTHS} SELECT ref, sim, cell, round({sql}, 6) AS "{name}" FROM sea'

SQL_UNLIKE = """unlike AS (SELECT 'R' AS ref, 'Q' AS sim, s_nationkey AS cell, date_trunc('month', l_shipdate)::TIMESTAMP AS time, avg(l_quantity) AS s, avg(l_extendedprice) AS o FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_discount > 0.05 GROUP BY 3, 4)"""


@query(f'WITH {SQL_MONTHS.replace("mon AS (", SQL_UNLIKE + ", mon AS (").replace("FROM pairs GROUP BY 1, 2, 3, 4", "FROM unlike GROUP BY 1, 2, 3, 4")} SELECT ref, sim, cell, round(CASE WHEN ws > 0 AND wo > 0 THEN (1 + cos((ps - po) * 2 * pi() / 12)) / 2 END, 6) AS "nPhaseScore", round(exp(-abs((ws - wo) / nullif(wo, 0))), 6) AS "nSeasonalityScore" FROM sea')
def sc3_sc6_unlike(spark, sf_dir):
    """Quantities of discounted items as a simulation of their prices: the peaks lie in other months."""
    items = domain.table(spark, sf_dir, "lineitem").filter("l_discount > 0.05").join(domain.table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = items.groupBy(F.lit("R").alias("ref"), F.lit("Q").alias("sim"), F.col("s_nationkey").alias("cell"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("time")).agg(F.avg("l_quantity").alias("s"), F.avg("l_extendedprice").alias("o"))
    got = skill.seasonal_scores(skill.month_table(pairs, KEYS), KEYS)
    return got.select(*KEYS, *(F.round(c, 6).alias(c) for c in ("nPhaseScore", "nSeasonalityScore")))


SQL_SPATIAL = """spa AS (SELECT ref, sim, 2 * (1 + covar_pop(s_mean, o_mean) / nullif(stddev_pop(s_mean) * stddev_pop(o_mean), 0))
  / nullif((stddev_pop(s_mean) / nullif(stddev_pop(o_mean), 0) + stddev_pop(o_mean) / nullif(stddev_pop(s_mean), 0)) ** 2, 0) AS sp FROM moments GROUP BY 1, 2)"""


@query(f'WITH {SQL_GRID}, {SQL_SPATIAL} SELECT ref, sim, round(sp, 6) AS "nSpatialScore" FROM spa')
def sc5_nSpatialScore(spark, sf_dir):
    means = skill.moments(domain.grid_pairs(spark, sf_dir), KEYS)
    return skill.spatial_score(means, FIELD).withColumn("nSpatialScore", F.round("nSpatialScore", 6))


SQL_SCORES = f"""{SQL_MONTHS}, {SQL_SPATIAL}, sco AS (SELECT ref, sim, cell, exp(-abs(d_mean) / nullif(o_sd, 0)) AS b, exp(-d_sd / nullif(o_sd, 0)) AS e,
  CASE WHEN ws > 0 AND wo > 0 THEN (1 + cos((ps - po) * 2 * pi() / 12)) / 2 END AS p, exp(-abs(is_ - io) / nullif(io, 0)) AS i, sp
  FROM moments JOIN sea USING (ref, sim, cell) JOIN spa USING (ref, sim)),
ove AS (SELECT *, (coalesce(b, 0) + 2 * coalesce(e, 0) + coalesce(p, 0) + coalesce(i, 0) + coalesce(sp, 0))
  / nullif((b IS NOT NULL)::INT + 2 * (e IS NOT NULL)::INT + (p IS NOT NULL)::INT + (i IS NOT NULL)::INT + (sp IS NOT NULL)::INT, 0) AS overall FROM sco)"""


@query(f'WITH {SQL_SCORES} SELECT ref, sim, cell, round(overall, 6) AS "Overall_Score" FROM ove')
def sc8_Overall_Score(spark, sf_dir):
    return skill.scores(domain.grid_pairs(spark, sf_dir), FIELD, ["cell"]).select(*KEYS, F.round("Overall_Score", 6).alias("Overall_Score"))


@query(f"""WITH {SQL_SCORES}, w AS (SELECT sim, cos(radians(-60 + 30 * (cell % 5))) AS w, overall FROM ove)
SELECT 'price' AS item, 'R' AS ref, round(sum(w * overall) FILTER (sim = 'A') / sum(w) FILTER (sim = 'A'), 6) AS "A", round(sum(w * overall) FILTER (sim = 'B') / sum(w) FILTER (sim = 'B'), 6) AS "B",
  round(sum(w * overall) FILTER (sim = 'C') / sum(w) FILTER (sim = 'C'), 6) AS "C" FROM w""")
def c1_heatmap(spark, sf_dir):
    scored = skill.scores(domain.grid_pairs(spark, sf_dir), FIELD, ["cell"]).withColumn("w", F.cos(F.radians(domain.lat())))
    return scored.groupBy(F.lit("price").alias("item"), "ref").pivot("sim", list(domain.SIMS)).agg(F.round(weighted_mean("Overall_Score", "w"), 6))
