"""Queries over masks, comparisons, classes and reports (M, C, A, R), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.guards import weighted_mean
from ..operators import compare, pairing, report, skill
from . import domain, stat_queries
from .domain import FIELD, KEYS, SQL_GRID, SQL_METRICS, SQL_PARTS, SQL_STATIONS
from .skill_queries import SQL_SCORES
from .stat_queries import rounded

QUERIES, SQL = {}, {}
NAMES = ["bias", "RMSE", "correlation", "nBiasScore", "nRMSEScore"]
SCORES = ["nBiasScore", "nRMSEScore"]
SQL_W = "cos(radians(-60 + 30 * (cell % 5)))"
SQL_FIELD = f"{SQL_GRID}, field AS (" + " UNION ALL ".join(f"SELECT ref, sim, cell, {SQL_W} AS w, '{n}' AS name, {SQL_METRICS[n]} AS value FROM moments" for n in NAMES) + ")"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def weighted(df):
    return df.withColumn("w", F.cos(F.radians(domain.lat())))


def field(spark, sf_dir, names=NAMES):
    return weighted(skill.unpivot(skill.metrics(domain.grid_pairs(spark, sf_dir), KEYS, names), KEYS, names))


def sources(spark, sf_dir):
    s = domain.grid_series(spark, sf_dir)
    return s.filter("source <> 'R'"), s.filter("source = 'R'")


@query(f"WITH {SQL_GRID} SELECT ref, sim, cell, count(*) AS n, round(avg(s - o), 4) AS bias FROM pairs GROUP BY 1, 2, 3")
def j1_pairing(spark, sf_dir):
    got = pairing.pair(*sources(spark, sf_dir))
    return got.groupBy("ref", "sim", "cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("s") - F.col("o")), 4).alias("bias"))


@query(f"""WITH {SQL_GRID}, l AS (SELECT DISTINCT cell, time FROM series WHERE source = 'A' AND month(time) <> 3), r AS (SELECT DISTINCT cell, time FROM series WHERE source = 'R' AND month(time) <> 5)
SELECT coalesce(l.cell, r.cell) AS cell, coalesce(l.time, r.time) AS time, CASE WHEN l.cell IS NULL THEN 'ref' ELSE 'sim' END AS side FROM l FULL JOIN r ON l.cell = r.cell AND l.time = r.time WHERE l.cell IS NULL OR r.cell IS NULL""")
def j2_strict_alignment(spark, sf_dir):
    sims, refs = sources(spark, sf_dir)
    return pairing.one_sided(sims.filter("source = 'A' AND month(time) <> 3"), refs.filter("month(time) <> 5"), ["cell", "time"])


@query(f"""WITH {SQL_STATIONS}, e AS (SELECT a.station_id, a.time, a.value AS s, b.value AS o FROM st a JOIN st b USING (station_id, time) WHERE a.source = 'click' AND b.source = 'view' AND a.value IS NOT NULL AND b.value IS NOT NULL),
sm AS (SELECT source, station_id, date_trunc('month', time)::TIMESTAMP AS time, value FROM st WHERE value IS NOT NULL),
n AS (SELECT a.station_id, a.time, a.value AS s, b.value AS o FROM sm a JOIN sm b USING (station_id, time) WHERE a.source = 'click' AND b.source = 'view' AND a.station_id NOT IN (SELECT station_id FROM e)),
u AS (SELECT * FROM e UNION ALL SELECT * FROM n)
SELECT station_id, count(*) AS n, round(sum(s - o), 5) AS d FROM u GROUP BY 1""")
def j3_station_pairing(spark, sf_dir):
    s = domain.station_series(spark, sf_dir)
    got = pairing.pair_stations(s.filter("source = 'click'"), s.filter("source = 'view'"), "month")
    return got.groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("s") - F.col("o")), 5).alias("d"))


@query("""WITH l AS (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 110 GROUP BY 1), r AS (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'signup' AND value > 110 GROUP BY 1)
SELECT coalesce(l.k, r.k) AS user_id, CASE WHEN l.k IS NULL THEN 'missing left' WHEN r.k IS NULL THEN 'missing right' ELSE 'repeated' END AS finding FROM l FULL JOIN r ON l.k = r.k WHERE l.k IS NULL OR r.k IS NULL OR l.n > 1 OR r.n > 1""")
def j7_key_findings(spark, sf_dir):
    e = domain.table(spark, sf_dir, "events")
    return pairing.key_findings(e.filter("event_type = 'purchase' AND value > 110"), e.filter("event_type = 'signup' AND value > 110"), "user_id")


@query("""SELECT s_suppkey, round(n_line, 2) AS n_line FROM supplier LEFT JOIN (SELECT l_suppkey, sum(l_quantity) AS n_line FROM lineitem WHERE l_discount > 0.09 GROUP BY 1) ON s_suppkey = l_suppkey""")
def j8_align_to(spark, sf_dir):
    lines = domain.table(spark, sf_dir, "lineitem").filter("l_discount > 0.09").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.sum("l_quantity"), 2).alias("n_line"))
    return pairing.align_to(domain.table(spark, sf_dir, "supplier"), lines, "s_suppkey")


@query(f"""WITH {SQL_GRID}, m AS (SELECT cell, time, CASE WHEN cell % 7 <> 3 OR month(time) <> 2 THEN "A" END AS a, CASE WHEN cell % 5 <> 1 THEN "B" END AS b FROM wide),
w AS (SELECT *, count(*) OVER (PARTITION BY cell) AS n, count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) OVER (PARTITION BY cell) AS k FROM m)
SELECT cell, count(*) AS n, round(sum(a), 2) AS a, round(sum(b), 2) AS b FROM w WHERE n = k GROUP BY 1""")
def j9_complete_rows(spark, sf_dir):
    w = domain.grid_wide(spark, sf_dir)
    got = pairing.complete_rows({"a": w.filter("cell % 7 <> 3 OR month(time) <> 2").select("cell", "time", F.col("A").alias("value")), "b": w.filter("cell % 5 <> 1").select("cell", "time", F.col("B").alias("value"))}, ["cell", "time"])
    return got.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("a"), 2).alias("a"), F.round(F.sum("b"), 2).alias("b"))


#: Simulations with gaps and with axes of their own: C ends in 1996, B starts in 1993, A lacks the Aprils and C a cell.
SHORT = "NOT (source = 'C' AND year(time) > 1996) AND NOT (source = 'B' AND year(time) < 1993)"
HOLES = "(source = 'A' AND month(time) = 4) OR (source = 'C' AND cell = 2)"


@query(f"""WITH {SQL_GRID}, s AS (SELECT source, cell, time, CASE WHEN NOT ({HOLES}) THEN value END AS value FROM series WHERE source <> 'R' AND {SHORT}),
hit AS (SELECT w.cell, w.time FROM wide w JOIN (SELECT DISTINCT source, time FROM s) x ON x.time = w.time LEFT JOIN s ON s.source = x.source AND s.time = w.time AND s.cell = w.cell WHERE s.value IS NULL)
SELECT cell, year(time) AS year, count(*) AS n, round(sum("R"), 2) AS total FROM wide ANTI JOIN hit USING (cell, time) GROUP BY 1, 2""")
def m2_unified_mask(spark, sf_dir):
    sims, refs = sources(spark, sf_dir)
    holed = sims.filter(SHORT).withColumn("value", F.when(~F.expr(HOLES), F.col("value")))
    return pairing.unified_mask(holed, refs).groupBy("cell", F.year("time").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""WITH {SQL_GRID}, s AS (SELECT * FROM series WHERE source <> 'R' AND {SHORT}), a AS (SELECT source, list(DISTINCT time ORDER BY time) AS t FROM s GROUP BY 1), r AS (SELECT list(DISTINCT time ORDER BY time) AS t FROM wide)
SELECT source, CASE WHEN len(list_intersect(a.t, r.t)) = 0 THEN 'no time in common' WHEN len(a.t) <> len(r.t) THEN 'another length' ELSE 'other times' END AS finding FROM a, r WHERE a.t <> r.t""")
def m2_axis_findings(spark, sf_dir):
    sims, refs = sources(spark, sf_dir)
    return pairing.axis_findings(sims.filter(SHORT), refs).select("source", "finding")


@query(f"""WITH {SQL_FIELD}, q AS (SELECT ref, sim, name, quantile_cont(value, 0.05::DOUBLE) AS a, quantile_cont(value, 0.95::DOUBLE) AS b FROM field GROUP BY 1, 2, 3)
SELECT ref, sim, name, count(*) AS n, round(median(value), 4) AS median FROM field JOIN q USING (ref, sim, name) WHERE value BETWEEN a AND b GROUP BY 1, 2, 3""")
def m5_clip(spark, sf_dir):
    got = pairing.clip(field(spark, sf_dir), ["ref", "sim", "name"])
    return got.groupBy("ref", "sim", "name").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("value"), 4).alias("median"))


@query(f"""WITH {SQL_GRID} SELECT ref, sim, count(*) AS n FROM moments WHERE 100 * d_sum / nullif(o_sum, 0) BETWEEN -4.95 AND 4.95 GROUP BY 1, 2""")
def m6_plausible(spark, sf_dir):
    return pairing.plausible(field(spark, sf_dir, ["percent_bias"]), low=-4.95, high=4.95).groupBy("ref", "sim").agg(F.count(F.lit(1)).alias("n"))


SQL_PARALLEL = f"""{SQL_FIELD}, q AS (SELECT ref, sim, name, quantile_cont(value, 0.05::DOUBLE) AS a, quantile_cont(value, 0.95::DOUBLE) AS b FROM field GROUP BY 1, 2, 3),
par AS (SELECT ref, sim, name, sum(w * value) / sum(w) AS value FROM field WHERE name LIKE 'n%' GROUP BY 1, 2, 3 UNION ALL
SELECT ref, sim, name, median(value) FROM field JOIN q USING (ref, sim, name) WHERE name NOT LIKE 'n%' AND value BETWEEN a AND b GROUP BY 1, 2, 3)"""


@query(f"""WITH {SQL_SCORES}, w AS (SELECT sim, {SQL_W} AS w, overall FROM ove) SELECT sim, round(sum(w * overall) / sum(w), 6) AS score FROM w GROUP BY 1""")
def c2_radar_map(spark, sf_dir):
    scored = weighted(skill.scores(domain.grid_pairs(spark, sf_dir), FIELD, ["cell"]))
    return scored.groupBy("sim").agg(F.round(weighted_mean("Overall_Score", "w"), 6).alias("score"))


@query(f"WITH {SQL_PARALLEL} SELECT ref, sim, name, round(value, 4) AS value FROM par")
def c3_parallel_coordinates(spark, sf_dir):
    return rounded(compare.parallel(field(spark, sf_dir), FIELD, SCORES), "value")


@query(f"""WITH {SQL_PARTS}, field AS (SELECT ref, sim, d_mean AS value FROM moments) SELECT ref, sim, count(value) AS n, round(min(value), 3) AS low, round(quantile_cont(value, 0.25::DOUBLE), 3) AS q25, round(median(value), 3) AS median, round(quantile_cont(value, 0.75::DOUBLE), 3) AS q75, round(max(value), 3) AS high FROM field GROUP BY 1, 2""")
def c8_whiskers_wide(spark, sf_dir):
    """Whiskers over a grid whose cells are the parts."""
    bias = skill.metrics(domain.grid_pairs(spark, sf_dir, parts=True), KEYS, ["bias"]).withColumnRenamed("bias", "value")
    return rounded(compare.whiskers(bias, FIELD), "low", "q25", "median", "q75", "high", digits=3)


SQL_SEASON = """CASE WHEN month(time) IN (12, 1, 2) THEN 'DJF' WHEN month(time) <= 5 THEN 'MAM' WHEN month(time) <= 8 THEN 'JJA' ELSE 'SON' END"""


@query(f"""WITH {SQL_GRID}, m AS (SELECT ref, sim, cell, {SQL_SEASON} AS season, avg(s - o) AS bias, exp(-stddev_pop(s - o) / nullif(stddev_pop(o), 0)) AS score FROM pairs GROUP BY 1, 2, 3, 4),
q AS (SELECT ref, sim, season, quantile_cont(bias, 0.05::DOUBLE) AS a, quantile_cont(bias, 0.95::DOUBLE) AS b FROM m GROUP BY 1, 2, 3)
SELECT ref, sim, season, 'bias' AS name, round(median(bias), 4) AS value FROM m JOIN q USING (ref, sim, season) WHERE bias BETWEEN a AND b GROUP BY 1, 2, 3
UNION ALL SELECT ref, sim, season, 'nRMSEScore', round(sum({SQL_W} * score) / sum({SQL_W}) FILTER (score IS NOT NULL), 4) FROM m GROUP BY 1, 2, 3""")
def c4_portrait_seasonal(spark, sf_dir):
    from ..operators import timeops

    pairs = domain.grid_pairs(spark, sf_dir).withColumn("season", timeops.season("time"))
    keys, names = [*KEYS, "season"], ["bias", "nRMSEScore"]
    seasonal = weighted(skill.unpivot(skill.metrics(pairs, keys, names), keys, names))
    return rounded(compare.parallel(seasonal, ["ref", "sim", "season"], ["nRMSEScore"]), "value")


SQL_BY_SEASON = SQL_GRID[SQL_GRID.index("moments AS") :].replace("moments AS (SELECT ref, sim, cell,", f"seasons AS (SELECT ref, sim, cell, {SQL_SEASON} AS season,").replace("GROUP BY 1, 2, 3", "GROUP BY 1, 2, 3, 4")
SQL_ALL_SEASONAL = f"""{SQL_GRID}, {SQL_BY_SEASON}, f AS (""" + " UNION ALL ".join(f"SELECT ref, sim, season, cell, '{n}' AS name, {sql} AS value FROM seasons" for n, sql in SQL_METRICS.items()) + f"""),
q AS (SELECT ref, sim, season, name, quantile_cont(value, 0.05::DOUBLE) AS a, quantile_cont(value, 0.95::DOUBLE) AS b FROM f GROUP BY 1, 2, 3, 4)
SELECT ref, sim, season, name, round(median(value), 4) AS value FROM f JOIN q USING (ref, sim, season, name) WHERE name NOT LIKE 'n%' AND value BETWEEN a AND b GROUP BY 1, 2, 3, 4
UNION ALL SELECT ref, sim, season, name, round(sum({SQL_W} * value) / sum({SQL_W}) FILTER (value IS NOT NULL), 4) FROM f WHERE name LIKE 'n%' GROUP BY 1, 2, 3, 4"""


@query(f"WITH {SQL_ALL_SEASONAL}")
def c4_portrait_all(spark, sf_dir):
    """Every metric and score that moments give, by season."""
    from ..operators import timeops

    pairs = domain.grid_pairs(spark, sf_dir).withColumn("season", timeops.season("time"))
    keys, names = [*KEYS, "season"], list(SQL_METRICS)
    seasonal = weighted(skill.unpivot(skill.metrics(pairs, keys, names), keys, names))
    return rounded(compare.parallel(seasonal, ["ref", "sim", "season"], SCORES), "value")


SQL_TAYLOR = f"""{SQL_GRID}, e AS (SELECT *, {SQL_W} AS w, sqrt(greatest(0, s_sd * s_sd + o_sd * o_sd - 2 * s_sd * o_sd * r)) AS c FROM moments),
t AS (SELECT ref, sim, sum(w * s_sd) / sum(w) AS sd_sim, sum(w * o_sd) / sum(w) AS sd_ref, sum(w * r) / (sum(w) FILTER (r IS NOT NULL)) AS r, sum(w * c) / (sum(w) FILTER (c IS NOT NULL)) AS crmsd FROM e GROUP BY 1, 2),
d AS (SELECT *, sqrt(greatest(0, sd_sim * sd_sim + sd_ref * sd_ref - 2 * sd_sim * sd_ref * greatest(-1, least(1, r)))) AS crmsd_diagram FROM t)"""


@query(f"WITH {SQL_TAYLOR} SELECT ref, sim, round(sd_sim, 4) AS sd_sim, round(sd_ref, 4) AS sd_ref, round(r, 6) AS r, round(crmsd, 4) AS crmsd, round(crmsd_diagram, 4) AS crmsd_diagram FROM d")
def c5_taylor(spark, sf_dir):
    got = compare.taylor(weighted(skill.moments(domain.grid_pairs(spark, sf_dir), KEYS)), FIELD)
    return rounded(rounded(got, "sd_sim", "sd_ref", "crmsd", "crmsd_diagram"), "r", digits=6).drop("sd_normalised", "crmsd_normalised")


@query(f"WITH {SQL_TAYLOR} SELECT ref, sim, round(sd_sim / sd_ref, 6) AS sd_normalised, round(crmsd_diagram / sd_ref, 6) AS crmsd_normalised FROM d")
def c19_taylor_normalised(spark, sf_dir):
    got = compare.taylor(weighted(skill.moments(domain.grid_pairs(spark, sf_dir), KEYS)), FIELD)
    return rounded(got.select(*FIELD, "sd_normalised", "crmsd_normalised"), "sd_normalised", "crmsd_normalised", digits=6)


@query(f"""WITH {SQL_GRID} SELECT ref, sim, round(avg(d_mean), 4) AS bias, round(avg(sqrt(d_sq)), 4) AS "RMSE", round(avg(sqrt(greatest(0, s_sd * s_sd + o_sd * o_sd - 2 * s_sd * o_sd * r))), 4) AS "CRMSD" FROM moments GROUP BY 1, 2""")
def c6_target(spark, sf_dir):
    got = skill.metrics(domain.grid_pairs(spark, sf_dir), KEYS, ["bias", "RMSE", "CRMSD"])
    return rounded(got.groupBy(*FIELD).agg(*(F.avg(n).alias(n) for n in ("bias", "RMSE", "CRMSD"))), "bias", "RMSE", "CRMSD")


@query(f"""WITH {SQL_GRID}, v AS (SELECT ref, sim, greatest({SQL_METRICS['NSE']}, -1) AS v FROM moments), s AS (SELECT ref, sim, count(*) AS n, min(v) AS lo, max(v) AS hi, stddev_samp(v) * power(count(*)::DOUBLE, -0.2) AS h FROM v WHERE v IS NOT NULL GROUP BY 1, 2),
x AS (SELECT *, lo + k * (hi - lo) / 99 AS x FROM s, range(100) AS r(k) WHERE n > 1 AND h > 0)
SELECT ref, sim, round(x, 6) AS x, round(sum(exp(-0.5 * power((x - v) / h, 2))) / (n * h * sqrt(2 * pi())), 4) AS density FROM x JOIN v USING (ref, sim) WHERE v IS NOT NULL GROUP BY ref, sim, x, n, h""")
def c7_c9_density(spark, sf_dir):
    values = compare.distribution(field(spark, sf_dir, ["NSE"]), "NSE")
    return rounded(rounded(compare.density(values, FIELD), "x", digits=6), "density")


@query(f"""WITH {SQL_FIELD} SELECT ref, sim, name, count(value) AS n, round(min(value), 4) AS low, round(quantile_cont(value, 0.25::DOUBLE), 4) AS q25, round(median(value), 4) AS median, round(quantile_cont(value, 0.75::DOUBLE), 4) AS q75, round(max(value), 4) AS high FROM field GROUP BY 1, 2, 3""")
def c8_whiskers(spark, sf_dir):
    return rounded(compare.whiskers(field(spark, sf_dir), ["ref", "sim", "name"]), "low", "q25", "median", "q75", "high")


@query(f"""WITH {SQL_FIELD} SELECT a.cell, a.name, a.sim AS sim_a, b.sim AS sim_b, round(a.value - b.value, 4) AS difference FROM field a JOIN field b ON a.ref = b.ref AND a.cell = b.cell AND a.name = b.name AND a.sim < b.sim""")
def c10_differences(spark, sf_dir):
    return rounded(compare.differences(field(spark, sf_dir), ["ref", "cell", "name"]).drop("ref"), "difference")


@query(f"""WITH {SQL_FIELD} SELECT sim, cell, name, round(avg(value) OVER (PARTITION BY ref, cell, name), 4) AS ensemble, round(value - avg(value) OVER (PARTITION BY ref, cell, name), 4) + 0.0 AS anomaly FROM field""")
def c10_ensemble(spark, sf_dir):
    got = compare.ensemble(field(spark, sf_dir), ["ref", "cell", "name"])
    return rounded(got.select("sim", "cell", "name", "ensemble", "anomaly"), "ensemble", "anomaly")


@query(f"""WITH {SQL_FIELD} SELECT sim, cell, name, round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 5) AS relative FROM field WHERE name LIKE 'n%' WINDOW w AS (PARTITION BY ref, cell, name)""")
def c11_relative_score(spark, sf_dir):
    got = compare.relative_score(field(spark, sf_dir, SCORES), ["ref", "cell", "name"])
    return rounded(got.select("sim", "cell", "name", "relative"), "relative", digits=5)


@query(f"""WITH {SQL_STATIONS}, f AS (SELECT station_id, source AS sim, avg(value) AS value FROM st GROUP BY 1, 2)
SELECT station_id, sim, CASE WHEN count(value) OVER w >= 2 THEN round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 5) END AS relative FROM f WINDOW w AS (PARTITION BY station_id)""")
def c11_relative_score_stations(spark, sf_dir):
    means = domain.station_series(spark, sf_dir).groupBy("station_id", F.col("source").alias("sim")).agg(F.avg("value").alias("value"))
    return rounded(compare.relative_score(means, ["station_id"], station=True).select("station_id", "sim", "relative"), "relative", digits=5)


@query(f"""WITH {SQL_GRID} SELECT a.cell, a.source AS sim_a, b.source AS sim_b, round(covar_pop(a.value, b.value) / nullif(stddev_pop(a.value) * stddev_pop(b.value), 0), 6) AS r
FROM series a JOIN series b ON a.cell = b.cell AND a.time = b.time AND a.source < b.source WHERE a.source <> 'R' AND b.source <> 'R' GROUP BY 1, 2, 3""")
def c12_between_sims(spark, sf_dir):
    return rounded(compare.between_sims(sources(spark, sf_dir)[0], ["cell", "time"], ["cell"]), "r", digits=6)


@query(f"WITH {SQL_GRID} SELECT ref, sim, round(sum({SQL_W} * d_mean * d_mean / o_var1) / sum({SQL_W}), 6) AS value FROM moments WHERE o_var1 > 0 GROUP BY 1, 2")
def c13_smpi(spark, sf_dir):
    got = compare.smpi_bootstrap(weighted(domain.grid_pairs(spark, sf_dir)), FIELD, "cell", replicates=20)
    return rounded(got.select("ref", "sim", "value"), "value", digits=6)


def station_pairs(spark, sf_dir):
    series = domain.station_series(spark, sf_dir)
    return pairing.pair(series.filter("source = 'click'"), series.filter("source = 'view'"), ["station_id", "time"])


@query(f"""WITH {SQL_STATIONS}, p AS (SELECT a.station_id, a.value AS s, b.value AS o FROM st a JOIN st b USING (station_id, time) WHERE a.source = 'click' AND b.source = 'view'),
x AS (SELECT station_id, (avg(s) - avg(o)) ** 2 / nullif(var_samp(o), 0) AS x FROM p WHERE s IS NOT NULL AND o IS NOT NULL GROUP BY 1) SELECT 'view' AS ref, 'click' AS sim, round(avg(x), 6) AS value FROM x""")
def c13_smpi_stations(spark, sf_dir):
    return rounded(compare.smpi_stations(station_pairs(spark, sf_dir), ["ref", "sim"], replicates=20).select("ref", "sim", "value"), "value", digits=6)


@query()
def c13_smpi_stations_bootstrap(spark, sf_dir):
    return rounded(compare.smpi_stations(station_pairs(spark, sf_dir), ["ref", "sim"]), "value", "low", "high", digits=6)


@query()
def c13_smpi_bootstrap(spark, sf_dir):
    return rounded(compare.smpi_bootstrap(weighted(domain.grid_pairs(spark, sf_dir)), FIELD, "cell"), "value", "low", "high", digits=6)


@query(f"""WITH {SQL_GRID}, c AS (SELECT sim, cell % 2 AS ref, avg(d_mean) AS bias, avg(r) AS r FROM moments GROUP BY 1, 2), a AS (SELECT DISTINCT ref AS ra FROM c), b AS (SELECT DISTINCT ref AS rb FROM c)
SELECT ra || '|' || rb AS choice, x.sim, round(x.bias, 4) AS bias, round(y.r, 6) AS r FROM a, b, c x, c y WHERE x.ref = ra AND y.ref = rb AND x.sim = y.sim""")
def c20_score_choices(spark, sf_dir):
    f = field(spark, sf_dir, ["bias", "correlation"])
    table = f.groupBy(F.when(F.col("name") == "bias", "bias").otherwise("r").alias("item"), (F.col("cell") % 2).cast("string").alias("ref"), "sim").agg(F.avg("value").alias("value"))
    return rounded(rounded(compare.score_choices(table, ["bias", "r"], domain.SIMS), "bias"), "r", digits=6)


SQL_CLASSED = f"""{SQL_FIELD}, cl AS (SELECT f.*, n_regionkey AS class_id FROM field f JOIN nation ON cell = n_nationkey), bo AS (SELECT * FROM cl UNION ALL SELECT * REPLACE (-1 AS class_id) FROM cl),
q AS (SELECT ref, sim, class_id, name, quantile_cont(value, 0.05::DOUBLE) AS a, quantile_cont(value, 0.95::DOUBLE) AS b FROM bo GROUP BY 1, 2, 3, 4)"""


@query(f"""WITH {SQL_CLASSED} SELECT ref, sim, nullif(class_id, -1)::INT AS class_id, name, round(sum(w * value) / sum(w), 4) AS value FROM bo WHERE name LIKE 'n%' GROUP BY 1, 2, 3, 4
UNION ALL SELECT ref, sim, nullif(class_id, -1)::INT, name, round(median(value), 4) FROM bo JOIN q USING (ref, sim, class_id, name) WHERE name NOT LIKE 'n%' AND value BETWEEN a AND b GROUP BY 1, 2, 3, 4""")
def a1_a3_by_class(spark, sf_dir):
    got = compare.by_class(field(spark, sf_dir), domain.class_mask(spark, sf_dir), FIELD, SCORES)
    return rounded(got.withColumn("class_id", F.col("class_id").cast("int")), "value")


@query(f"WITH {SQL_FIELD} SELECT ref, sim, cell, name, n_regionkey::INT AS class_id, round(value, 4) AS value FROM field JOIN nation ON cell = n_nationkey")
def a4_class_bundle(spark, sf_dir):
    mask = domain.class_mask(spark, sf_dir).withColumn("class_id", F.col("class_id").cast("int"))
    return rounded(field(spark, sf_dir).join(mask, "cell").select(*KEYS, "name", "class_id", "value"), "value")


@query(f"""WITH {SQL_FIELD} SELECT ref, sim, name, count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS sd, round(min(value), 4) AS min, round(max(value), 4) AS max FROM field GROUP BY 1, 2, 3""")
def r1_column_profile(spark, sf_dir):
    return rounded(report.column_profile(field(spark, sf_dir), ["ref", "sim", "name"]), "mean", "sd", "min", "max")


@query(f"""WITH {SQL_FIELD} SELECT ref, sim, name, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS sd, round(min(value), 4) AS min, round(max(value), 4) AS max, round(median(value), 4) AS median, round(100 * count(value) / 25, 4) AS coverage FROM field GROUP BY 1, 2, 3""")
def r2_field_profile(spark, sf_dir):
    return rounded(report.field_profile(field(spark, sf_dir), ["ref", "sim", "name"], 25), "mean", "sd", "min", "max", "median", "coverage")


@query(f"""WITH {SQL_GRID}, g AS (SELECT cell, round(avg(d_mean), 4) AS mean FROM moments GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY mean DESC, cell) AS b, row_number() OVER (ORDER BY mean, cell) AS w FROM g)
SELECT cell, mean, CASE WHEN b <= 3 THEN 'best' ELSE 'worst' END AS side FROM k WHERE b <= 3 OR w <= 3""")
def r3_best_and_worst(spark, sf_dir):
    means = rounded(field(spark, sf_dir, ["bias"]).groupBy("cell").agg(F.avg("value").alias("mean")), "mean")
    return report.best_and_worst(means, "cell", "mean")


@query(f"""WITH {SQL_FIELD}, s AS (SELECT ref, sim, name, avg(value) AS v FROM field WHERE name LIKE 'n%' GROUP BY 1, 2, 3)
SELECT ref, sim, name, round(v, 6) AS mean FROM s UNION ALL SELECT NULL, NULL, NULL, round(avg(v), 6) FROM s""")
def r4_overall_summary(spark, sf_dir):
    return rounded(report.overall_summary(field(spark, sf_dir, SCORES), ["ref", "sim", "name"]), "mean", digits=6)


@query(f"""WITH {SQL_STATIONS}, p AS (SELECT a.station_id, a.value AS s, b.value AS o FROM st a JOIN st b USING (station_id, time) WHERE a.source = 'click' AND b.source = 'view' AND a.value IS NOT NULL AND b.value IS NOT NULL)
SELECT station_id, count(*) AS n, """ + ", ".join(f"round({f}({c}), 7) AS {side}_{name}" for side, c in (("ref", "o"), ("sim", "s")) for name, f in (("mean", "avg"), ("median", "median"), ("max", "max"), ("min", "min"), ("sum", "sum"))) + " FROM p GROUP BY 1")
def c17_basic_stations(spark, sf_dir):
    s = domain.station_series(spark, sf_dir)
    got = compare.basic_pairs(pairing.pair(s.filter("source = 'click'"), s.filter("source = 'view'"), ["station_id", "time"]), ["station_id"])
    return rounded(got, *(c for c in got.columns if "_" in c and c != "station_id"), digits=7)


# comparisons that are a statistic on each source, under their own names
def _alias(name, module, of):
    QUERIES[name] = module.QUERIES[of]
    if of in module.SQL:
        SQL[name] = module.SQL[of]


_alias("c14_mann_kendall", stat_queries, "st10_mann_kendall_p")
_alias("c15_standard_deviation", stat_queries, "st2_st3_spread")
_alias("c16_functional_response", stat_queries, "st9_functional_response")
_alias("c17_basic", stat_queries, "st1_basic")


@query(f"""WITH {SQL_GRID}, v AS (SELECT 'price' AS variable, source, cell, time, value FROM series UNION ALL SELECT 'half', source, cell, time, value / 2 FROM series)
SELECT a.variable, b.source AS ref, a.source AS sim, count(*) AS n, round(avg(a.value - b.value), 4) AS bias FROM v a JOIN v b ON a.variable = b.variable AND a.cell = b.cell AND a.time = b.time
WHERE a.source IN ('A', 'B') AND b.source IN ('R', 'C') GROUP BY 1, 2, 3""")
def j4_all_pairs(spark, sf_dir):
    s = domain.grid_series(spark, sf_dir)
    both = s.unionByName(s.withColumns({"variable": F.lit("half"), "value": F.col("value") / 2}))
    got = pairing.pair(both.filter("source IN ('A', 'B')"), both.filter("source IN ('R', 'C')"))
    return got.groupBy("variable", "ref", "sim").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("s") - F.col("o")), 4).alias("bias"))


@query(f"""WITH {SQL_STATIONS}, ids AS (SELECT DISTINCT station_id FROM st), p AS (SELECT a.station_id, count(*) AS n, avg(a.value - b.value) AS bias FROM st a JOIN st b USING (station_id, time) WHERE a.source = 'error' AND b.source = 'signup' AND a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1)
SELECT station_id, n, round(bias, 5) AS bias FROM ids LEFT JOIN p USING (station_id)""")
def m1_m4_pairs_without_overlap(spark, sf_dir):
    """Stations without a common valid day keep their row, with NULLs."""
    s = domain.station_series(spark, sf_dir)
    found = pairing.pair(s.filter("source = 'error'"), s.filter("source = 'signup'"), ["station_id", "time"]).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("s") - F.col("o")), 5).alias("bias"))
    return pairing.align_to(s.select("station_id").distinct(), found, "station_id")


@query(f"WITH {SQL_GRID}, p AS (SELECT ref, sim, cell, time, s, o FROM pairs WHERE NOT (sim = 'A' AND month(time) = 4)) SELECT ref, sim, count(*) AS n, round(avg(s - o), 4) AS bias FROM p GROUP BY 1, 2")
def m3_per_pair_mask(spark, sf_dir):
    sims, refs = sources(spark, sf_dir)
    holed = sims.withColumn("value", F.when(~F.expr("source = 'A' AND month(time) = 4"), F.col("value")))
    return pairing.pair(holed, refs).groupBy("ref", "sim").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("s") - F.col("o")), 4).alias("bias"))
