"""Queries over time, space, units, expressions and inventories (T, G, P, X, IO), with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import positions, units
from ..operators import grid, inventory, normalize, pairing, timeops
from ..sources import tables
from ..streaming import moments as streaming
from . import domain
from .domain import KEYS, SQL_GRID, SQL_STATIONS
from .stat_queries import rounded

QUERIES, SQL = {}, {}
BY = ["source", "cell"]


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def scratch(spark):
    """A new path in the folder that all executors see; a temporary one only where none is set and the session is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def orders(spark, sf_dir):
    return domain.table(spark, sf_dir, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp_ntz"))


# ---- samples of long series


@query("""WITH p AS (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)),
s AS (SELECT *, greatest(1, n // 200) AS step FROM p) SELECT o_orderpriority, o_orderkey, o_totalprice FROM s WHERE k % step = 0 AND k < step * 200""")
def v1_stride_sample(spark, sf_dir):
    """200 points of each priority's prices in order."""
    return positions.stride_sample(domain.table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice"), ["o_orderpriority"], ["o_totalprice", "o_orderkey"], positions.LIMITS["points"])


# ---- time


@query("""SELECT o_orderkey, (DATE '1990-01-31' + INTERVAL 1 MONTH * (o_orderkey % 200)::INT)::TIMESTAMP AS by_month, (TIMESTAMP '1990-01-01' + INTERVAL 1 HOUR * (o_orderkey % 5000)::INT) AS by_hour FROM orders""")
def t1_decode_offset(spark, sf_dir):
    n = F.col("o_orderkey")
    return orders(spark, sf_dir).select("o_orderkey", timeops.decode_offset(n % 200, "months", F.lit("1990-01-31").cast("date")).alias("by_month"), timeops.decode_offset(n % 5000, "hours", F.lit("1990-01-01").cast("date")).alias("by_hour"))


@query("""SELECT o_orderkey, date_trunc('day', o_orderdate)::TIMESTAMP AS full_date, date_trunc('month', o_orderdate)::TIMESTAMP AS year_month, make_date(1900 + (o_orderkey % 50)::INT, 1, 1)::TIMESTAMP + INTERVAL 1 SECOND * (round((0.5) * (CASE WHEN (1900 + (o_orderkey % 50)::INT) % 4 = 0 AND 1900 + (o_orderkey % 50)::INT <> 1900 THEN 366 ELSE 365 END) * 86400))::INT AS fraction FROM orders""")
def t2_decode_number(spark, sf_dir):
    t = F.col("t")
    as_number = lambda f: F.date_format(t, f).cast("double")
    return orders(spark, sf_dir).select("o_orderkey", timeops.decode_number(as_number("yyyyMMdd")).alias("full_date"), timeops.decode_number(as_number("yyyyMM")).alias("year_month"), timeops.decode_number(1900.5 + F.col("o_orderkey") % 50).alias("fraction"))


@query("""SELECT o_orderkey, make_date(year(o_orderdate)::INT, month(o_orderdate)::INT, least(30, day(last_day(o_orderdate)))::INT)::TIMESTAMP AS time FROM orders""")
def t3_other_calendar(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", timeops.decode_parts(F.year("t"), F.month("t"), F.lit(30)).alias("time"))


@query("""SELECT c % 2 AS file, sum(CASE WHEN c % 2 = 0 THEN k ELSE 2 * k END)::DOUBLE AS total FROM (SELECT DISTINCT month(o_orderdate) - 1 AS k FROM orders), (VALUES (0), (1)) AS v(c) GROUP BY 1""")
def t4_rescale_months(spark, sf_dir):
    k = orders(spark, sf_dir).select((F.month("t") - 1).alias("k")).distinct()
    files = k.select(F.lit(0).alias("file"), (F.col("k") * 3).alias("offset")).unionByName(k.select(F.lit(1).alias("file"), (F.col("k") * 2).alias("offset")))
    return timeops.rescale_months(files, "file", "offset").groupBy("file").agg(F.sum("offset").alias("total"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate - INTERVAL 1 MONTH WHEN 1 THEN o_orderdate - INTERVAL 15 DAY ELSE o_orderdate END::TIMESTAMP AS time FROM orders""")
def t5_time_offset(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    return orders(spark, sf_dir).select("o_orderkey", timeops.shift(F.col("t"), F.when(k == 0, -1).when(k == 1, -15), F.when(k == 0, "months").otherwise("days")).alias("time"))


@query("""SELECT o_orderkey, (date_trunc('month', o_orderdate) + INTERVAL 14 DAY)::TIMESTAMP AS month, (date_trunc('day', o_orderdate) + INTERVAL 12 HOUR)::TIMESTAMP AS day, date_trunc('year', o_orderdate)::TIMESTAMP AS year FROM orders""")
def t6_stamp(spark, sf_dir):
    return orders(spark, sf_dir).select("o_orderkey", *(timeops.stamp("t", r).alias(r) for r in ("month", "day", "year")))


@query("""SELECT o_custkey, (date_trunc('month', o_orderdate) + INTERVAL 14 DAY)::TIMESTAMP AS time, arg_min(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1, 2""")
def t7_first_per_stamp(spark, sf_dir):
    df = orders(spark, sf_dir).select("o_custkey", "o_orderkey", F.col("t").alias("time"), F.col("o_totalprice").alias("price"))
    return timeops.first_per_stamp(df, ["o_custkey"], "month", "o_orderkey").select("o_custkey", "time", "price")


SQL_AXIS = f"""{SQL_STATIONS}, ax AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-03-31', INTERVAL 1 DAY)) + INTERVAL 12 HOUR AS time),
ids AS (SELECT DISTINCT station_id FROM st WHERE source = 'view'), v AS (SELECT station_id, time + INTERVAL 12 HOUR AS time, value FROM st WHERE source = 'view')"""


def _daily(spark, sf_dir):
    s = domain.station_series(spark, sf_dir).filter("source = 'view'").select("station_id", timeops.stamp("time", "day").alias("time"), "value")
    return s, timeops.axis(spark, "2024-01-01", "2024-03-31", "day")


@query(f"WITH {SQL_AXIS} SELECT station_id, count(*) AS steps, count(value) AS present, round(sum(value), 4) AS total FROM ids, ax LEFT JOIN v USING (station_id, time) GROUP BY 1".replace("FROM ids, ax LEFT JOIN v USING (station_id, time)", "FROM (SELECT * FROM ids, ax) LEFT JOIN v USING (station_id, time)"))
def t8_t12_on_axis(spark, sf_dir):
    s, steps = _daily(spark, sf_dir)
    got = timeops.on_axis(s, ["station_id"], steps)
    return got.groupBy("station_id").agg(F.count(F.lit(1)).alias("steps"), F.count("value").alias("present"), F.round(F.sum("value"), 4).alias("total"))


@query(f"WITH {SQL_AXIS} SELECT station_id, time FROM (SELECT * FROM ids, ax) WHERE (station_id, time) NOT IN (SELECT station_id, time FROM v)")
def t9_missing(spark, sf_dir):
    s, steps = _daily(spark, sf_dir)
    return timeops.missing(s, ["station_id"], steps)


@query(f"WITH {SQL_GRID} SELECT source, cell, date_trunc('quarter', time)::TIMESTAMP AS time, round(sum(value), 2) AS value FROM series GROUP BY 1, 2, 3")
def t10_resample_sum(spark, sf_dir):
    return rounded(timeops.resample(domain.grid_series(spark, sf_dir), BY, "quarter", total=True), "value", digits=2)


@query(f"""WITH {SQL_GRID}, d AS (SELECT cell, (epoch(time) - epoch(lag(time) OVER (PARTITION BY cell ORDER BY time))) / 86400 AS d FROM wide)
SELECT cell, median(d)::DOUBLE AS days, CASE WHEN median(d) <= 1.5 THEN 'day' WHEN median(d) <= 10 THEN 'week' WHEN median(d) <= 45 THEN 'month' ELSE 'year' END AS resolution FROM d GROUP BY 1""")
def t11_infer_step(spark, sf_dir):
    return timeops.infer_step(domain.grid_wide(spark, sf_dir), ["cell"])


@query(f"""WITH {SQL_STATIONS}, t AS (SELECT DISTINCT station_id, source, time FROM st), d AS (SELECT station_id, source, (epoch(time) - epoch(lag(time) OVER (PARTITION BY station_id, source ORDER BY time))) / 86400 AS d FROM t)
SELECT station_id, source, median(d)::DOUBLE AS days, CASE WHEN median(d) <= 10 THEN 'week' WHEN median(d) <= 45 THEN 'month' ELSE 'year' END AS resolution FROM d GROUP BY 1, 2 HAVING median(d) > 1.5""")
def t11_refused(spark, sf_dir):
    """The series that are too coarse to be compared by day."""
    steps = timeops.infer_step(domain.station_series(spark, sf_dir), ["station_id", "source"])
    return timeops.upsampled(steps, "day")


#: Steps in hours, the class of each, and whether a weekly comparison refuses it.
STEPS = ((1, "hour", False), (2, "hour", False), (3, "day", False), (24, "day", False), (36, "day", False), (72, "week", False), (192, "week", False), (240, "week", False), (384, "month", True), (744, "month", True), (8760, "year", True))


@query(f"""SELECT p_partkey, CASE p_partkey % {len(STEPS)} {" ".join(f"WHEN {k} THEN round({h} / 24.0::DOUBLE, 9)" for k, (h, _, _) in enumerate(STEPS))} END::DOUBLE AS days, CASE p_partkey % {len(STEPS)} {" ".join(f"WHEN {k} THEN '{r}'" for k, (_, r, _) in enumerate(STEPS))} END AS resolution,
  CASE p_partkey % {len(STEPS)} {" ".join(f"WHEN {k} THEN {str(u).upper()}" for k, (_, _, u) in enumerate(STEPS))} END AS refused FROM part""")
def t11_step_classes(spark, sf_dir):
    """A series of eight steps per part."""
    hours = F.element_at(F.array(*(F.lit(h) for h, _, _ in STEPS)), (F.col("p_partkey") % len(STEPS) + 1).cast("int"))
    times = domain.table(spark, sf_dir, "part").select("p_partkey").repartition(max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))), "p_partkey").select("p_partkey", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k"), hours.alias("h")).select("p_partkey", F.timestamp_seconds(F.lit(946684800) + F.col("k") * F.col("h") * 3600).alias("time"))
    steps = timeops.infer_step(times, ["p_partkey"])
    return steps.join(timeops.upsampled(steps, "week").select("p_partkey", F.lit(True).alias("r")), "p_partkey", "left").select("p_partkey", F.round("days", 9).alias("days"), "resolution", F.coalesce("r", F.lit(False)).alias("refused"))


SQL_KINDS = f"""{SQL_GRID}, kinds AS (SELECT v AS variable, u AS unit, cell, time, value FROM series, (VALUES ('Precipitation', ' MM '), ('Total_Runoff', 'mm day-1'), ('price', 'mm')) AS k(v, u) WHERE source = 'R')"""


@query(f"WITH {SQL_KINDS} SELECT variable, unit, cell, date_trunc('quarter', time)::TIMESTAMP AS time, round(CASE WHEN variable = 'Precipitation' THEN sum(value) ELSE avg(value) END, 2) AS value FROM kinds GROUP BY 1, 2, 3, 4")
def t10_resample_by_kind(spark, sf_dir):
    named = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), F.lit(u).alias("unit")) for v, u in (("Precipitation", " MM "), ("Total_Runoff", "mm day-1"), ("price", "mm")))))
    series = domain.grid_series(spark, sf_dir).filter("source = 'R'").drop("variable").withColumn("k", named).select("cell", "time", "value", "k.variable", "k.unit")
    return rounded(timeops.resample_by_kind(series, ["cell"], "quarter"), "value", digits=2)


@query(f"""WITH {SQL_STATIONS}, x AS (SELECT station_id || '-' || source AS series, time FROM st UNION ALL SELECT 'grid-' || s_nationkey, date_trunc('month', l_shipdate) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
g AS (SELECT series, count(DISTINCT time) AS n, (epoch(max(time)) - epoch(min(time))) / 3600 AS span FROM x GROUP BY 1), h AS (SELECT series, n, span / nullif(n - 1, 0) AS h FROM g)
SELECT series, n, CASE WHEN n <= 1 THEN NULL WHEN h > 22 AND h < 26 THEN 'day' WHEN h > 168 AND h < 216 THEN '8day' WHEN h >= 672 AND h <= 768 THEN 'month' WHEN h > 8040 AND h < 9480 THEN 'year' END AS resolution FROM h""")
def t15_resolution_by_span(spark, sf_dir):
    stations = domain.station_series(spark, sf_dir).select(F.concat_ws("-", "station_id", "source").alias("series"), "time")
    cells = domain.grid_wide(spark, sf_dir).select(F.concat(F.lit("grid-"), "cell").alias("series"), "time")
    return timeops.resolution_by_span(stations.unionByName(cells), ["series"])


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'hour' WHEN 1 THEN 'month' WHEN 2 THEN 'day' WHEN 3 THEN 'month' END AS resolution FROM part""")
def t15_resolution_by_name(spark, sf_dir):
    k = F.col("p_partkey")
    names = F.array(*map(F.lit, ("/d/gpp_3_HR.nc", "/day/x-Monthly-mean.nc", "/d/daily.nc", "/d/mon_of_day.nc", "/d/holiday_monitor.nc")))
    return domain.table(spark, sf_dir, "part").select("p_partkey", timeops.resolution_by_name(F.element_at(names, (k % 5 + 1).cast("int"))).alias("resolution"))


@query(f"""WITH {SQL_GRID}, r AS (SELECT cell AS ref, month(time) AS m FROM wide GROUP BY 1, 2), s AS (SELECT cell AS sim, month(time) AS m FROM wide WHERE (cell <> 1 OR month(time) < 12) AND (cell <> 2 OR month(time) = 7) GROUP BY 1, 2),
ra AS (SELECT ref, list(m ORDER BY m) AS a FROM r WHERE ref <> 2 OR m = 7 GROUP BY 1), sa AS (SELECT sim, list(m ORDER BY m) AS b FROM s GROUP BY 1)
SELECT ref::VARCHAR AS ref, sim::VARCHAR AS sim, len(a) AS points, name, CASE WHEN len(a) <> len(b) THEN 'axes of other lengths' WHEN a <> b THEN 'other dates' WHEN name = 'APFB' THEN 'not defined for a climatology' WHEN name = 'KGE' AND len(a) < 2 THEN 'needs two points in time' END AS finding FROM ra, sa, (VALUES ('bias'), ('KGE'), ('APFB')) AS n(name)""")
def t19_climatology_gate(spark, sf_dir):
    """Climatologies of all cells as references and, with months left out, as sims."""
    w = domain.grid_wide(spark, sf_dir).select(F.col("cell").cast("string").alias("source"), F.make_date(F.lit(2000), F.month("time"), F.lit(15)).alias("time"), F.month("time").alias("m"))
    refs, sims = w.filter("source <> '2' OR m = 7"), w.filter("(source <> '1' OR m < 12) AND (source <> '2' OR m = 7)")
    return timeops.climatology_gate(refs, sims, ["bias", "KGE", "APFB"])


@query("""SELECT o_custkey, greatest(1996, min(year(o_orderdate))) AS first, least(2000, max(year(o_orderdate))) AS last FROM orders GROUP BY 1""")
def t13_use_years(spark, sf_dir):
    span = orders(spark, sf_dir).groupBy("o_custkey").agg(F.min(F.year("t")).alias("a"), F.max(F.year("t")).alias("b"))
    a, b = timeops.use_years((F.lit(1996), F.lit(2000)), (F.col("a"), F.col("b")), (F.lit(1900), F.lit(2100)))
    return span.select("o_custkey", a.cast("long").alias("first"), b.cast("long").alias("last"))


@query("""SELECT CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'DJF' WHEN month(o_orderdate) <= 5 THEN 'MAM' WHEN month(o_orderdate) <= 8 THEN 'JJA' ELSE 'SON' END AS season, year(o_orderdate) + (month(o_orderdate) >= 10)::INT AS water_year, count(*) AS n FROM orders GROUP BY 1, 2""")
def t14_t16_season_and_water_year(spark, sf_dir):
    return orders(spark, sf_dir).groupBy(timeops.season("t").alias("season"), timeops.water_year("t", 10).cast("long").alias("water_year")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_GRID}, c AS (SELECT cell, year(time) AS y, count(DISTINCT time) AS n FROM wide GROUP BY 1, 2) SELECT cell || '-' || y AS file, n, CASE WHEN n BETWEEN 10 AND 13 THEN 'month' END AS resolution FROM c")
def t15_resolution_by_count(spark, sf_dir):
    w = domain.grid_wide(spark, sf_dir).withColumn("file", F.concat_ws("-", "cell", F.year("time")))
    return timeops.resolution_by_count(w, "file")


@query("""WITH x AS (SELECT 'm' || strftime(o_orderdate, '%Y%m') || '-' || (o_custkey % 3) AS file, date_trunc('day', o_orderdate)::TIMESTAMP AS time, 'month' AS kind, NULL AS units, NULL::DOUBLE AS step FROM orders
UNION ALL SELECT 'd' || strftime(ts, '%Y%m%d'), date_trunc('hour', ts)::TIMESTAMP, 'day', NULL, NULL FROM events
UNION ALL SELECT 'p' || p_partkey, TIMESTAMP '2000-01-01' + INTERVAL 1 HOUR * k, CASE WHEN p_partkey % 2 = 0 THEN 'year' ELSE 'month' END, CASE WHEN p_partkey % 5 < 3 THEN 'Months since 2000-01-01' ELSE 'days since 2000-01-01' END, (p_partkey % 4) + 0.15 * (p_partkey % 3)
  FROM part, range(8761) AS r(k) WHERE k < CASE p_partkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 12 WHEN 2 THEN 31 WHEN 3 THEN 365 WHEN 4 THEN 700 WHEN 5 THEN 14 ELSE 8100 END),
c AS (SELECT file, count(DISTINCT time) AS n, max(kind) AS kind, max(lower(units)) AS u, max(step) AS s FROM x GROUP BY 1)
SELECT file, n, CASE WHEN u LIKE '%month%' THEN CASE WHEN kind = 'year' AND n BETWEEN 10 AND 13 OR abs(s - 1) < 0.2 THEN 'month' WHEN s > 1.5 AND abs(s - round(s)) < 0.2 THEN round(s)::INT || 'month' ELSE 'month' END
  WHEN kind = 'year' THEN CASE WHEN n BETWEEN 10 AND 13 THEN 'month' WHEN n BETWEEN 350 AND 370 THEN 'day' WHEN n BETWEEN 8000 AND 9000 THEN 'hour' END
  WHEN kind = 'month' THEN CASE WHEN n BETWEEN 27 AND 32 THEN 'day' WHEN n BETWEEN 650 AND 750 THEN 'hour' WHEN n = 1 THEN 'month' END
  WHEN n BETWEEN 20 AND 25 THEN 'hour' WHEN n = 1 THEN 'day' END AS resolution FROM c""")
def t15_resolution_by_count_and_kind(spark, sf_dir):
    """Files of a month of orders, of a day of events, and of a number of steps that the part's key gives."""
    none = [F.lit(None).cast("string").alias("units"), F.lit(None).cast("double").alias("step")]
    months = orders(spark, sf_dir).select(F.concat(F.lit("m"), F.date_format("t", "yyyyMM"), F.lit("-"), F.col("o_custkey") % 3).alias("file"), F.date_trunc("day", "t").cast("timestamp_ntz").alias("time"), F.lit("month").alias("kind"), *none)
    days = domain.table(spark, sf_dir, "events").select(F.concat(F.lit("d"), F.date_format("ts", "yyyyMMdd")).alias("file"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), F.lit("day").alias("kind"), *none)
    k = F.col("p_partkey")
    many = F.element_at(F.array(*map(F.lit, (1, 12, 31, 365, 700, 14, 8100))), (k % 7 + 1).cast("int"))
    # a part has few bytes but up to 8100 steps, so parts are dealt to all tasks before
    part = domain.table(spark, sf_dir, "part").select(k, many.alias("many")).repartition(max(64, int(spark.conf.get("spark.sql.shuffle.partitions"))), k).select(
        F.concat(F.lit("p"), k).alias("file"), F.when(k % 2 == 0, "year").otherwise("month").alias("kind"), F.when(k % 5 < 3, "Months since 2000-01-01").otherwise("days since 2000-01-01").alias("units"),
        (k % 4 + F.lit(0.15) * (k % 3)).cast("double").alias("step"), F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("h"),
    ).withColumn("time", F.timestamp_seconds(F.lit(946684800) + F.col("h") * 3600).cast("timestamp_ntz")).drop("h")
    return timeops.resolution_by_count(months.unionByName(days).unionByName(part), "file", files="kind", units="units", step="step")


@query(f"WITH {SQL_GRID} SELECT source, cell, round(sum(value * day(last_day(time))) / sum(day(last_day(time))), 4) AS value FROM series GROUP BY 1, 2")
def t17_annual_climatology(spark, sf_dir):
    return rounded(timeops.annual_climatology(domain.grid_series(spark, sf_dir), BY), "value")


@query(f"WITH {SQL_GRID} SELECT source, cell, month(time) AS month, round(sum(value * day(last_day(time))) / sum(day(last_day(time))), 4) AS value FROM series GROUP BY 1, 2, 3")
def t18_monthly_climatology(spark, sf_dir):
    return rounded(timeops.monthly_climatology(domain.grid_series(spark, sf_dir), BY).withColumn("month", F.col("month").cast("long")), "value")


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-12-31 23:59:59'")
def p9_year_filter(spark, sf_dir):
    return timeops.years(orders(spark, sf_dir), 1997, 1998, "o_orderdate").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""WITH {SQL_GRID}, d AS (SELECT source, cell, value, lag(value) OVER (PARTITION BY source, cell ORDER BY time) AS b FROM series)
SELECT source, cell, count(*) FILTER (b IS NOT NULL) AS n, round(sum(value - b), 6) AS total FROM d GROUP BY 1, 2""")
def p15_storage_change(spark, sf_dir):
    got = timeops.storage_change(domain.grid_series(spark, sf_dir), BY, "price")
    return got.groupBy(*BY).agg(F.count("value").alias("n"), F.round(F.sum("value"), 6).alias("total"))


# ---- units and expressions


@query("""SELECT l_orderkey, l_linenumber, round(l_discount * 100 / 100, 6) AS value, 'unitless' AS unit, round((l_quantity - 32) * 5 / 9 + 273.15, 6) AS kelvin, round(l_quantity / day(last_day(l_shipdate)), 6) AS per_day, round(l_quantity * CASE WHEN year(l_shipdate) % 4 = 0 AND (year(l_shipdate) % 100 <> 0 OR year(l_shipdate) % 400 = 0) THEN 366 ELSE 365 END, 4) AS per_year FROM lineitem""")
def p6_p7_units(spark, sf_dir):
    t = F.col("l_shipdate")
    raw = domain.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 100).alias("value"), F.lit(" Percent ").alias("unit"), units.to_base(F.col("l_quantity"), F.lit("degF")).alias("kelvin"), units.to_base(F.col("l_quantity"), F.lit("mm month-1"), t).alias("per_day"), units.per_day_to_per_year(F.col("l_quantity"), t).alias("per_year"))
    return rounded(rounded(units.normalise(raw, time=None), "value", "kelvin", "per_day", digits=6), "per_year")


@query("SELECT o_orderkey, round(o_totalprice * 12.011 + o_custkey, 6) AS value, 'usd' AS unit FROM orders")
def p1_p5_select_variable(spark, sf_dir):
    raw = domain.table(spark, sf_dir, "orders").withColumnRenamed("o_totalprice", "TotalPrice")
    got = normalize.select_variable(raw, "price", [{"varname": "absent", "unit": "x"}, {"varname": "totalprice", "unit": "usd", "convert": "value * 12.011 + o_custkey"}], ["o_orderkey", "o_custkey"])
    return rounded(got.drop("o_custkey"), "value", digits=6)


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 7) AS value FROM lineitem")
def p2_derive(spark, sf_dir):
    got = normalize.derive(domain.table(spark, sf_dir, "lineitem"), "net = l_extendedprice * (1 - l_discount); if absent: net = absent; net * (1 + l_tax)")
    return rounded(got.select("l_orderkey", "l_linenumber", "value"), "value", digits=7)


@query("SELECT l_orderkey, l_linenumber, l_tax AS level1, round((l_quantity * l_discount + l_extendedprice * l_tax) / nullif(l_discount + l_tax, 0), 7) AS mean FROM lineitem")
def p3_p4_levels(spark, sf_dir):
    raw = domain.table(spark, sf_dir, "lineitem").withColumns({"v": F.array("l_quantity", "l_extendedprice"), "w": F.array("l_discount", "l_tax")})
    got = normalize.over_levels(normalize.at_level(raw, "w", 1, "level1"), "v", "w", "mean")
    return rounded(got.select("l_orderkey", "l_linenumber", "level1", "mean"), "mean", digits=7)


@query("SELECT l_orderkey, round(sum(l_extendedprice * l_discount) / nullif(sum(l_discount), 0), 7) AS value FROM lineitem GROUP BY 1")
def p8_patches(spark, sf_dir):
    raw = domain.table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("value"), F.col("l_discount").alias("fraction"))
    return rounded(normalize.over_patches(raw, ["l_orderkey"]), "value", digits=7)


@query("SELECT count(*) AS n, round(sum(o_totalprice), 2) AS value FROM orders WHERE o_custkey % 10 <> 3")
def p14_finite_mask(spark, sf_dir):
    raw = domain.table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 20 == 3, F.lit(-999.0)).when(F.col("o_custkey") % 20 == 13, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("v"))
    return normalize.select_variable(raw, "v", [], ["o_orderkey"], sentinels=[-999.0]).agg(F.count("value").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("SELECT n_nationkey, -60.0 + 30.0 * (n_nationkey % 5)::DOUBLE AS lat, ((n_nationkey * 15.0)::DOUBLE + 180) % 360 - 180 AS lon FROM nation")
def p11_p12_coordinates(spark, sf_dir):
    raw = domain.table(spark, sf_dir, "nation").select("n_nationkey", domain.lat("n_nationkey").alias("Latitude"), (F.col("n_nationkey") * 15.0).alias("LON"), F.lit("s").alias("source"))
    return grid.wrap_longitude(normalize.rename_coordinates(raw), ["source"]).select("n_nationkey", "lat", "lon")


@query("SELECT n_nationkey, CASE WHEN n_nationkey * 15.0 BETWEEN -180 AND 180 THEN n_nationkey * 15.0 WHEN n_nationkey * 15.0 - 360 BETWEEN -180 AND 180 THEN n_nationkey * 15.0 - 360 END::DOUBLE AS lon FROM nation")
def p13_longitude_in(spark, sf_dir):
    return domain.table(spark, sf_dir, "nation").select("n_nationkey", grid.longitude_in(F.col("n_nationkey") * 15.0, -180, 180).alias("lon"))


@query("SELECT n_nationkey AS cell FROM nation WHERE -60 + 30 * (n_nationkey % 5) BETWEEN -31 AND 31 AND -144 + 72 * (n_nationkey // 5) BETWEEN -1 AND 145")
def p10_domain(spark, sf_dir):
    cells = domain.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell"))
    return grid.domain(cells.select("cell", domain.lat(), domain.lon()), (-30, 30), (0, 144)).select("cell")


@query("SELECT count(*) AS n FROM orders WHERE o_totalprice > 100000")
def u1_user_filter(spark, sf_dir):
    normalize.register_filter("Large", lambda df: df.filter("o_totalprice > 100000"))
    return normalize.apply_filter(domain.table(spark, sf_dir, "orders"), "Large_v2.1").agg(F.count(F.lit(1)).alias("n"))


# ---- space: orders on a 20 x 40 grid of 9 x 9 degrees


def fine(spark, sf_dir):
    o = domain.table(spark, sf_dir, "orders")
    cells = o.groupBy((F.col("o_orderkey") % 20).cast("int").alias("i_lat"), (F.col("o_custkey") % 40).cast("int").alias("i_lon")).agg(F.avg("o_totalprice").alias("value"))
    return cells.withColumns({"lat": -90 + 4.5 + F.col("i_lat") * 9.0, "lon": -180 + 4.5 + F.col("i_lon") * 9.0})


def axes(spark, step):
    return grid.axis(spark, -90, 90, step, "lat"), grid.axis(spark, -180, 180, step, "lon")


SQL_FINE = """fine AS (SELECT (o_orderkey % 20)::INT AS i_lat, (o_custkey % 40)::INT AS i_lon, avg(o_totalprice) AS value FROM orders GROUP BY 1, 2),
fi AS (SELECT *, -85.5 + i_lat * 9.0 AS lat, -175.5 + i_lon * 9.0 AS lon FROM fine)"""


@query(f"""WITH {SQL_FINE} SELECT i::INT AS i_lat, (-90 + 7.5 + 15.0 * i)::DOUBLE AS lat, count(value) AS n, round(sum(value), 2) AS total FROM range(12) AS r(i) LEFT JOIN fi ON floor((lat + 90) / 15) = i GROUP BY 1, 2""")
def g1_target_axis(spark, sf_dir):
    """What of the fine grid lies in each cell of the target axis."""
    cells = fine(spark, sf_dir).select(F.floor((F.col("lat") + 90) / 15).cast("int").alias("i_lat"), "value")
    return rounded(grid.axis(spark, -90, 90, 15.0, "lat").join(cells, "i_lat", "left").groupBy("i_lat", "lat").agg(F.count("value").alias("n"), F.sum("value").alias("total")), "total", digits=2)


SQL_WEIGHTS = """la AS (SELECT s.i AS i_lat, t.i AS t_lat, sin(radians(least(-81 + 9.0 * s.i, -75 + 15.0 * t.i))) - sin(radians(greatest(-90 + 9.0 * s.i, -90 + 15.0 * t.i))) AS w FROM range(20) s(i), range(12) t(i) WHERE -90 + 9.0 * s.i < -75 + 15.0 * t.i AND -90 + 15.0 * t.i < -81 + 9.0 * s.i),
lo AS (SELECT s.i AS i_lon, t.i AS t_lon, least(-171 + 9.0 * s.i, -165 + 15.0 * t.i)::DOUBLE - greatest(-180 + 9.0 * s.i, -180 + 15.0 * t.i)::DOUBLE AS w FROM range(40) s(i), range(24) t(i) WHERE -180 + 9.0 * s.i < -165 + 15.0 * t.i AND -180 + 15.0 * t.i < -171 + 9.0 * s.i),
la2 AS (SELECT i_lat, t_lat, w / sum(w) OVER (PARTITION BY t_lat) AS wa FROM la), lo2 AS (SELECT i_lon, t_lon, w / sum(w) OVER (PARTITION BY t_lon) AS wo FROM lo)"""


@query(f"""WITH {SQL_FINE}, {SQL_WEIGHTS} SELECT t_lat::INT AS i_lat, t_lon::INT AS i_lon, CASE WHEN sum(wa * wo) >= 0.5 - 1e-12 THEN round(sum(wa * wo * value) / sum(wa * wo), 3) END AS value FROM fi JOIN la2 USING (i_lat) JOIN lo2 USING (i_lon) GROUP BY 1, 2""")
def g2_conservative(spark, sf_dir):
    (lat, lon), (tlat, tlon) = axes(spark, 9.0), axes(spark, 15.0)
    got = grid.conservative(fine(spark, sf_dir).select("i_lat", "i_lon", "value"), grid.overlap_weights(lat, tlat, "lat", latitude=True), grid.overlap_weights(lon, tlon, "lon"), [], nan_threshold=0.5)
    return rounded(got, "value", digits=3)


@query(f"""WITH {SQL_FINE}, p AS (SELECT lat, lon, value FROM fi UNION ALL SELECT CASE i_lat WHEN 0 THEN -90 ELSE 90 END, lon, avg(value) OVER (PARTITION BY i_lat) FROM fi WHERE i_lat IN (0, 19)),
q AS (SELECT * FROM p UNION ALL SELECT lat, lon + 360, value FROM p WHERE lon + 360 <= 190 UNION ALL SELECT lat, lon - 360, value FROM p WHERE lon - 360 >= -190)
SELECT lat::DOUBLE AS lat, count(*) AS n, round(sum(value), 2) AS total FROM q GROUP BY 1""")
def g3_padding(spark, sf_dir):
    padded = grid.pad_date_line(grid.pad_poles(fine(spark, sf_dir).select("lat", "lon", "value"), [], 9.0), 10.0)
    return padded.groupBy("lat").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query(f"""WITH {SQL_FINE}, la AS (SELECT t.i AS t_lat, floor((-82.5 + 15.0 * t.i + 85.5) / 9)::INT AS a, (-82.5 + 15.0 * t.i + 85.5) / 9 - floor((-82.5 + 15.0 * t.i + 85.5) / 9) AS f FROM range(12) t(i)),
lo AS (SELECT t.i AS t_lon, floor((-172.5 + 15.0 * t.i + 175.5) / 9)::INT AS a, (-172.5 + 15.0 * t.i + 175.5) / 9 - floor((-172.5 + 15.0 * t.i + 175.5) / 9) AS f FROM range(24) t(i)),
la2 AS (SELECT t_lat, a AS i_lat, 1 - f AS wa FROM la UNION ALL SELECT t_lat, a + 1, f FROM la WHERE f > 0), lo2 AS (SELECT t_lon, a AS i_lon, 1 - f AS wo FROM lo UNION ALL SELECT t_lon, a + 1, f FROM lo WHERE f > 0)
SELECT t_lat::INT AS i_lat, t_lon::INT AS i_lon, CASE WHEN sum(wa * wo) >= 1 - 1e-9 THEN round(sum(wa * wo * value), 3) END AS value FROM fi JOIN la2 USING (i_lat) JOIN lo2 USING (i_lon) WHERE wa > 0 AND wo > 0 GROUP BY 1, 2""")
def g4_bilinear(spark, sf_dir):
    (lat, lon), (tlat, tlon) = axes(spark, 9.0), axes(spark, 15.0)
    got = grid.interpolate(fine(spark, sf_dir).select("i_lat", "i_lon", "value"), grid.linear_weights(lat, tlat, "lat"), grid.linear_weights(lon, tlon, "lon"), [])
    return rounded(got, "value", digits=3)


@query(f"""WITH {SQL_FINE}, la AS (SELECT t.i AS t_lat, arg_min(s.i, (abs(-85.5 + 9.0 * s.i - (-82.5 + 15.0 * t.i)), s.i)) AS i_lat FROM range(20) s(i), range(12) t(i) GROUP BY 1),
lo AS (SELECT t.i AS t_lon, arg_min(s.i, (abs(-175.5 + 9.0 * s.i - (-172.5 + 15.0 * t.i)), s.i)) AS i_lon FROM range(40) s(i), range(24) t(i) GROUP BY 1)
SELECT t_lat::INT AS i_lat, t_lon::INT AS i_lon, round(value, 3) AS value FROM fi JOIN la USING (i_lat) JOIN lo USING (i_lon)""")
def g5_nearest(spark, sf_dir):
    (lat, lon), (tlat, tlon) = axes(spark, 9.0), axes(spark, 15.0)
    got = grid.interpolate(fine(spark, sf_dir).select("i_lat", "i_lon", "value"), grid.nearest_weights(lat, tlat, "lat"), grid.nearest_weights(lon, tlon, "lon"), [])
    return rounded(got, "value", digits=3)


#: What each of 20 latitudes from -85.5 by 9 counts for at 12 from -82.5 by 15, as rows (source, target, weight).
CUBIC = ", ".join(f"({i}, {k}, {w!r})" for k, row in enumerate(grid.cubic_matrix([-85.5 + 9.0 * i for i in range(20)], [-82.5 + 15.0 * k for k in range(12)]).tolist()) for i, w in enumerate(row))


@query(f"""WITH {SQL_FINE}, w(i_lat, k, w) AS (VALUES {CUBIC}), t AS (SELECT i_lon, k, count(value) AS n, sum(w * value) AS v FROM fi JOIN w USING (i_lat) GROUP BY 1, 2)
SELECT i_lon, -82.5 + 15.0 * k AS lat, CASE WHEN n = 20 THEN round(v, 3) END AS value FROM t""")
def g6_cubic(spark, sf_dir):
    got = grid.cubic_axis(fine(spark, sf_dir), [-82.5 + 15.0 * k for k in range(12)], ["i_lon"], "lat")
    return rounded(got, "value", digits=3)


@query(f"""WITH {SQL_FINE} SELECT floor((lat + 90) / 18)::INT AS i_lat, floor((lon + 180) / 18)::INT AS i_lon, round(median(value), 3) AS value FROM fi GROUP BY 1, 2""")
def g7_g10_zonal(spark, sf_dir):
    return rounded(grid.zonal(fine(spark, sf_dir), 18.0, [], "median"), "value", digits=3)


SQL_MESH = """m AS (SELECT (k // 25)::INT AS i, (k % 25)::INT AS j, 0.9 * (k // 25) + 0.2 * (k % 25) + 0.03 * (k * 7 % 5) AS lat, 1.1 * (k % 25) - 0.15 * (k // 25) + 0.02 * (k * 11 % 7) AS lon,
  CASE WHEN k % 41 <> 7 THEN v END AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer) WHERE k % 97 <> 50)"""


@query(f"""WITH {SQL_MESH}, b AS (SELECT DISTINCT i - di AS i, j - dj AS j FROM m, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS x(di, dj)),
q AS (SELECT m0 AS a, m1 AS b, m2 AS c, m3 AS d FROM b LEFT JOIN m m0 ON m0.i = b.i AND m0.j = b.j LEFT JOIN m m1 ON m1.i = b.i AND m1.j = b.j + 1 LEFT JOIN m m2 ON m2.i = b.i + 1 AND m2.j = b.j LEFT JOIN m m3 ON m3.i = b.i + 1 AND m3.j = b.j + 1),
r AS (SELECT *, a.i IS NOT NULL AND b.i IS NOT NULL AND c.i IS NOT NULL AND d.i IS NOT NULL AS whole,
  (b.lon - a.lon) * (c.lon - a.lon) + (b.lat - a.lat) * (c.lat - a.lat) AS dot_a, abs((b.lon - a.lon) * (c.lat - a.lat) - (b.lat - a.lat) * (c.lon - a.lon)) AS cross_a,
  (b.lon - d.lon) * (c.lon - d.lon) + (b.lat - d.lat) * (c.lat - d.lat) AS dot_d, abs((b.lon - d.lon) * (c.lat - d.lat) - (b.lat - d.lat) * (c.lon - d.lon)) AS cross_d FROM q),
t AS (SELECT a AS x, b AS y, c AS z FROM r WHERE whole AND cross_a * dot_d + cross_d * dot_a >= 0 UNION ALL SELECT d, c, b FROM r WHERE whole AND cross_a * dot_d + cross_d * dot_a >= 0
  UNION ALL SELECT a, b, d FROM r WHERE whole AND cross_a * dot_d + cross_d * dot_a < 0 UNION ALL SELECT a, d, c FROM r WHERE whole AND cross_a * dot_d + cross_d * dot_a < 0
  UNION ALL SELECT a, b, c FROM r WHERE d.i IS NULL AND a.i IS NOT NULL AND b.i IS NOT NULL AND c.i IS NOT NULL UNION ALL SELECT a, b, d FROM r WHERE c.i IS NULL AND a.i IS NOT NULL AND b.i IS NOT NULL AND d.i IS NOT NULL
  UNION ALL SELECT a, d, c FROM r WHERE b.i IS NULL AND a.i IS NOT NULL AND c.i IS NOT NULL AND d.i IS NOT NULL UNION ALL SELECT d, c, b FROM r WHERE a.i IS NULL AND b.i IS NOT NULL AND c.i IS NOT NULL AND d.i IS NOT NULL),
o AS (SELECT min(lat) AS o_lat, min(lon) AS o_lon, max(lat) AS m_lat, max(lon) AS m_lon FROM m),
la AS (SELECT unnest(range(0, ((m_lat - o_lat) / 0.7)::INT + 2)) AS i_lat, o_lat FROM o), lo AS (SELECT unnest(range(0, ((m_lon - o_lon) / 0.7)::INT + 2)) AS i_lon, o_lon FROM o),
p AS (SELECT i_lat, i_lon, o_lat + 0.7 * i_lat AS lat, o_lon + 0.7 * i_lon AS lon FROM la, lo),
h AS (SELECT i_lat, i_lon, x, y, z, (y.lon - x.lon) * (z.lat - x.lat) - (y.lat - x.lat) * (z.lon - x.lon) AS whole, p.lat, p.lon FROM p, t
  WHERE p.lat BETWEEN least(x.lat, y.lat, z.lat) AND greatest(x.lat, y.lat, z.lat) AND p.lon BETWEEN least(x.lon, y.lon, z.lon) AND greatest(x.lon, y.lon, z.lon)),
s AS (SELECT i_lat, i_lon, x.v AS vx, y.v AS vy, z.v AS vz, ((y.lon - lon) * (z.lat - lat) - (y.lat - lat) * (z.lon - lon)) / whole AS wx, ((z.lon - lon) * (x.lat - lat) - (z.lat - lat) * (x.lon - lon)) / whole AS wy, ((x.lon - lon) * (y.lat - lat) - (x.lat - lat) * (y.lon - lon)) / whole AS wz FROM h)
SELECT i_lat::INT AS i_lat, i_lon::INT AS i_lon, round(avg(wx * vx + wy * vy + wz * vz), 4) AS value FROM s WHERE least(wx, wy, wz) >= -1e-9 GROUP BY 1, 2""")
def g10_linear_mesh(spark, sf_dir):
    """Balances of customers on a bent grid with holes, by linear interpolation on a regular one."""
    k = F.col("c_custkey")
    i, j = F.floor(k / 25).cast("int"), (k % 25).cast("int")
    mesh = domain.table(spark, sf_dir, "customer").filter(k % 97 != 50).select(
        i.alias("i"), j.alias("j"), (0.9 * i + 0.2 * j + 0.03 * (k * 7 % 5)).alias("lat"), (1.1 * j - 0.15 * i + 0.02 * (k * 11 % 7)).alias("lon"), F.when(k % 41 != 7, F.col("c_acctbal")).alias("value")
    )
    return rounded(grid.on_mesh(mesh, grid.mesh_weights(grid.mesh_triangles(mesh), 0.7), []), "value")


@query("""WITH c AS (SELECT (o_custkey % 40)::INT AS block, (o_orderkey % 7)::INT AS value, count(*) AS n FROM orders WHERE o_orderkey % 7 < 5 GROUP BY 1, 2) SELECT block, arg_max(value, (n, -value)) AS value FROM c GROUP BY 1""")
def g8_most_common(spark, sf_dir):
    o = domain.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).cast("int").alias("block"), (F.col("o_orderkey") % 7).cast("int").alias("value"))
    return grid.most_common(o, ["block"], [0, 1, 2, 3, 4])


@query("""WITH b AS (SELECT DISTINCT (o_custkey % 300)::INT AS block FROM orders), c AS (SELECT (o_custkey % 300)::INT AS block, (o_orderkey % 7)::INT AS value, count(*) AS n FROM orders GROUP BY 1, 2),
e AS (SELECT block, v::INT AS value, coalesce(n, 0) AS n FROM (SELECT * FROM b, range(5) AS r(v)) LEFT JOIN c ON c.block = block AND c.value = v) SELECT block, arg_min(value, (n, value)) AS value FROM e GROUP BY 1""".replace("(SELECT * FROM b, range(5) AS r(v)) LEFT JOIN c ON c.block = block AND c.value = v", "(SELECT * FROM b, range(5) AS r(v)) LEFT JOIN (SELECT block, value AS v, n FROM c) USING (block, v)"))
def g9_least_common(spark, sf_dir):
    o = domain.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 300).cast("int").alias("block"), (F.col("o_orderkey") % 7).cast("int").alias("value"))
    return grid.most_common(o, ["block"], [0, 1, 2, 3, 4], least=True)


SQL_PLACES = """pl AS (SELECT s_suppkey AS station_id, -80 + (s_suppkey * 37 % 1600) / 10.0 AS lat, -170 + (s_suppkey * 53 % 3400) / 10.0 AS lon FROM supplier)"""


def places(spark, sf_dir):
    k = F.col("s_suppkey")
    return domain.table(spark, sf_dir, "supplier").select(k.alias("station_id"), (-80 + (k * 37 % 1600) / 10.0).alias("lat"), (-170 + (k * 53 % 3400) / 10.0).alias("lon"))


@query(f"""WITH {SQL_FINE}, {SQL_PLACES}, c AS (SELECT station_id, floor((lat + 90) / 9)::INT AS i_lat, floor((lon + 180) / 9)::INT AS i_lon FROM pl WHERE (lat + 90) % 9 <> 0 AND (lon + 180) % 9 <> 0)
SELECT station_id, round(value, 3) AS value FROM fi JOIN c USING (i_lat, i_lon)""")
def g11_at_stations(spark, sf_dir):
    lat, lon = axes(spark, 9.0)
    edge = "(lat + 90) % 9 <> 0 AND (lon + 180) % 9 <> 0"
    got = grid.at_stations(fine(spark, sf_dir).select("i_lat", "i_lon", "value"), places(spark, sf_dir).filter(edge), lat, lon, 9.0)
    return rounded(got.select("station_id", "value"), "value", digits=3)


@query(f"""WITH {SQL_PLACES}, a AS (SELECT station_id AS sim_id, lat, lon FROM pl WHERE station_id % 2 = 0), b AS (SELECT station_id AS ref_id, lat + 0.7 AS lat, lon FROM pl WHERE station_id % 2 = 1),
d AS (SELECT sim_id, ref_id, sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2) AS d FROM a, b) SELECT sim_id, arg_min(ref_id, (d, ref_id)) AS ref_id, round(min(d), 6) AS distance FROM d WHERE d <= 30 GROUP BY 1""")
def g12_match_stations(spark, sf_dir):
    p = places(spark, sf_dir)
    got = grid.match_stations(p.filter("station_id % 2 = 0"), p.filter("station_id % 2 = 1").withColumn("lat", F.col("lat") + 0.7), radius=30.0)
    return rounded(got, "distance", digits=6)


@query(f"""WITH y AS (SELECT o_custkey AS station_id, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders GROUP BY 1)
SELECT station_id, greatest(a, 1996) AS use_syear, least(b, 2000) AS use_eyear FROM y WHERE least(b, 2000) - greatest(a, 1996) + 1 >= 3 AND -60 + 30 * (station_id % 5) BETWEEN -40 AND 40""")
def g13_g16_usable_stations(spark, sf_dir):
    span = grid.valid_years(orders(spark, sf_dir).select(F.col("o_custkey").alias("station_id"), F.col("t").alias("time"), F.col("o_totalprice").alias("value")))
    listed = span.withColumns({"syears": F.array(F.col("syear"), F.lit(1996)), "eyears": F.array(F.col("eyear"), F.lit(2000)), "lat": -60.0 + 30.0 * (F.col("station_id") % 5), "lon": F.lit(0.0)})
    got = grid.usable_stations(listed, min_years=3, lat=(-40, 40))
    return got.select("station_id", F.col("use_syear").cast("long").alias("use_syear"), F.col("use_eyear").cast("long").alias("use_eyear"))


@query("""WITH y AS (SELECT o_custkey AS station_id, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b, avg(o_totalprice) AS area FROM orders GROUP BY 1)
SELECT station_id, a AS use_syear, b AS use_eyear FROM y WHERE b - a + 1 >= 3 AND area BETWEEN 100000 AND 260000 AND (station_id % 9) * 0.05 <= 0.2""")
def g14_gauge_allocation(spark, sf_dir):
    """Gauges whose upstream area and allocation error are within limits."""
    o = orders(spark, sf_dir).select(F.col("o_custkey").alias("station_id"), F.col("t").alias("time"), F.col("o_totalprice").alias("value"))
    areas = o.groupBy("station_id").agg(F.avg("value").alias("area"))
    listed = grid.valid_years(o).join(areas, "station_id").withColumns({"syears": F.array("syear"), "eyears": F.array("eyear"), "lat": F.lit(0.0), "lon": F.lit(0.0), "error": (F.col("station_id") % 9) * 0.05})
    return grid.usable_stations(listed, min_years=3, area=(100000, 260000), max_error=0.2).select("station_id", F.col("use_syear").cast("long").alias("use_syear"), F.col("use_eyear").cast("long").alias("use_eyear"))


@query("""WITH y AS (SELECT o_custkey AS station_id, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b, avg(o_totalprice) AS area FROM orders GROUP BY 1)
SELECT station_id, a AS use_syear, b AS use_eyear FROM y WHERE b - a + 1 >= 4 AND area <= 150000""")
def g15_direct_match(spark, sf_dir):
    """The same without an allocation, at the stations' own places."""
    o = orders(spark, sf_dir).select(F.col("o_custkey").alias("station_id"), F.col("t").alias("time"), F.col("o_totalprice").alias("value"))
    listed = grid.valid_years(o).join(o.groupBy("station_id").agg(F.avg("value").alias("area")), "station_id").withColumns({"syears": F.array("syear"), "eyears": F.array("eyear"), "lat": F.lit(0.0), "lon": F.lit(0.0)})
    return grid.usable_stations(listed, min_years=4, area=(0, 150000)).select("station_id", F.col("use_syear").cast("long").alias("use_syear"), F.col("use_eyear").cast("long").alias("use_eyear"))


@query("""WITH y AS (SELECT o_custkey AS station_id, min(year(o_orderdate)) AS a, max(year(o_orderdate)) AS b FROM orders GROUP BY 1) SELECT station_id, a AS use_syear, b AS use_eyear FROM y WHERE b - a >= 6""")
def g16_site_filter(spark, sf_dir):
    """A data set whose span is the difference of its years."""
    o = orders(spark, sf_dir).select(F.col("o_custkey").alias("station_id"), F.col("t").alias("time"), F.col("o_totalprice").alias("value"))
    listed = grid.valid_years(o).withColumns({"syears": F.array("syear"), "eyears": F.array("eyear"), "lat": F.lit(0.0), "lon": F.lit(0.0)})
    return grid.usable_stations(listed, min_years=6, inclusive=False).select("station_id", F.col("use_syear").cast("long").alias("use_syear"), F.col("use_eyear").cast("long").alias("use_eyear"))


@query(f"WITH {SQL_FINE} SELECT (i_lat // 3)::INT AS i_lat, (i_lon // 3)::INT AS i_lon, round(avg(value), 3) AS value FROM fi GROUP BY 1, 2 HAVING count(*) = 9")
def g17_coarsen(spark, sf_dir):
    return rounded(grid.coarsen(fine(spark, sf_dir).select("i_lat", "i_lon", "value"), 3, []), "value", digits=3)


@query(f"WITH {SQL_GRID} SELECT ref, sim, round(sum(cos(radians(-60 + 30 * (cell % 5))) * abs(o_mean) * d_mean) / sum(cos(radians(-60 + 30 * (cell % 5))) * abs(o_mean)), 4) AS bias FROM moments GROUP BY 1, 2")
def g18_g19_mass_weighted(spark, sf_dir):
    from ..operators import skill

    m = skill.moments(domain.grid_pairs(spark, sf_dir), KEYS).withColumn("lat", domain.lat()).withColumn("bias", F.col("d_mean"))
    return rounded(grid.spatial_mean(m, ["ref", "sim"], ["bias"], "mass"), "bias")


# ---- inventories

SQL_PATHS = """paths AS (SELECT '/data/set' || (o_custkey % 7) || '/gpp_v2010_' || CASE WHEN o_custkey % 2 = 0 THEN strftime(o_orderdate, '%Y%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END || '.nc' AS path, strftime(o_orderdate, '%Y')::INT AS y, o_custkey % 7 AS k, o_custkey % 2 AS odd FROM orders)"""


def paths(spark, sf_dir):
    c = F.col("o_custkey")
    date = F.when(c % 2 == 0, F.date_format("t", "yyyyMM")).otherwise(F.date_format("t", "yyyy-MM-dd"))
    return orders(spark, sf_dir).select(F.concat(F.lit("/data/set"), c % 7, F.lit("/gpp_v2010_"), date, F.lit(".nc")).alias("path"))


@query(f"""WITH {SQL_PATHS} SELECT '/data/set' || k AS folder, CASE WHEN count(*) = 1 THEN 'single' WHEN count(*) FILTER (odd = 0) > count(*) FILTER (odd = 1) THEN 'month' ELSE 'day' END AS granularity, min(y) AS first_year, max(y) AS last_year, count(*) AS files, count(*) AS dated FROM paths GROUP BY k""")
def x1_files(spark, sf_dir):
    return inventory.files(paths(spark, sf_dir))


#: File names with a year Y in them, the date that they stand for, and its granularity.
NAMES = (
    ("tas.Y01.nc", "Y01", "month"), ("MOD_r2050.nc", None, None), ("x_Y01_2020.nc", "Y01", "month"), ("proY.nc", "Y", "year"), ("prY0305.nc", "Y0305", "day"), ("ET_v2010.nc", None, None), ("v2010.nc", None, None),
    ("gpp_Y-03-05_r2011.nc", "Y0305", "day"), ("exp_1990-2010_Y.nc", "Y", "year"), ("exp_Y_1990_2010.nc", "2010", "year"), ("ssp_2015-2100.nc", "2015", "year"), ("a_YY.nc", None, None), ("run_Y_03.v2.nc", "Y03", "month"),
    ("nov2001.Y.nc", "Y", "year"), ("daily_2001_2002_2003.nc", "2003", "year"), ("1850_Y-12.nc", "Y12", "month"),
)


@query(f"""WITH n AS (SELECT p_partkey, (1990 + p_partkey % 30)::VARCHAR AS y, (p_partkey % {len(NAMES)})::INT AS k FROM part)
SELECT p_partkey, replace(CASE k {" ".join(f"WHEN {k} THEN '{t}'" for k, (_, t, _) in enumerate(NAMES) if t)} END, 'Y', y) AS token, CASE k {" ".join(f"WHEN {k} THEN '{g}'" for k, (_, _, g) in enumerate(NAMES) if g)} END AS granularity FROM n""")
def x1_date_tokens(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.element_at(F.array(*(F.lit(n) for n, _, _ in NAMES)), (k % len(NAMES) + 1).cast("int"))
    path = F.concat(F.lit("/data/v1/"), F.replace(name, F.lit("Y"), (1990 + k % 30).cast("string")))
    token, kind = inventory.date_token(path)
    return domain.table(spark, sf_dir, "part").select("p_partkey", token.alias("token"), kind.alias("granularity"))


@query(f"""WITH {SQL_STATIONS} SELECT station_id, min(year(time))::INT AS first_year, max(year(time))::INT AS last_year, count(*) AS n FROM st WHERE value IS NOT NULL GROUP BY 1""")
def x2_stations(spark, sf_dir):
    return inventory.stations(domain.station_series(spark, sf_dir))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 3 = 0")
def x3_j12_ledger(spark, sf_dir):
    o = domain.table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("path"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("modified"))
    tasks = inventory.signatures(o, ["o_custkey"], "cfg", "1")
    ledger = inventory.signatures(o.filter("o_custkey % 3 <> 0"), ["o_custkey"], "cfg", "1")
    return pairing.unfinished(tasks, ledger, ["o_custkey", "hash"]).select("o_custkey")


def catalog(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select((k % 4).cast("string").alias("variable"), k.alias("name"), (F.lit(1990) + k % 10).cast("int").alias("first_year"), (F.lit(2005) + k % 10).cast("int").alias("last_year"), F.element_at(F.array(F.lit("year"), F.lit("month"), F.lit("day")), (k % 3 + 1).cast("int")).alias("resolution"), (0.25 * (1 + k % 8)).alias("grid"))


SQL_CATALOG = """cat AS (SELECT (p_partkey % 4)::VARCHAR AS variable, p_partkey AS name, (1990 + p_partkey % 10)::INT AS first_year, (2005 + p_partkey % 10)::INT AS last_year, ['year', 'month', 'day'][(p_partkey % 3 + 1)::INT] AS resolution, [0, 1, 3][(p_partkey % 3 + 1)::INT] AS rank, 0.25 * (1 + p_partkey % 8) AS grid FROM part)"""


@query(f"WITH {SQL_CATALOG} SELECT name FROM cat WHERE variable = '1' AND first_year <= 1995 AND last_year >= 2010 AND rank >= 1")
def x4_coverage(spark, sf_dir):
    return inventory.coverage(catalog(spark, sf_dir), "1", 1995, 2010, "month").select("name")


@query(f"WITH {SQL_CATALOG}, r AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY abs(grid - 0.6), rank - 1, name) AS k FROM cat WHERE rank >= 1) SELECT variable, name, resolution, grid::DOUBLE AS grid FROM r WHERE k = 1")
def j11_best_variant(spark, sf_dir):
    return inventory.best_variant(catalog(spark, sf_dir), ["variable"], "month", 0.6).select("variable", "name", "resolution", "grid")


@query("SELECT c_custkey // 3 AS trio, count(DISTINCT c_mktsegment) AS n, count(DISTINCT c_mktsegment) <= 1 AS agreed FROM customer GROUP BY 1")
def x5_agreement(spark, sf_dir):
    trios = domain.table(spark, sf_dir, "customer").withColumn("trio", F.floor(F.col("c_custkey") / 3))
    got = inventory.agreement(trios, ["trio"], "c_mktsegment")
    return got.select("trio", F.size("values").cast("long").alias("n"), "agreed")


@query(f"""WITH {SQL_CATALOG}, h AS (SELECT variable, max(first_year) AS a, min(last_year) AS b FROM cat WHERE variable <> '3' GROUP BY 1), w AS (SELECT * FROM (VALUES ('0', 1980, 1985), ('1', 2000, 2004), ('3', 2000, 2004)) AS v(variable, fy, ly))
SELECT variable, CASE WHEN a IS NULL THEN 'missing' WHEN b < fy OR a > ly THEN 'no common years' ELSE 'too coarse' END AS finding FROM w LEFT JOIN h USING (variable)""")
def x6_findings(spark, sf_dir):
    have = catalog(spark, sf_dir).filter("variable <> '3'").groupBy("variable").agg(F.max("first_year").alias("first_year"), F.min("last_year").alias("last_year")).withColumn("resolution", F.lit("month"))
    wanted = have.sparkSession.createDataFrame([("0", 1980, 1985, "month"), ("1", 2000, 2004, "day"), ("3", 2000, 2004, "month")], "variable string, first_year int, last_year int, resolution string")
    return inventory.findings(wanted, have)


@query("""WITH c AS (SELECT DISTINCT o_custkey % 11 AS source, -85.5 + (o_orderkey % 20) * (0.25 * (o_custkey % 11)) + (o_orderkey % 3) * 0.01 AS lat FROM orders), d AS (SELECT source, lat - lag(lat) OVER (PARTITION BY source ORDER BY lat) AS d FROM c)
SELECT source, round(abs(median(d)), 4)::DOUBLE AS step FROM d GROUP BY 1 HAVING round(abs(median(d)), 4) > 0.001 AND round(abs(median(d)), 4) < 10""")
def x7_grid_step(spark, sf_dir):
    source = F.col("o_custkey") % 11
    lat = -85.5 + (F.col("o_orderkey") % 20) * (0.25 * source) + (F.col("o_orderkey") % 3) * 0.01
    cells = domain.table(spark, sf_dir, "orders").select(source.alias("source"), lat.alias("lat"))
    return inventory.grid_step(cells, ["source"])


@query("""WITH h AS (SELECT p_brand AS source, p_partkey % 5 AS model, count(DISTINCT p_size) AS shared FROM part GROUP BY 1, 2), t AS (SELECT *, max(shared) OVER (PARTITION BY source) AS top FROM h)
SELECT source, CASE WHEN count(*) = 1 THEN min(model) END AS model, max(shared) AS shared FROM t WHERE shared = top GROUP BY 1""")
def x8_likely_model(spark, sf_dir):
    p = domain.table(spark, sf_dir, "part")
    names = p.select(F.col("p_brand").alias("source"), F.lit("/none").alias("path"), F.concat_ws("_", "p_brand", F.col("p_partkey") % 5, "p_size").alias("name"))
    profiles = p.select((F.col("p_partkey") % 5).cast("string").alias("model"), F.concat_ws("_", "p_brand", F.col("p_partkey") % 5, "p_size").alias("name"))
    got = inventory.likely_model(names, profiles)
    return got.withColumn("model", F.col("model").cast("long"))


@query("""SELECT o_custkey AS source, CASE WHEN count(DISTINCT o_orderdate) <= 1 THEN 'annual' WHEN count(DISTINCT o_orderdate) = 12 AND count(DISTINCT month(o_orderdate)) = 12 THEN 'monthly' ELSE 'series' END AS kind FROM orders GROUP BY 1""")
def x9_kind_of_axis(spark, sf_dir):
    return inventory.kind_of_axis(orders(spark, sf_dir).select(F.col("o_custkey").alias("source"), F.col("t").alias("time")))


@query("""WITH h AS (SELECT DISTINCT c_nationkey AS k, c_custkey % 97 AS v FROM customer) SELECT a.k AS "case", b.v AS variable FROM (SELECT DISTINCT k FROM h) a, (SELECT DISTINCT v FROM h) b WHERE (a.k, b.v) NOT IN (SELECT k, v FROM h)""")
def x10_set_differences(spark, sf_dir):
    return inventory.set_differences(domain.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("case"), (F.col("c_custkey") % 97).alias("variable")))


# ---- sources, sinks, streaming


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY 1")
def io1_io5_by_year(spark, sf_dir):
    out = scratch(spark)
    tables.write_by_year(orders(spark, sf_dir).select("o_orderkey", "o_totalprice", F.col("t").alias("time")), out)
    got = tables.read_series(spark, out).filter(F.col("year").between(1996, 1998))
    return got.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"WITH {SQL_GRID} SELECT 'bias' AS name, ref, sim, count(*) AS n, round(sum(d_mean), 3) AS total FROM moments GROUP BY 2, 3")
def io7_field(spark, sf_dir):
    from ..operators import skill

    out = scratch(spark)
    tables.write_field(skill.unpivot(skill.metrics(domain.grid_pairs(spark, sf_dir), KEYS, ["bias", "RMSE"]), KEYS, ["bias", "RMSE"]).withColumn("variable", F.lit("price")), out)
    got = tables.read_series(spark, out).filter("name = 'bias'")
    return got.groupBy("name", "ref", "sim").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT s_suppkey::VARCHAR AS key, CASE WHEN s_suppkey % 5 = 0 THEN 'N/A' ELSE printf('%.2f', s_acctbal) END AS value FROM supplier")
def io9_comparison_table(spark, sf_dir):
    out = scratch(spark)
    s = domain.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("key"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_acctbal")).alias("value"))
    tables.write_comparison(s, out, ["value"], 2)
    return tables.read_series(spark, out, "csv", "key string, value string", sep="\t")


@query("SELECT count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier")
def io8_io10_formats(spark, sf_dir):
    s, got = domain.table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), None
    for fmt in ("json", "csv", "orc"):
        tables.write(s, out := scratch(spark), fmt)
        one = tables.read_series(spark, out, fmt, "s_suppkey long, s_acctbal double")
        got = one if got is None else got.intersect(one)
    return got.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s_acctbal"), 2).alias("total"))


@query(f"WITH {SQL_STATIONS} SELECT source, count(*) AS n, round(sum(value), 2) AS total FROM st GROUP BY 1")
def io8_station_series(spark, sf_dir):
    tables.write_stations(domain.station_series(spark, sf_dir), out := scratch(spark), "csv")
    got = tables.read_series(spark, out, "csv", "source string, station_id long, time timestamp_ntz, value double")
    return rounded(got.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), "total", digits=2)


@query(f"WITH {SQL_GRID} SELECT cell, count(*) AS n FROM wide GROUP BY 1")
def io11_compact(spark, sf_dir):
    out = scratch(spark)
    tables.compact(domain.grid_wide(spark, sf_dir), out, ["cell"], 8)
    return tables.read_series(spark, out).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_GRID} SELECT ref, sim, cell, count(*) AS n, round(sum(s - o), 2) AS difference FROM pairs GROUP BY 1, 2, 3")
def io11_j1_bucketed_pairing(spark, sf_dir):
    """References and simulations as bucketed tables, paired where they lie."""
    on, series = ["variable", "cell", "time"], domain.grid_series(spark, sf_dir)
    name = lambda: f"series_{uuid.uuid4().hex}"
    sims, refs = (tables.bucketed(series.filter(which), name(), scratch(spark), on, 8) for which in ("source <> 'R'", "source = 'R'"))
    return pairing.pair(sims, refs, on).groupBy("ref", "sim", "cell").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("s") - F.col("o")), 2).alias("difference"))


@query(f"WITH {SQL_GRID} SELECT ref, sim, cell, n, round(d_mean, 4) AS bias, round(sqrt(d_sq), 4) AS \"RMSE\", round(r, 5) AS correlation FROM moments")
def streaming_moments(spark, sf_dir):
    pairs, out = scratch(spark), scratch(spark)
    domain.grid_pairs(spark, sf_dir).write.parquet(pairs)
    got = streaming.follow(spark, pairs, spark.read.parquet(pairs).schema, KEYS, out)
    return rounded(rounded(got, "bias", "RMSE"), "correlation", digits=5)


@query("SELECT year(o_orderdate)::INT AS file_year, count(*) AS n FROM orders WHERE year(o_orderdate) IN (1996, 1997) GROUP BY 1")
def io3_layout(spark, sf_dir):
    """One file per year under a prefix; only the wanted years' files are opened."""
    out = scratch(spark)
    o = orders(spark, sf_dir).select("o_orderkey", F.year("t").alias("y"))
    tables.write_named(o, out, "y", lambda y: f"gpp_{y}")
    return tables.read_layout(spark, out, "gpp_", "year", 1996, 1997).groupBy("file_year").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s_suppkey::VARCHAR AS station_id, round(s_suppkey / 10, 4) AS lat, round(s_suppkey / 7, 4) AS lon, 1990 + s_suppkey::INT % 5 AS syear, 2000 + s_suppkey::INT % 5 AS eyear FROM supplier")
def io6_station_list(spark, sf_dir):
    k = F.col("s_suppkey")
    listed = domain.table(spark, sf_dir, "supplier").select(k.alias("ID"), (F.lit(1990) + k % 5).alias("SYEAR"), (F.lit(2000) + k % 5).alias("EYEAR"), F.round(k / 7, 4).alias("LON"), F.round(k / 10, 4).alias("LAT"), F.lit("/d").alias("DIR"))
    tables.write(listed, out := scratch(spark), "csv")
    return tables.read_stations(spark, out).drop("dir")


@query("SELECT CASE c_nationkey % 3 WHEN 0 THEN 'US-Aa0' WHEN 1 THEN 'US-Aa1' ELSE 'US-Aa2' END AS station_id, count(*) AS n, min(c_custkey) AS first FROM customer GROUP BY 1")
def io12_merge_site(spark, sf_dir):
    out = scratch(spark)
    c = domain.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (F.col("c_nationkey") % 3).cast("int").alias("k"))
    tables.write_named(c, out, "k", lambda k: f"FLX_US-Aa{k}_2001_2010")
    return tables.merge_site(spark, out, "c_custkey long, c_acctbal double", "parquet").groupBy("station_id").agg(F.count(F.lit(1)).alias("n"), F.min("c_custkey").alias("first"))
