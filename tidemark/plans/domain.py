"""The evaluation's tables, derived from the driver's star schema, in Spark and in SQL.

Grid: a supplier's nation is a cell of a 5 x 5 grid, a line item's month the time, the average price the value; the price
with discount, tax or both are three simulations. Stations: users, with the daily mean of each kind of event as a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIMS = ("A", "B", "C")
KEYS = ["ref", "sim", "cell"]
FIELD = ["ref", "sim"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lat(cell: str = "cell"):
    return (-60.0 + 30.0 * (F.col(cell) % 5)).alias("lat")


def lon(cell: str = "cell"):
    return (-144.0 + 72.0 * F.floor(F.col(cell) / 5)).alias("lon")


def grid_wide(spark: SparkSession, sf_dir: str, *, parts: bool = False) -> DataFrame:
    """(cell, time, R, A, B, C): the reference and the simulations, one row per cell and month; with parts each part is a cell, so cells grow with the data."""
    p, d, t = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    items = table(spark, sf_dir, "lineitem").select("l_partkey" if parts else "l_suppkey", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("time"), p, d, t)
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("cell"))
    values = {"R": p, "A": p * (1 - d), "B": p * (1 + t), "C": p * (1 - d) * (1 + t)}
    # a part's month has about one item, so sums before a shuffle save nothing: items go to their cell's task once, and all that follows stays there
    placed = items.withColumnRenamed("l_partkey", "cell").repartition("cell") if parts else items.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return placed.groupBy("cell", "time").agg(*(F.avg(v).alias(n) for n, v in values.items()))


def grid_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, cell, time, value), long."""
    return grid_wide(spark, sf_dir).unpivot(["cell", "time"], ["R", *SIMS], "source", "value").withColumn("variable", F.lit("price"))


def grid_pairs(spark: SparkSession, sf_dir: str, *, parts: bool = False) -> DataFrame:
    """(ref, sim, cell, time, s, o). The wide table is its own pairing: no join is needed. An array keeps the rows dealt by cell, an unpivot wouldn't."""
    wide = grid_wide(spark, sf_dir, parts=parts).withColumnRenamed("R", "o")
    sims = F.explode(F.array(*(F.struct(F.lit(n).alias("sim"), F.col(n).alias("s")) for n in SIMS)))
    return wide.select("cell", "time", "o", sims.alias("p")).select(F.lit("R").alias("ref"), "p.sim", "cell", "time", "p.s", "o")


def station_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, station_id, time, value)."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("source"), F.col("user_id").alias("station_id"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("time")).agg(F.avg("value").alias("value"))


def class_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("cell"), F.col("n_regionkey").alias("class_id"))


SQL_GRID = """
wide AS (SELECT s_nationkey AS cell, date_trunc('month', l_shipdate)::TIMESTAMP AS time, avg(l_extendedprice) AS "R",
  avg(l_extendedprice * (1 - l_discount)) AS "A", avg(l_extendedprice * (1 + l_tax)) AS "B",
  avg(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS "C"
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2),
pairs AS (SELECT 'R' AS ref, 'A' AS sim, cell, time, "A" AS s, "R" AS o FROM wide UNION ALL
  SELECT 'R', 'B', cell, time, "B", "R" FROM wide UNION ALL SELECT 'R', 'C', cell, time, "C", "R" FROM wide),
series AS (SELECT 'R' AS source, cell, time, "R" AS value FROM wide UNION ALL SELECT sim, cell, time, s FROM pairs),
moments AS (SELECT ref, sim, cell, count(*) AS n, sum(s) AS s_sum, sum(o) AS o_sum, avg(s) AS s_mean, avg(o) AS o_mean, stddev_pop(s) AS s_sd, stddev_pop(o) AS o_sd,
  var_pop(o) AS o_var, var_samp(o) AS o_var1, covar_pop(s, o) AS cov, sum(s - o) AS d_sum, avg(s - o) AS d_mean, avg(abs(s - o)) AS d_abs, avg((s - o) * (s - o)) AS d_sq,
  stddev_pop(s - o) AS d_sd, var_pop(s - o) AS d_var, max(s) AS s_max, min(s) AS s_min, max(o) AS o_max, min(o) AS o_min,
  covar_pop(s, o) / nullif(stddev_pop(s) * stddev_pop(o), 0) AS r FROM pairs GROUP BY 1, 2, 3)
"""
SQL_PARTS = SQL_GRID.replace("s_nationkey AS cell", "l_partkey AS cell").replace("FROM lineitem JOIN supplier ON l_suppkey = s_suppkey", "FROM lineitem")
SQL_STATIONS = """
st AS (SELECT event_type AS source, user_id AS station_id, date_trunc('day', ts)::TIMESTAMP AS time, avg(value) AS value FROM events GROUP BY 1, 2, 3)
"""
#: metric -> SQL over the moments table.
SQL_METRICS = {
    "bias": "d_mean", "percent_bias": "100 * d_sum / nullif(o_sum, 0)", "absolute_percent_bias": "100 * abs(d_sum) / nullif(abs(o_sum), 0)",
    "mean_absolute_error": "d_abs", "RMSE": "sqrt(d_sq)", "ubRMSE": "d_sd",
    "CRMSD": "sqrt(greatest(0, s_sd * s_sd + o_sd * o_sd - 2 * s_sd * o_sd * r))",
    "correlation": "r", "correlation_R2": "r * r", "ubcorrelation": "r", "ubcorrelation_R2": "r * r",
    "L": "exp(-5 * d_sq / nullif(o_var, 0))", "NSE": "1 - d_sq / nullif(o_var, 0)", "ubNSE": "1 - d_var / nullif(o_var, 0)",
    "KGE": "1 - sqrt((r - 1) ** 2 + (s_sd / nullif(o_sd, 0) - 1) ** 2 + (s_mean / nullif(o_mean, 0) - 1) ** 2)",
    "KGESS": "(1 - sqrt((r - 1) ** 2 + (s_sd / nullif(o_sd, 0) - 1) ** 2 + (s_mean / nullif(o_mean, 0) - 1) ** 2) + 0.41) / 1.41",
    "ubKGE": "1 - sqrt((r - 1) ** 2 + (s_sd / nullif(o_sd, 0) - 1) ** 2)", "rv": "s_sd / nullif(o_sd, 0) - 1",
    "pc_max": "(s_max - o_max) / nullif(abs(o_max), 0)", "pc_min": "(s_min - o_min) / nullif(abs(o_min), 0)",
    "pc_ampli": "(s_max - s_min) / nullif(o_max - o_min, 0) - 1",
    "br2": "CASE WHEN abs(cov / nullif(o_var, 0)) <= 1 THEN abs(cov / nullif(o_var, 0)) * r * r ELSE r * r / nullif(abs(cov / nullif(o_var, 0)), 0) END",
    "smpi": "d_mean * d_mean / nullif(o_var1, 0)", "nBiasScore": "exp(-abs(d_mean) / nullif(o_sd, 0))", "nRMSEScore": "exp(-d_sd / nullif(o_sd, 0))",
}
