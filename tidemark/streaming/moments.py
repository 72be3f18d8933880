"""Moments of pairs kept up to date as files of pairs arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.guards import ratio

#: Sums that add up over batches.
SUMS = {"n": "count(1)", "s1": "sum(s)", "o1": "sum(o)", "ss": "sum(s * s)", "oo": "sum(o * o)", "so": "sum(s * o)", "d2": "sum((s - o) * (s - o))"}


def follow(spark: SparkSession, pairs_dir: str, schema: str, keys: Sequence[str], out_dir: str) -> DataFrame:
    """Take in the files that are new under pairs_dir, and return (keys, n, bias, RMSE, correlation) over all so far.

    Each batch writes its sums to a folder of its own, so one that is run again changes nothing; the sums are added when read.
    """
    sums = spark.readStream.schema(schema).parquet(pairs_dir).filter("s IS NOT NULL AND o IS NOT NULL")

    def keep(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(*(F.expr(e).alias(n) for n, e in SUMS.items())).write.mode("overwrite").parquet(f"{out_dir}/sums/batch={number}")

    sums.writeStream.option("checkpointLocation", f"{out_dir}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    t = spark.read.parquet(f"{out_dir}/sums").groupBy(*keys).agg(*(F.sum(n).alias(n) for n in SUMS))
    n = F.col("n")
    cov = F.col("so") / n - F.col("s1") * F.col("o1") / n / n
    var = lambda c: F.greatest(F.lit(0.0), F.col(c * 2) / n - F.col(f"{c}1") * F.col(f"{c}1") / n / n)
    return t.select(*keys, "n", ((F.col("s1") - F.col("o1")) / n).alias("bias"), F.sqrt(F.col("d2") / n).alias("RMSE"), ratio(cov, F.sqrt(var("s") * var("o"))).alias("correlation"))
