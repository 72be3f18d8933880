"""Readers and writers of series and results, by Spark's own sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATIONS = "ID string, SYEAR int, EYEAR int, LON double, LAT double, DIR string"


def read_series(spark: SparkSession, path: str | Sequence[str], fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """One or many files, or folders of them, as one table. CSV and JSON need a schema: it isn't inferred from the data."""
    if fmt in ("csv", "json") and schema is None:
        raise ValueError(f"{fmt} needs a schema")
    reader = spark.read.format(fmt).options(**({"header": "true"} if fmt == "csv" else {}), **options)
    return (reader.schema(schema) if schema else reader).load(path)


def read_layout(spark: SparkSession, root: str, prefix: str, layout: str, first: int, last: int, *, suffix: str = "", fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Files prefix + date + suffix of a layout (single, year, month, day) for the years; each file's year is a column.

    The pattern keeps other years' files from being opened.
    """
    years = "{" + ",".join(map(str, range(first, last + 1))) + "}"
    glob = {"single": f"{prefix}{suffix}.*", "year": f"{prefix}{years}{suffix}.*", "month": f"{prefix}{years}[-_0-9]*{suffix}.*", "day": f"{prefix}{years}[-_0-9]*{suffix}.*"}[layout]
    df = read_series(spark, root, fmt, schema, pathGlobFilter=glob)
    if layout == "single":
        return df
    return df.withColumn("file_year", F.regexp_extract(F.col("_metadata.file_name"), "^" + prefix + r"(\d{4})", 1).cast("int"))


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """A station list with the column names of the new tables."""
    raw = spark.read.csv(path, header=True, schema=STATIONS)
    return raw.select(F.trim("ID").alias("station_id"), F.col("LAT").alias("lat"), F.col("LON").alias("lon"), F.col("SYEAR").alias("syear"), F.col("EYEAR").alias("eyear"), F.col("DIR").alias("dir"))


def merge_site(spark: SparkSession, root: str, schema: str, fmt: str = "csv") -> DataFrame:
    """All files of a site's folder as one table, with the station of each file's name."""
    from ..operators.inventory import station_id

    return read_series(spark, root, fmt, schema, recursiveFileLookup="true").withColumn("station_id", station_id(F.col("_metadata.file_name")))


def write_by_year(df: DataFrame, path: str, time: str = "time") -> None:
    df.withColumn("year", F.year(time)).write.mode("overwrite").partitionBy("year").parquet(path)


def write_field(df: DataFrame, path: str) -> None:
    """Metrics and scores, (variable, ref, sim, cell, name, value), one folder per variable and name."""
    df.write.mode("overwrite").partitionBy("variable", "name").parquet(path)


def write_stations(df: DataFrame, path: str, fmt: str = "csv") -> None:
    write(df, path, fmt)


def formatted(df: DataFrame, names: Sequence[str], digits: int = 3) -> DataFrame:
    """Numbers as text with so many digits, N/A for what is missing. Only a sink should do this."""
    return df.withColumns({n: F.when(F.col(n).isNull(), "N/A").otherwise(F.format_string(f"%.{digits}f", F.col(n).cast("double"))) for n in names})


def write_comparison(df: DataFrame, path: str, names: Sequence[str], digits: int = 3) -> None:
    """A tab-separated table; comparisons are small."""
    formatted(df, names, digits).coalesce(1).write.mode("overwrite").csv(path, sep="\t", header=True)


def write(df: DataFrame, path: str, fmt: str) -> None:
    df.write.mode("overwrite").format(fmt).options(**({"header": "true"} if fmt == "csv" else {})).save(path)


def compact(df: DataFrame, path: str, keys: Sequence[str], files: int, time: str = "time") -> None:
    """Parquet of few files in which a cell's series lies together and in order."""
    df.repartition(files, *keys).sortWithinPartitions(*keys, time).write.mode("overwrite").parquet(path)


def bucketed(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """A table of one sorted file per bucket of the keys. Two such tables with as many buckets are joined on the keys where they lie, without an exchange.

    Write the sources of a comparison so once, by the keys that they are paired on; every pairing, mask and metric then reads them in place.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def write_named(df: DataFrame, root: str, by: str, name) -> None:
    """One Parquet file per value of a column with few values, named name(value).parquet, for readers that go by names.

    Spark writes its own names; each file is then renamed in its store.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path
    df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(f"{root}-parts")
    store = at(root).getFileSystem(conf)
    store.mkdirs(at(root))
    for folder in store.globStatus(at(f"{root}-parts/{by}=*")):
        value = folder.getPath().getName().partition("=")[2]
        for k, part in enumerate(store.globStatus(at(f"{folder.getPath().toString()}/part-*"))):
            store.rename(part.getPath(), at(f"{root}/{name(value)}{f'_{k}' if k else ''}.parquet"))
    store.delete(at(f"{root}-parts"), True)
