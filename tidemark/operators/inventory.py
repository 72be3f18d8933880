"""Catalogs and inventories as tables: files, stations, ledgers, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranks of time resolutions, a higher one is finer.
RANK = {"year": 0, "month": 1, "8day": 2, "week": 2, "day": 3, "6hour": 4, "3hour": 5, "hour": 6, "30min": 7}


#: The years, months and days of a date in a file name, with or without a mark between. A single v or r before makes it a version.
DATE = r"(?<![0-9])(?<!(?<![\p{L}\p{N}])[vVrR])((?:19|20)[0-9]{2}(?:[-_/]?(?:0[1-9]|1[0-2])(?:[-_/]?(?:0[1-9]|[12][0-9]|3[01]))?)?)(?![0-9])"
#: Granularities of a date, the finest last.
FINENESS = {"year": 1, "month": 2, "day": 3}


def stem(path: str | Column) -> Column:
    """The file's name without its last suffix."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")


def date_token(path: str | Column) -> tuple[Column, Column]:
    """(token, granularity) of the date that a file name is told by: of the finest dates in it the last one.

    A year that is one end of a span such as 2001-2010 counts only if there is no other. Versions such as v2010 or _r2050 are no dates.
    """
    name = stem(path)
    spans = F.regexp_replace(name, r"(?<![0-9])((?:19|20)[0-9]{2})[-_](?=(?:19|20)[0-9]{2}(?![0-9]))", "$1\u0001")  # marks the years of a span
    fine = lambda t: F.length(F.regexp_replace(t, "[^0-9]", ""))
    tokens = F.regexp_extract_all(name, F.lit(DATE), F.lit(1))
    apart = F.regexp_extract_all(F.regexp_replace(spans, r"(?:19|20)[0-9]{2}\u0001((?:19|20)[0-9]{2}\u0001)*(?:19|20)[0-9]{2}", "\u0001"), F.lit(DATE), F.lit(1))
    finest = F.array_max(F.transform(tokens, fine))
    of = lambda some: F.filter(some, lambda t: fine(t) == finest)
    own = F.when((finest == 4) & (F.size(of(apart)) > 0), of(apart)).otherwise(of(tokens))
    token = F.regexp_replace(F.get(own, F.size(own) - 1), "[-_/]", "")
    return token, F.when(finest == 8, "day").when(finest == 6, "month").when(finest == 4, "year")


def files(paths: DataFrame, path: str = "path") -> DataFrame:
    """(folder, granularity, first_year, last_year, files, dated): per folder the commonest granularity, the finer of equals, and the span; a folder of one file is single."""
    token, kind = date_token(path)
    each = paths.select(F.regexp_extract(path, r"^(.*)/[^/]+$", 1).alias("folder"), kind.alias("granularity"), F.substring(token, 1, 4).cast("int").alias("year"))
    counts = each.groupBy("folder", "granularity").agg(F.count(F.lit(1)).alias("n"), F.min("year").alias("a"), F.max("year").alias("b"))
    rank = F.create_map(*(F.lit(x) for kv in FINENESS.items() for x in kv))[F.col("granularity")]
    common = F.max(F.when(F.col("granularity").isNotNull(), F.struct(F.col("n"), rank.alias("rank"), F.col("granularity"))))["granularity"]
    got = counts.groupBy("folder").agg(common.alias("granularity"), F.min("a").alias("first_year"), F.max("b").alias("last_year"), F.sum("n").alias("files"), F.sum(F.when(F.col("granularity").isNotNull(), F.col("n")).otherwise(0)).alias("dated"))
    return got.withColumn("granularity", F.when(F.col("files") == 1, "single").otherwise(F.coalesce("granularity", F.lit("year"))))


def station_id(path: str | Column) -> Column:
    """XX-Yyy at the start of a part of a file name, as in FLX_XX-Yyy_2001_2010.csv."""
    return F.nullif(F.regexp_extract(path, r"(?:^|[/_])([A-Z]{2}-[A-Za-z0-9]{3})(?:[_.]|$)", 1), F.lit(""))


def stations(series: DataFrame, key: str = "station_id", time: str = "time", value: str = "value") -> DataFrame:
    """(station, lat, lon, first_year, last_year, n) of stations with values; a station's coordinates are those of its first row in time."""
    place = [F.min_by(c, time).alias(c) for c in ("lat", "lon") if c in series.columns]
    return series.filter(F.col(value).isNotNull()).groupBy(key).agg(*place, F.min(F.year(time)).alias("first_year"), F.max(F.year(time)).alias("last_year"), F.count(F.lit(1)).alias("n"))


def signatures(inputs: DataFrame, keys: Sequence[str], config: str, version: str) -> DataFrame:
    """(keys, hash): a digest of configuration, code version and the (path, size, modified) of a task's inputs, whatever their order.

    The inputs' hashes are added up under two seeds, with their number, so the digest is a partial aggregate and no task lists the files.
    """
    one = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("path", "size", "modified")))
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), one).cast("decimal(20,0)")).cast("string")
    sums = inputs.groupBy(*keys).agg(total("a").alias("__a"), total("b").alias("__b"), F.count(F.lit(1)).alias("__n"))
    return sums.select(*keys, F.sha2(F.concat_ws("\n", F.lit(config), F.lit(version), "__a", "__b", F.col("__n").cast("string")), 256).alias("hash"))


def coverage(catalog: DataFrame, variable: str, first: int, last: int, resolution: str) -> DataFrame:
    """References of a variable that cover the years at the resolution or a finer one."""
    rank = F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))
    return catalog.filter((F.col("variable") == variable) & (F.col("first_year") <= first) & (F.col("last_year") >= last) & (rank[F.col("resolution")] >= RANK[resolution]))


def best_variant(variants: DataFrame, keys: Sequence[str], resolution: str, grid: float) -> DataFrame:
    """Per keys the variant with the resolution or a finer one, the nearest grid, and the least excess in time."""
    rank = F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))[F.col("resolution")]
    n = F.row_number().over(W.partitionBy(*keys).orderBy(F.abs(F.col("grid") - grid), rank - RANK[resolution], "name"))
    return variants.filter(rank >= RANK[resolution]).withColumn("__n", n).filter("__n = 1").drop("__n")


def agreement(sources: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """(keys, values, agreed): whether all sources of a group name the same target."""
    return sources.groupBy(*keys).agg(F.sort_array(F.collect_set(column)).alias("values")).withColumn("agreed", F.size("values") <= 1)


def findings(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """(variable, finding) of wanted(variable, first_year, last_year, resolution) that have(the same) can't serve."""
    rank = F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))
    h = have.select("variable", F.col("first_year").alias("a"), F.col("last_year").alias("b"), F.col("resolution").alias("r"))
    said = F.when(F.col("a").isNull(), "missing").when((F.col("b") < F.col("first_year")) | (F.col("a") > F.col("last_year")), "no common years").when(rank[F.col("r")] < rank[F.col("resolution")], "too coarse")
    return wanted.join(h, "variable", "left").select("variable", said.alias("finding")).filter("finding IS NOT NULL")


def grid_step(cells: DataFrame, keys: Sequence[str], lat: str = "lat") -> DataFrame:
    """(keys, step): the median step of latitudes to four digits, where it lies between 0.001 and 10."""
    lats = cells.select(*keys, lat).distinct()
    step = lats.withColumn("d", F.col(lat) - F.lag(lat).over(W.partitionBy(*keys).orderBy(lat)))
    return step.groupBy(*keys).agg(F.round(F.abs(F.median("d")), 4).alias("step")).filter("step > 0.001 AND step < 10")


def likely_model(names: DataFrame, profiles: DataFrame, source: str = "source") -> DataFrame:
    """(source, model, shared): the profile that shares most variable names; a model named in the path wins unless another leads by two; ties give NULL.

    names has (source, path, name), profiles (model, name).
    """
    hits = names.withColumn("k", F.lower("name")).join(profiles.withColumn("k", F.lower("name")).select("model", "k").distinct(), "k")
    shared = hits.groupBy(source, "model").agg(F.countDistinct("k").alias("shared"), F.max(F.contains(F.lower("path"), F.lower("model"))).alias("named"))
    w = W.partitionBy(source)
    ranked = shared.withColumns({"top": F.max("shared").over(w), "best_named": F.max(F.when(F.col("named"), F.col("shared"))).over(w)})
    by_name = F.col("best_named").isNotNull() & (F.col("top") - F.col("best_named") < 2)
    kept = ranked.filter((by_name & F.col("named") & (F.col("shared") == F.col("best_named"))) | (~by_name & (F.col("shared") == F.col("top"))) | (F.col("best_named").isNull() & (F.col("shared") == F.col("top"))))
    return kept.groupBy(source).agg(F.when(F.count(F.lit(1)) == 1, F.min("model")).alias("model"), F.max("shared").alias("shared"))


def kind_of_axis(series: DataFrame, source: str = "source", time: str = "time", hint: str | None = None) -> DataFrame:
    """(source, kind): annual for at most one time, monthly for twelve that cover all months (and a name that hints at it, if given), else series."""
    months = F.countDistinct(F.month(time))
    hinted = F.lit(True) if hint is None else F.lower(F.col(source)).rlike(hint)
    got = series.groupBy(source).agg(F.countDistinct(time).alias("n"), months.alias("m"))
    return got.select(source, F.when(F.col("n") <= 1, "annual").when((F.col("n") == 12) & (F.col("m") == 12) & hinted, "monthly").otherwise("series").alias("kind"))


def set_differences(cases: DataFrame, case: str = "case", variable: str = "variable") -> DataFrame:
    """(case, variable) that some case has and this one lacks."""
    have = cases.select(case, variable).distinct()
    every = have.select(case).distinct().crossJoin(F.broadcast(have.select(variable).distinct()))
    return every.join(have, [case, variable], "left_anti")
