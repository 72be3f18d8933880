"""Time: decoding, stamps, axes, resampling, climatologies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.guards import ratio

#: Variables that add up over time, and the units in which they do; in lower case.
ACCUMULATED = ("precipitation", "runoff", "snowfall", "subsurface_runoff", "surface_runoff", "total_irrigation_amount", "total_runoff")
ACCUMULATED_UNITS = ("mm", "kg m-2", "kg/m2", "kg m**-2")
#: Ranks of resolutions, the finest first.
RESOLUTIONS = {"hour": 0, "day": 1, "week": 2, "month": 3, "year": 4}
#: The longest step of each class in days.
CLASSES = (("hour", 1 / 12), ("day", 1.5), ("week", 10.0), ("month", 45.0))
#: How many steps a file of a year, month or day has at each resolution.
COUNTS = {"year": ((10, 13, "month"), (350, 370, "day"), (8000, 9000, "hour")), "month": ((27, 32, "day"), (650, 750, "hour"), (1, 1, "month")), "day": ((20, 25, "hour"), (1, 1, "day"))}
#: The hours of a step that each resolution allows, exclusive of both ends.
SPANS = (("hour", 5 / 6, 7 / 6), ("3hour", 2.5, 3.5), ("6hour", 5, 7), ("day", 22, 26), ("8day", 168, 216), ("month", 672 - 1e-9, 768 + 1e-9), ("year", 8040, 9480))
#: Parts of file names by resolution, the first that is found counts.
NAMED = (("hour", ("hourly", "hour", "hr")), ("month", ("monthly", "month", "mon")), ("day", ("daily", "day")))
#: Names that need more than one point in time, and those that a climatology can't have.
NOT_CLIMATOLOGY = ("nPhaseScore", "nIavScore", "APFB")
TWO_POINTS = ("correlation", "correlation_R2", "ubcorrelation", "ubcorrelation_R2", "NSE", "KGE", "KGESS", "mKGE", "nKGE", "pc_ampli", "pc_max", "pc_min", "CRMSD", "rv", "cp", "br2")


def _instant(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def decode_offset(offset: Column, unit: str, since: Column) -> Column:
    """An offset in units since a date. Months, seasons (3 months) and years keep the day, clamped to the month's length."""
    months = {"month": 1, "season": 3, "year": 12}.get(unit.lower().rstrip("s"))
    if months:
        moved = F.add_months(since.cast("date"), (F.floor(offset) * months).cast("int"))
        return _instant(moved) + (_instant(since) - _instant(since.cast("date")))
    seconds = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}[unit.lower().rstrip("s")]
    return _instant(since) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (offset * seconds).cast("decimal(18,6)"))


def decode_number(x: Column) -> Column:
    """YYYYMMDD, YYYYMM, or a fractional year from 1800 to 2200; NULL for anything else."""
    whole = (x == F.floor(x)) & (x > 2200)
    text = F.floor(x).cast("string")
    year = F.floor(x).cast("int")
    start = F.make_date(year, F.lit(1), F.lit(1))
    length = F.datediff(F.make_date(year + 1, F.lit(1), F.lit(1)), start)
    fraction = _instant(start) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round((x - year) * length * 86400, 0).cast("decimal(18,6)"))
    return (
        F.when(whole & (F.length(text) == 8), _instant(F.try_to_timestamp(text, F.lit("yyyyMMdd"))))
        .when(whole & (F.length(text) == 6), _instant(F.try_to_timestamp(F.concat(text, F.lit("01")), F.lit("yyyyMMdd"))))
        .when(x.between(1800, 2200), fraction)
    )


def decode_parts(year: Column, month: Column, day: Column) -> Column:
    """A date of a calendar of its own: a day that the month doesn't have becomes its last."""
    last = F.day(F.last_day(F.make_date(year, month, F.lit(1))))
    return _instant(F.make_date(year, month, F.least(day, last)))


def rescale_months(df: DataFrame, file: str, offset: str) -> DataFrame:
    """A file of twelve month offsets 0, 3 ... 33 is read as 0 ... 11."""
    w = W.partitionBy(file)
    tripled = (F.count(F.lit(1)).over(w) == 12) & (F.min(offset).over(w) == 0) & (F.max(offset).over(w) == 33) & (F.max(F.col(offset) % 3).over(w) == 0)
    return df.withColumn(offset, F.when(tripled, F.col(offset) / 3).otherwise(F.col(offset).cast("double")))


def shift(time: Column, amount: Column, unit: Column) -> Column:
    """time moved by a model's offset, such as -1 month; NULL offsets move nothing."""
    n = F.coalesce(amount, F.lit(0)).cast("int")
    months = F.when(unit.like("month%"), n).when(unit.like("year%"), 12 * n).otherwise(0)
    hours = F.when(unit.like("day%"), 24 * n).when(unit.like("hour%"), n).otherwise(0)
    return _instant(time + F.make_ym_interval(F.lit(0), months) + F.make_dt_interval(F.lit(0), hours, F.lit(0), F.lit(0)))


def stamp(time: str | Column, resolution: str) -> Column:
    """The canonical instant of a period: the 15th of a month, noon of a day, half past an hour, January 1."""
    into = {"month": "INTERVAL 14 DAYS", "day": "INTERVAL 12 HOURS", "hour": "INTERVAL 30 MINUTES", "year": "INTERVAL 0 DAYS"}[resolution]
    return _instant(F.date_trunc(resolution, time) + F.expr(into))


def first_per_stamp(df: DataFrame, keys: Sequence[str], resolution: str, order: str, time: str = "time") -> DataFrame:
    """Stamped rows; of those of one stamp the first by order."""
    stamped = df.withColumn("__s", stamp(time, resolution))
    n = F.row_number().over(W.partitionBy(*keys, "__s").orderBy(order))
    return stamped.withColumn("__n", n).filter("__n = 1").withColumn(time, F.col("__s")).drop("__s", "__n")


def axis(spark, start: str, end: str, resolution: str, time: str = "time") -> DataFrame:
    """Every canonical stamp from start to end."""
    step = {"month": "INTERVAL 1 MONTH", "day": "INTERVAL 1 DAY", "hour": "INTERVAL 1 HOUR", "year": "INTERVAL 1 YEAR"}[resolution]
    raw = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"), F.expr(step))).alias(time))
    return raw.withColumn(time, stamp(time, resolution))


def on_axis(df: DataFrame, keys: Sequence[str], steps: DataFrame, time: str = "time") -> DataFrame:
    """df on every step of the axis, with NULLs where it has no row. The axis is a bounded table."""
    return df.select(*keys).distinct().crossJoin(F.broadcast(steps)).join(df, [*keys, time], "left")


def missing(df: DataFrame, keys: Sequence[str], steps: DataFrame, time: str = "time") -> DataFrame:
    """Steps of the axis that a group has no row at."""
    return df.select(*keys).distinct().crossJoin(F.broadcast(steps)).join(df.select(*keys, time), [*keys, time], "left_anti")


def resample(df: DataFrame, keys: Sequence[str], resolution: str, *, total: bool = False, value: str = "value", time: str = "time") -> DataFrame:
    """The mean (or sum) per period: a unit of date_trunc, or a fixed length such as "8 days"."""
    period = F.date_trunc(resolution, time) if " " not in resolution else F.window(time, resolution)["start"]
    return df.groupBy(*keys, _instant(period).alias(time)).agg((F.sum if total else F.avg)(value).alias(value))


def adds_up(variable: str, unit: str) -> bool:
    """Whether resampling sums a variable instead of averaging it."""
    return variable.lower() in ACCUMULATED and unit.strip().lower() in ACCUMULATED_UNITS


def resample_by_kind(df: DataFrame, keys: Sequence[str], resolution: str, *, value: str = "value", time: str = "time") -> DataFrame:
    """Per period the sum of variables that add up, by name and unit (adds_up), and the mean of all others. df has variable and unit."""
    sums = F.lower("variable").isin(*ACCUMULATED) & F.lower(F.trim("unit")).isin(*ACCUMULATED_UNITS)
    by = [*keys, "variable", "unit"]
    got = df.groupBy(*by, _instant(F.date_trunc(resolution, time)).alias(time)).agg(F.sum(value).alias("__s"), F.avg(value).alias("__m"))
    return got.select(*by, time, F.when(sums, F.col("__s")).otherwise(F.col("__m")).alias(value))


def infer_step(df: DataFrame, keys: Sequence[str], time: str = "time") -> DataFrame:
    """(keys, days, resolution): the median step of each group's axis, and the class of resolutions that it belongs to."""
    times = df.select(*keys, F.col(time).cast("timestamp").cast("double").alias("__t"))
    gap = (F.col("__t") - F.lag("__t").over(W.partitionBy(*keys).orderBy("__t"))) / 86400
    # equal times follow each other; equal gaps are counted, so the median holds a row per gap and not per time
    steps = times.withColumn("__d", gap).filter("__d > 0 OR __d IS NULL").groupBy(*keys, "__d").agg(F.count(F.lit(1)).alias("__c"))
    d = F.col("days")
    name = F.when(d.isNull(), None)
    for resolution, most in CLASSES:
        name = name.when(d <= most, resolution)
    name = name.otherwise("year")
    return steps.groupBy(*keys).agg(F.percentile("__d", F.lit(0.5), F.col("__c")).alias("days")).withColumn("resolution", name)


def upsampled(steps: DataFrame, target: str) -> DataFrame:
    """Groups whose data are coarser than the target resolution, which resampling must refuse."""
    rank = F.create_map(*(F.lit(x) for kv in RESOLUTIONS.items() for x in kv))
    return steps.filter(rank[F.col("resolution")] > RESOLUTIONS[target])


def _distinct_times(df: DataFrame, file: str) -> DataFrame:
    """(file, n, __f, __u, __s): how many different __t each file has, and the largest of the others.

    Times that differ in whole hours only share a row: a block of 48 hours is the bits of a number, put together before the
    shuffle. What stands beside the times is a key there, as the largest of texts would have every row sorted.
    """
    kind = df.schema["__t"].dataType
    t = F.col("__t")
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        at = t.cast("timestamp")
        rest = F.pmod(F.unix_micros(at), F.lit(3600 * 10**6))
        hours = ((F.unix_micros(at) - rest) / 3600e6).cast("long")
        if isinstance(kind, T.TimestampNTZType):  # a time that the session's zone leaves out becomes one an hour later
            rest = F.when(at.cast("timestamp_ntz") != t, -1 - rest).otherwise(rest)
    else:
        hours, rest = F.when(t.isNotNull(), 0), t
    bit = F.when(t.isNotNull(), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(hours, F.lit(48)).cast("int")))
    blocks = df.groupBy(file, "__f", "__u", "__s", F.floor(hours / 48.0).alias("__block"), rest.alias("__rest")).agg(F.bit_or(bit).alias("__bits"))
    merged = blocks.groupBy(file, "__block", "__rest").agg(F.bit_or("__bits").alias("__bits"), F.max("__f").alias("__f"), F.max(F.lower("__u")).alias("__u"), F.max("__s").alias("__s"))
    return merged.groupBy(file).agg(F.coalesce(F.sum(F.bit_count("__bits")), F.lit(0)).cast("long").alias("n"), *(F.max(c).alias(c) for c in ("__f", "__u", "__s")))


def resolution_by_count(df: DataFrame, file: str, time: str = "time", *, files: str | Column = "year", units: str | Column | None = None, step: str | Column | None = None) -> DataFrame:
    """(file, n, resolution) from how many steps a file of a year, month or day has (files says which); NULL where no count fits.

    If units (of the time axis) name months, the raw step decides: month, or so many months, written 3month; and month where that is unclear.
    """
    n = F.col("n")
    col = lambda c: F.lit(None).cast("string") if c is None else F.col(c) if isinstance(c, str) else c
    groups = F.lit(files) if files in COUNTS else col(files)
    name = F.lit(None).cast("string")
    for group, rules in COUNTS.items():
        for low, high, resolution in rules:
            name = F.when((F.col("__f") == group) & n.between(low, high), resolution).otherwise(name)
    got = _distinct_times(df.select(F.col(file), F.col(time).alias("__t"), groups.alias("__f"), col(units).alias("__u"), col(step).cast("double").alias("__s")), file)
    s = F.col("__s")
    whole = F.round(s).cast("int")
    months = F.when((F.col("__f") == "year") & n.between(10, 13), "month").when(F.abs(s - 1) < 0.2, "month").when((whole > 1) & (F.abs(s - whole) < 0.2), F.concat(whole.cast("string"), F.lit("month"))).otherwise("month")
    return got.select(file, "n", F.when(F.col("__u").contains("month"), months).otherwise(name).alias("resolution"))


def resolution_by_span(df: DataFrame, keys: Sequence[str], time: str = "time") -> DataFrame:
    """(keys, n, resolution) from the span over the number of steps, within a tolerance of each resolution; NULL for one step or none that fits."""
    seconds = F.col(time).cast("timestamp").cast("double")
    got = df.groupBy(*keys).agg(F.countDistinct(time).alias("n"), (F.max(seconds) - F.min(seconds)).alias("__span"))
    hours = F.col("__span") / (F.col("n") - 1) / 3600
    name = F.when(F.col("n") <= 1, None)
    for resolution, low, high in SPANS:
        name = name.when((hours > low) & (hours < high), resolution)
    return got.select(*keys, "n", name.alias("resolution"))


def resolution_by_name(path: Column) -> Column:
    """The resolution that a part of a file name stands for: hourly before monthly before daily; NULL if none does."""
    stem = F.lower(F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", ""))
    name = F.lit(None).cast("string")
    for resolution, words in reversed(NAMED):
        name = F.when(stem.rlike(f"(^|[^a-z0-9])({'|'.join(words)})([^a-z0-9]|$)"), resolution).otherwise(name)
    return name


def use_years(project: tuple[Column, Column], sim: tuple[Column, Column], ref: tuple[Column, Column], strict: bool = False) -> tuple[Column, Column]:
    """The years that are compared: what all cover, or with strict those of the project."""
    return project if strict else (F.greatest(project[0], sim[0], ref[0]), F.least(project[1], sim[1], ref[1]))


def season(time: str | Column) -> Column:
    m = F.month(time)
    return F.when(m.isin(12, 1, 2), "DJF").when(m <= 5, "MAM").when(m <= 8, "JJA").otherwise("SON")


def water_year(time: str | Column, start_month: int) -> Column:
    return F.year(time) if start_month == 1 else F.year(time) + (F.month(time) >= start_month).cast("int")


def years(df: DataFrame, first: int, last: int, time: str = "time") -> DataFrame:
    """Rows from the start of first to the end of last; the filter reaches the scan."""
    if last < first:
        raise ValueError(f"{last} is before {first}")
    return df.filter(F.col(time).between(F.lit(f"{first}-01-01 00:00:00").cast("timestamp_ntz"), F.lit(f"{last}-12-31 23:59:59").cast("timestamp_ntz")))


def month_days(time: str | Column) -> Column:
    return F.day(F.last_day(time))


def annual_climatology(df: DataFrame, keys: Sequence[str], *, monthly: bool = True, value: str = "value", time: str = "time") -> DataFrame:
    """The mean over all time, months weighted by their days."""
    w = month_days(time) if monthly else F.lit(1)
    return df.groupBy(*keys).agg(ratio(F.sum(F.col(value) * w), F.sum(F.when(F.col(value).isNotNull(), w))).alias(value))


def monthly_climatology(df: DataFrame, keys: Sequence[str], *, value: str = "value", time: str = "time") -> DataFrame:
    """The mean per calendar month, weighted by days (29 in a leap year's February)."""
    w = month_days(time)
    return df.groupBy(*keys, F.month(time).alias("month")).agg(ratio(F.sum(F.col(value) * w), F.sum(F.when(F.col(value).isNotNull(), w))).alias(value))


def climatology_findings(names: Sequence[str], points: int) -> list[str]:
    """Why a climatology of so many points can't have these names; empty if it can."""
    bad = [f"{n} is not defined for a climatology" for n in names if n in NOT_CLIMATOLOGY]
    return bad + [f"{n} needs two points in time" for n in names if points < 2 and n in TWO_POINTS]


def climatology_gate(refs: DataFrame, sims: DataFrame, names: Sequence[str], time: str = "time") -> DataFrame:
    """(ref, sim, points, name, finding) per pair of refs(source, time) and sims(source, time) and name: why they can't be compared as climatologies; NULL if they can.

    The two axes must have the same dates; names that need a cycle or several years never fit, others need two points.
    """
    axis_of = lambda df, name: df.select(F.col("source").alias(name), F.to_date(time).alias("d")).distinct().groupBy(name).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.sort_array(F.collect_list("d")).alias(f"axis_{name}"))
    pairs = axis_of(refs, "ref").crossJoin(F.broadcast(axis_of(sims, "sim")))  # sources are few, and an axis of a climatology is short
    each = pairs.withColumn("name", F.explode(F.array(*map(F.lit, names))))
    said = (
        F.when(F.col("n_ref") != F.col("n_sim"), "axes of other lengths").when(F.col("axis_ref") != F.col("axis_sim"), "other dates")
        .when(F.col("name").isin(*NOT_CLIMATOLOGY), "not defined for a climatology").when(F.col("name").isin(*TWO_POINTS) & (F.col("n_ref") < 2), "needs two points in time")
    )
    return each.select("ref", "sim", F.col("n_ref").alias("points"), "name", said.alias("finding"))


def storage_change(df: DataFrame, keys: Sequence[str], variable: str = "Terrestrial_Water_Storage_Change", value: str = "value", time: str = "time") -> DataFrame:
    """For that variable the change since the step before; others as they are."""
    before = F.lag(value).over(W.partitionBy(*keys).orderBy(time))
    return df.withColumn(value, F.when(F.col("variable") == variable, F.col(value) - before).otherwise(F.col(value)))
