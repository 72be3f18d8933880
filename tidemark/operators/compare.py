"""Tables that compare models: across space, seasons, classes and ensembles."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.guards import ratio, root, weighted_mean
from ..functions.positions import positions
from ..functions.quantiles import clipped_median, quantiles
from ..sources.scratch import spooled

#: What distributions of these metrics are cut at from below.
FLOORS = {"KGE": -1.0, "KGESS": -1.0, "NSE": -1.0, "MFM": 0.0}


def heat_map(field: DataFrame, rows: Sequence[str], sims: Sequence[str], *, value: str = "value", weight: str | None = "w") -> DataFrame:
    """One column per sim: the weighted mean over cells (plain without weight). Radar maps draw the same table."""
    mean = weighted_mean(value, weight) if weight else F.avg(value)
    return field.groupBy(*rows).pivot("sim", list(sims)).agg(mean)


def parallel(field: DataFrame, keys: Sequence[str], scores: Sequence[str], *, weight: str = "w") -> DataFrame:
    """(keys, name, value) of field(keys, name, value, w): scores by weighted mean, metrics by the median of the middle 90 %."""
    is_score = F.col("name").isin(*scores)
    field = spooled(field.select(*keys, "name", "value", weight), "field")
    means = field.filter(is_score).groupBy(*keys, "name").agg(weighted_mean("value", weight).alias("value"))
    by = [*keys, "name"]
    medians = clipped_median(field.filter(~is_score), by, "value").select(*by, F.col("median").alias("value"))
    return means.unionByName(medians).filter("value IS NOT NULL")


def taylor(moments: DataFrame, keys: Sequence[str], weight: str = "w") -> DataFrame:
    """Spatial means of the standard deviations, r and CRMSD, the diagram's CRMSD from them, and all over the reference's deviation."""
    r = ratio(F.col("cov"), F.col("s_sd") * F.col("o_sd"))
    each = root(F.col("s_sd") * F.col("s_sd") + F.col("o_sd") * F.col("o_sd") - 2 * F.col("s_sd") * F.col("o_sd") * r)
    got = moments.withColumns({"__r": r, "__c": each}).groupBy(*keys).agg(*(weighted_mean(c, weight).alias(n) for c, n in (("s_sd", "sd_sim"), ("o_sd", "sd_ref"), ("__r", "r"), ("__c", "crmsd"))))
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("r")))
    got = got.withColumn("crmsd_diagram", root(F.col("sd_sim") * F.col("sd_sim") + F.col("sd_ref") * F.col("sd_ref") - 2 * F.col("sd_sim") * F.col("sd_ref") * clipped))
    by = lambda c: F.coalesce(ratio(F.col(c), F.col("sd_ref")), F.col(c))
    return got.withColumns({"sd_normalised": by("sd_sim"), "crmsd_normalised": by("crmsd_diagram")})


def distribution(field: DataFrame, name: str, value: str = "value") -> DataFrame:
    """Values with the floor of their metric."""
    return field.withColumn(value, F.greatest(F.col(value), F.lit(FLOORS[name]))) if name in FLOORS else field


#: Points that the values of a large group are dealt to before the kernel sums.
BINS = 4096


def density(field: DataFrame, keys: Sequence[str], *, points: int = 100, value: str = "value") -> DataFrame:
    """(keys, x, density): a Gaussian kernel estimate with Scott's bandwidth at points from the minimum to the maximum, over all values.

    A group of more than BINS values is dealt to BINS points first: each value counts for its two neighbours in proportion to its nearness, a mergeable grid
    that a task adds up by itself. So what is shuffled and summed is bounded per group. With bins d apart and a bandwidth h the density is then off by
    at most (d / h)^2 / 8 of the kernel's height; smaller groups are summed exactly.
    """
    kept = field.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    stats = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("__v").alias("sd"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    stats = spooled(stats.filter("n > 1 AND sd > 0").withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))), "density")
    step = (F.col("hi") - F.col("lo")) / (BINS - 1)
    place = (F.col("__v") - F.col("lo")) / step
    below = F.least(F.floor(place), F.lit(BINS - 2))
    bin_at = lambda k, w: F.struct((F.col("lo") + k * step).alias("at"), w.alias("w"))
    dealt = F.when(F.col("n") > BINS, F.array(bin_at(below, 1 - (place - below)), bin_at(below + 1, place - below))).otherwise(F.array(F.struct(F.col("__v").alias("at"), F.lit(1.0).alias("w"))))
    grid = kept.join(stats, list(keys)).select(*keys, "n", "h", "lo", "hi", F.explode(dealt).alias("b")).groupBy(*keys, "n", "h", "lo", "hi", F.col("b.at").alias("at")).agg(F.sum("b.w").alias("w"))
    x = F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: F.col("lo") + k * (F.col("hi") - F.col("lo")) / (points - 1))
    z = (F.col("x") - F.col("at")) / F.col("h")
    at = grid.withColumn("x", x).select(*keys, "n", "h", "at", "w", F.posexplode("x").alias("k", "x"))
    return at.groupBy(*keys, "k", "x").agg((F.sum(F.col("w") * F.exp(-z * z / 2)) / (F.max("n") * F.max("h") * float(np.sqrt(2 * np.pi)))).alias("density")).drop("k")


def whiskers(field: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    got = quantiles(field, keys, value, (0.0, 0.25, 0.5, 0.75, 1.0))
    return got.select(*keys, "n", *(F.col("q")[k].alias(n) for k, n in enumerate(("low", "q25", "median", "q75", "high"))))


def basic_pairs(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, and mean, median, max, min, sum of both sides as ref_<name> and sim_<name>) of paired rows: the basic comparison at stations."""
    named = {"mean": F.avg, "median": F.median, "max": F.max, "min": F.min, "sum": F.sum}
    return pairs.dropna(subset=["s", "o"]).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(f(c).alias(f"{side}_{name}") for side, c in (("ref", "o"), ("sim", "s")) for name, f in named.items()))


def ensemble(field: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """With the mean over sims per cell and name, and each sim's anomaly."""
    return field.withColumn("ensemble", F.avg(value).over(W.partitionBy(*keys))).withColumn("anomaly", F.col(value) - F.col("ensemble"))


def differences(field: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, sim_a, sim_b, difference) of every two sims, a before b. The models are few; cells stay an equi-join."""
    a = field.select(*keys, F.col("sim").alias("sim_a"), F.col(value).alias("__a"))
    b = field.select(*keys, F.col("sim").alias("sim_b"), F.col(value).alias("__b"))
    return a.join(b, list(keys)).filter("sim_a < sim_b").select(*keys, "sim_a", "sim_b", (F.col("__a") - F.col("__b")).alias("difference"))


def relative_score(field: DataFrame, keys: Sequence[str], *, station: bool = False, value: str = "value") -> DataFrame:
    """(score - mean over sims) / deviation over sims: ddof 0 on grids, 1 at stations; NULL for one sim or no deviation."""
    w = W.partitionBy(*keys)
    sd = (F.stddev_samp if station else F.stddev_pop)(value).over(w)
    return field.withColumn("relative", F.when(F.count(value).over(w) >= 2, ratio(F.col(value) - F.avg(value).over(w), sd)))


def between_sims(series: DataFrame, on: Sequence[str], keys: Sequence[str], value: str = "value") -> DataFrame:
    """(keys, sim_a, sim_b, r) of the series of every two sims."""
    a = series.select(*on, F.col("source").alias("sim_a"), F.col(value).alias("x"))
    b = series.select(*on, F.col("source").alias("sim_b"), F.col(value).alias("y"))
    both = a.join(b, list(on)).filter("sim_a < sim_b AND x IS NOT NULL AND y IS NOT NULL")
    return both.groupBy(*keys, "sim_a", "sim_b").agg(ratio(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y")).alias("r"))


#: Times of a block of a series, and replicates that are drawn at once.
BLOCK, AT_ONCE = 4096, 250


def _generator(*seed: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([s & 0xFFFFFFFFFFFFFFFF for s in seed])))


@functools.lru_cache(64)
def drawn(unit: int, n: int, block: int, replicates: int, seed: int) -> np.ndarray:
    """How often each time of a block of a series of n times is drawn, one row per replicate; over all blocks a replicate draws n times with replacement.

    A replicate's draws are dealt to the two halves of the series by a binomial draw, and so on down to the block, where they are
    dealt to its times. Every number comes from the seed, the series and the part alone, so tasks agree without a common table.
    """
    first, end, count = 0, -(-n // BLOCK), np.full(replicates, n, np.int64)
    times = lambda k: min(n, k * BLOCK)
    while end - first > 1:
        middle = (first + end + 1) // 2
        left = _generator(seed, unit, first, end).binomial(count, (times(middle) - times(first)) / (times(end) - times(first)))
        first, end, count = (first, middle, left) if block < middle else (middle, end, count - left)
    size = times(block + 1) - times(block)
    rng = _generator(seed, unit, block, end, 1)
    return np.concatenate([rng.multinomial(count[k : k + AT_ONCE], np.full(size, 1 / size)) for k in range(0, replicates, AT_ONCE)]).astype(np.int32)


def _replicates(pairs: DataFrame, field: Sequence[str], cell: str, weight: str, time: str, own_axis: bool, replicates: int, seed: int) -> DataFrame:
    """(field, cell, weight, b, x): (mean s - mean o)^2 / var1(o) of each cell in each replicate; NULL where that variance is 0.

    With own_axis every cell draws from its own times, else all cells of a field draw the same times of the field's axis. Cells are worked on by blocks of times,
    so no task holds a long series, and the blocks' sums are added up.
    """
    pairs = pairs.dropna(subset=["s", "o"]).select(*field, cell, weight, F.col(time).alias("__t"), "s", "o")
    if own_axis:
        placed = positions(pairs, [*field, cell], ["__t"], position="__p", total="__n")
    else:
        axis = spooled(positions(pairs.select(*field, "__t").distinct(), list(field), ["__t"], position="__p", total="__n"), "axis")
        placed = pairs.join(axis, [*field, "__t"])
    unit = F.xxhash64(*(F.col(c).cast("string") for c in ([*field, cell] if own_axis else ())), F.lit(0)) if own_axis else F.lit(0).cast("long")
    by = [*field, cell, weight]
    middle = pairs.groupBy(*field, cell).agg(F.avg("o").alias("__m"))
    blocks = placed.join(middle, [*field, cell]).withColumns({"__block": F.floor(F.col("__p") / BLOCK).cast("long"), "__unit": unit}).groupBy(*by, "__unit", "__n", "__block").agg(
        F.collect_list(F.struct((F.col("__p") % BLOCK).cast("int").alias("p"), (F.col("s") - F.col("__m")).alias("s"), (F.col("o") - F.col("__m")).alias("o"))).alias("__rows")
    )
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blocks.select(*by).schema.fields)

    def run(batches):
        for batch in batches:
            columns = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            for r in range(batch.num_rows):
                rows = columns["__rows"][r].values
                p, s, o = (rows.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                times = drawn(columns["__unit"][r].as_py(), columns["__n"][r].as_py(), columns["__block"][r].as_py(), replicates, seed)[:, p]
                sums = [times.sum(1).astype(float), times @ s, times @ o, times @ (o * o)]
                same = [pa.array([columns[n][r].as_py()] * replicates, columns[n].type) for n in by]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(replicates)), *map(pa.array, sums)], names=[*by, "b", "n", "ss", "so", "oo"])

    parts = blocks.mapInArrow(run, f"{names}, b long, n double, ss double, so double, oo double")
    whole = parts.groupBy(*by, "b").agg(*(F.sum(c).alias(c) for c in ("n", "ss", "so", "oo")))
    n, so = F.col("n"), F.col("so")
    left = F.col("oo") - so * so / n
    var = F.when((n > 1) & (left > 1e-12 * F.col("oo")), left / (n - 1))
    return whole.select(*by, "b", F.when(n > 0, ratio(F.pow((F.col("ss") - so) / n, 2), var)).alias("x"))


def _points(pairs: DataFrame, field: Sequence[str], cell: str, weight: str) -> DataFrame:
    got = pairs.dropna(subset=["s", "o"]).groupBy(*field, cell, weight).agg(F.avg("o").alias("om"), F.var_samp("o").alias("v"), F.avg("s").alias("sm"))
    return got.select(*field, cell, weight, F.when(F.col("v") != 0, ratio(F.pow(F.col("sm") - F.col("om"), 2), F.col("v"))).alias("x"))


def smpi_bootstrap(pairs: DataFrame, field: Sequence[str], cell: str, *, replicates: int = 1000, seed: int = 0, weight: str = "w", time: str = "time", levels: Sequence[float] = (0.05, 0.95)) -> DataFrame:
    """(field, value, low, high): the weighted mean over cells of (mean s - mean o)^2 / var1(o), and its bootstrap over time.

    A replicate draws as many times as the axis has, with replacement, and all cells take the same ones; means and variance are those of the drawn times.
    """
    value = _points(pairs, field, cell, weight).groupBy(*field).agg(weighted_mean("x", weight).alias("value"))
    each = _replicates(pairs, field, cell, weight, time, False, replicates, seed).groupBy(*field, "b").agg(weighted_mean("x", weight).alias("x"))
    band = each.groupBy(*field).agg(F.percentile("x", F.array(*(F.lit(p) for p in levels))).alias("q"))
    return value.join(band, list(field)).select(*field, "value", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def smpi_stations(pairs: DataFrame, field: Sequence[str], station: str = "station_id", *, replicates: int = 100, seed: int = 0, time: str = "time", levels: Sequence[float] = (0.05, 0.95)) -> DataFrame:
    """(field, value, low, high): means over stations of each one's index and of the bounds of its own bootstrap."""
    flat = pairs.withColumn("__w", F.lit(1.0))
    value = _points(flat, field, station, "__w")
    each = _replicates(flat, field, station, "__w", time, True, replicates, seed)
    band = each.groupBy(*field, station).agg(F.percentile("x", F.array(*(F.lit(p) for p in levels))).alias("q"))
    both = value.select(*field, station, "x").join(band, [*field, station])
    return both.groupBy(*field).agg(F.avg("x").alias("value"), F.avg(F.col("q")[0]).alias("low"), F.avg(F.col("q")[1]).alias("high"))


def score_choices(table: DataFrame, items: Sequence[str], sims: Sequence[str], *, limit: int = 100) -> DataFrame:
    """(choice, sim, one column per item) of table(item, ref, sim, value): every choice of one reference per item, up to limit choices."""
    names = [f"ref_{i}" for i in items]
    # the n-th choice in order has the digits of n as places in the items' lists of references; nothing is multiplied out
    lists = table.groupBy().agg(*(F.array_sort(F.collect_set(F.when(F.col("item") == item, F.col("ref")))).alias(f"refs_{item}") for item in items))
    choices = table.sparkSession.range(limit).crossJoin(F.broadcast(lists)).withColumn("rest", F.col("id"))
    for item in reversed(items):
        size = F.size(f"refs_{item}")
        choices = choices.filter(size > 0).withColumns({f"ref_{item}": F.get(f"refs_{item}", F.pmod("rest", size).cast("int")), "rest": F.floor(F.col("rest") / size)})
    choices = choices.filter("rest = 0").select(*names, F.concat_ws("|", *names).alias("choice"))
    out = choices.crossJoin(F.broadcast(table.filter(F.col("sim").isin(*sims)).select("sim").distinct()))
    for item in items:
        one = table.filter(F.col("item") == item).select(F.col("ref").alias(f"ref_{item}"), "sim", F.col("value").alias(item))
        out = out.join(one, [f"ref_{item}", "sim"], "left")
    return out.select("choice", "sim", *items)


def by_class(field: DataFrame, mask: DataFrame, keys: Sequence[str], scores: Sequence[str], *, weight: str = "w", cell: str = "cell") -> DataFrame:
    """(keys, class_id, name, value) of field(keys, cell, name, value, w), and the same over all classes as class_id NULL.

    Metrics are medians of the middle 90 % of their class, scores weighted means. Land cover, plant types and climate zones
    differ in the mask alone.
    """
    classed = field.join(mask, cell)
    both = classed.withColumn("class_id", F.explode(F.array("class_id", F.lit(-1).cast(mask.schema["class_id"].dataType))))
    got = parallel(both, [*keys, "class_id"], scores, weight=weight)
    return got.withColumn("class_id", F.when(F.col("class_id") >= 0, F.col("class_id")))
