"""Space: axes, regridding by small weight tables, stations on grids, weights."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.guards import ratio, weighted_mean
from ..sources.scratch import spooled

STATISTICS = {"sum": F.sum, "mean": F.avg, "var": F.var_pop, "std": F.stddev_pop, "median": F.median, "max": F.max, "min": F.min}

#: How often the side of a search's squares is halved at most.
MOST_HALVINGS = 12


def axis(spark: SparkSession, low: float, high: float, step: float, name: str) -> DataFrame:
    """(i_name, name): centres from low + step/2, one per step up to high."""
    n = int(round((high - low) / step))
    return spark.range(n).select(F.col("id").cast("int").alias(f"i_{name}"), (F.lit(low + step / 2) + F.col("id") * step).alias(name))


def bounds(axis_table: DataFrame, name: str) -> DataFrame:
    """The axis with lo and hi: midpoints between neighbours, and as far out at the ends. Axes are small: one task orders one."""
    w = W.orderBy(name)
    before, after = F.lag(name).over(w), F.lead(name).over(w)
    x = F.col(name)
    return axis_table.withColumns({"lo": F.coalesce((before + x) / 2, x - (after - x) / 2), "hi": F.coalesce((x + after) / 2, x + (x - before) / 2)})


def overlap_weights(source: DataFrame, target: DataFrame, name: str, *, latitude: bool = False) -> DataFrame:
    """(src, tgt, w): the part of a target cell that each source cell covers, on one axis; on a sphere if latitude.

    The cells' intervals are joined where they overlap. Axes are one-dimensional and short, so this never is a join of grids.
    """
    s = bounds(source, name).select(F.col(f"i_{name}").alias("src"), F.col("lo").alias("slo"), F.col("hi").alias("shi"))
    t = bounds(target, name).select(F.col(f"i_{name}").alias("tgt"), F.col("lo").alias("tlo"), F.col("hi").alias("thi"))
    a, b = F.greatest("slo", "tlo"), F.least("shi", "thi")
    part = F.sin(F.radians(b)) - F.sin(F.radians(a)) if latitude else b - a
    joined = s.join(F.broadcast(t), (F.col("slo") < F.col("thi")) & (F.col("tlo") < F.col("shi"))).select("src", "tgt", part.alias("part"))
    return joined.withColumn("w", F.col("part") / F.sum("part").over(W.partitionBy("tgt"))).drop("part")


def conservative(df: DataFrame, lat_weights: DataFrame, lon_weights: DataFrame, others: Sequence[str], *, nan_threshold: float = 0.0, value: str = "value") -> DataFrame:
    """(i_lat, i_lon, others, value) on the target grid: the mean of the covered parts.

    A target cell stays if its valid part is 1 - nan_threshold or more; at 0, one missing source cell voids it.
    First longitudes are summed up, then latitudes, so that a row meets few weights each time.
    """
    limit = min(max(nan_threshold, 1e-6), 1 - 1e-6)
    lon = F.broadcast(lon_weights.withColumnsRenamed({"src": "i_lon", "tgt": "t_lon", "w": "w_lon"}))
    lat = F.broadcast(lat_weights.withColumnsRenamed({"src": "i_lat", "tgt": "t_lat", "w": "w_lat"}))
    rows = df.join(lon, "i_lon").groupBy("i_lat", "t_lon", *others).agg(F.sum(F.col("w_lon") * F.col(value)).alias("wv"), F.sum(F.when(F.col(value).isNotNull(), F.col("w_lon"))).alias("wn"))
    got = rows.join(lat, "i_lat").groupBy("t_lat", "t_lon", *others).agg(F.sum(F.col("w_lat") * F.col("wv")).alias("wv"), F.sum(F.col("w_lat") * F.col("wn")).alias("wn"))
    return got.select(F.col("t_lat").alias("i_lat"), F.col("t_lon").alias("i_lon"), *others, F.when(F.col("wn") >= 1 - limit - 1e-12, ratio(F.col("wv"), F.col("wn"))).alias(value))


def pad_poles(df: DataFrame, others: Sequence[str], step: float, *, value: str = "value") -> DataFrame:
    """A row at either pole, the mean over longitudes of the outermost row, where that lies within a step of it."""
    ends = df.agg(F.min("lat").alias("a"), F.max("lat").alias("b"))
    out = df
    for edge, pole in (("a", -90.0), ("b", 90.0)):
        near = df.join(F.broadcast(ends), F.col("lat") == F.col(edge)).filter((F.abs(F.lit(pole) - F.col("lat")) <= step) & (F.col("lat") != pole))
        mean = F.avg(value).over(W.partitionBy("lat", *others))
        out = out.unionByName(near.withColumns({value: mean, "lat": F.lit(pole)}).select(df.columns))
    return out


def pad_date_line(df: DataFrame, width: float) -> DataFrame:
    """Copies of the rows within width of either end of the circle, at longitudes beyond it."""
    copy = F.explode(F.array(F.lit(0.0), F.lit(360.0), F.lit(-360.0)))
    return df.withColumn("__c", copy).withColumn("lon", F.col("lon") + F.col("__c")).filter((F.col("__c") == 0) | F.col("lon").between(-180 - width, 180 + width)).drop("__c")


def linear_weights(source: DataFrame, target: DataFrame, name: str) -> DataFrame:
    """(src, tgt, w): the two source points round each target point and their parts; none outside the source axis."""
    w = W.orderBy(name)
    s = source.select(F.col(f"i_{name}").alias("a"), F.col(name).alias("x0"), F.lead(f"i_{name}").over(w).alias("b"), F.lead(name).over(w).alias("x1"), F.max(name).over(W.partitionBy()).alias("top"))
    t = target.select(F.col(f"i_{name}").alias("tgt"), F.col(name).alias("x"))
    inside = ((F.col("x0") <= F.col("x")) & (F.col("x") < F.col("x1"))) | (F.col("b").isNull() & (F.col("x") == F.col("top")))
    part = F.coalesce(ratio(F.col("x") - F.col("x0"), F.col("x1") - F.col("x0")), F.lit(0.0))
    found = t.join(F.broadcast(s), inside).select("tgt", F.explode(F.array(F.struct(F.col("a").alias("src"), (1 - part).alias("w")), F.struct(F.col("b").alias("src"), part.alias("w")))).alias("p"))
    return found.select("p.src", "tgt", "p.w").filter("src IS NOT NULL AND w > 0")


def nearest_weights(source: DataFrame, target: DataFrame, name: str, tolerance: float | None = None) -> DataFrame:
    """(src, tgt, w = 1): the nearest source point, the smaller of two as near."""
    d = F.abs(F.col(name) - F.col("x"))
    t = target.select(F.col(f"i_{name}").alias("tgt"), F.col(name).alias("x"))
    got = t.crossJoin(F.broadcast(source)).groupBy("tgt").agg(F.min(F.struct(d.alias("d"), F.col(f"i_{name}").alias("src"))).alias("n"))
    return got.filter(F.lit(tolerance is None) | (F.col("n.d") <= (tolerance or 0.0))).select(F.col("n.src").alias("src"), "tgt", F.lit(1.0).alias("w"))


def interpolate(df: DataFrame, lat_weights: DataFrame, lon_weights: DataFrame, others: Sequence[str], *, value: str = "value") -> DataFrame:
    """Bilinear or nearest values by weight tables; NULL if a point that counts is missing, no row outside the source."""
    lon = F.broadcast(lon_weights.withColumnsRenamed({"src": "i_lon", "tgt": "t_lon", "w": "w_lon"}))
    lat = F.broadcast(lat_weights.withColumnsRenamed({"src": "i_lat", "tgt": "t_lat", "w": "w_lat"}))
    w = F.col("w_lon") * F.col("w_lat")
    got = df.join(lon, "i_lon").join(lat, "i_lat").groupBy("t_lat", "t_lon", *others).agg(F.sum(w * F.col(value)).alias("v"), F.sum(F.when(F.col(value).isNotNull(), w)).alias("n"))
    return got.select(F.col("t_lat").alias("i_lat"), F.col("t_lon").alias("i_lon"), *others, F.when(F.col("n") >= 1 - 1e-9, F.col("v")).alias(value))


def cubic_spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline with not-a-knot ends through (x, y); the line or parabola for two or three points."""
    n = len(x)
    if n < 4:
        return np.polyval(np.polyfit(x, y, n - 1), at)
    h, d = np.diff(x), np.diff(y) / np.diff(x)
    a, r = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i], 2 * (h[i - 1] + h[i]), h[i - 1]
        r[i] = 3 * (h[i] * d[i - 1] + h[i - 1] * d[i])
    a[0, :2], r[0] = (h[1], h[0] + h[1]), ((h[0] + 2 * (h[0] + h[1])) * h[1] * d[0] + h[0] ** 2 * d[1]) / (h[0] + h[1])
    a[-1, -2:], r[-1] = (h[-1] + h[-2], h[-2]), (h[-1] ** 2 * d[-2] + (2 * (h[-1] + h[-2]) + h[-1]) * h[-2] * d[-1]) / (h[-1] + h[-2])
    s = np.linalg.solve(a, r)
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, n - 2)
    t, step = at - x[k], h[k]
    return y[k] + t * (s[k] + t * ((3 * d[k] - 2 * s[k] - s[k + 1]) / step + t * (s[k] + s[k + 1] - 2 * d[k]) / step**2))


def cubic_matrix(x: Sequence[float], at: Sequence[float]) -> np.ndarray:
    """What each point of the axis x counts for at each point of at: a spline through values is linear in them. One row per point of at."""
    x = np.asarray(x, dtype=float)
    return np.stack([cubic_spline(x, unit, np.asarray(at, dtype=float)) for unit in np.eye(len(x))], axis=1)


def cubic_axis(df: DataFrame, points: Sequence[float], others: Sequence[str], name: str, *, value: str = "value") -> DataFrame:
    """(others, name, value) at points along one axis by a cubic spline per line of the grid; lines with a gap give NULL, points off the axis no row.

    The weights of the axis, which is short, are solved for once; each line, no longer than the axis, is multiplied with them in the JVM. Once per axis regrids a grid.
    """
    x = sorted(r[0] for r in df.select(F.col(name).cast("double")).distinct().dropna().collect())
    at = [float(p) for p in sorted(points) if x and x[0] <= p <= x[-1]]
    weights = cubic_matrix(x, at).tolist() if len(x) > 1 else [[float("nan")] * len(x) for _ in at]
    table = F.array(*(F.struct(F.lit(p).alias("at"), F.array(*map(F.lit, w)).alias("w")) for p, w in zip(at, weights, strict=True))) if at else F.array().cast("array<struct<at:double,w:array<double>>>")
    line = F.transform(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(F.col(name).cast("double").alias("x"), F.col(value).cast("double").alias("v"))))), lambda p: p["v"])
    lines = df.groupBy(*others).agg(line.alias("__line")).withColumn("__w", F.explode(table))
    dot = F.aggregate(F.zip_with("__line", "__w.w", lambda v, w: v * w), F.lit(0.0), lambda a, b: a + b)
    return lines.select(*others, F.col("__w.at").alias(name), F.when((F.size("__line") == len(x)) & (len(x) > 1), dot).alias(value))


def zonal(df: DataFrame, step: float, others: Sequence[str], statistic: str, *, skip_missing: bool = True, low: tuple[float, float] = (-90.0, -180.0), value: str = "value") -> DataFrame:
    """A statistic per block of the target grid, blocks closed on the left. Points of an irregular grid need no more than this."""
    i, j = F.floor((F.col("lat") - low[0]) / step).cast("int"), F.floor((F.col("lon") - low[1]) / step).cast("int")
    got = STATISTICS[statistic](value)
    if not skip_missing:
        got = F.when(F.count(value) == F.count(F.lit(1)), got)
    return df.groupBy(i.alias("i_lat"), j.alias("i_lon"), *others).agg(got.alias(value))


def most_common(df: DataFrame, by: Sequence[str], classes: Sequence[int], *, least: bool = False, value: str = "value") -> DataFrame:
    """The most common of the classes per group, the smallest of equals; with least the rarest, where a class that is absent wins."""
    kept = df.filter(F.col(value).isin(*classes))
    counts = kept.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    if least:
        every = df.select(*by).distinct().withColumn(value, F.explode(F.array(*map(F.lit, classes))))
        counts = every.join(counts, [*by, value], "left").fillna(0, ["n"])
    order = F.col("n") if least else -F.col("n")
    return counts.groupBy(*by).agg(F.min(F.struct(order.alias("o"), F.col(value).alias("v")))["v"].alias(value))


def _side(p: Column, q: Column, r: Column) -> Column:
    """Twice the signed area of a triangle: positive if r lies to the left of the way from p to q."""
    return (q["lon"] - p["lon"]) * (r["lat"] - p["lat"]) - (q["lat"] - p["lat"]) * (r["lon"] - p["lon"])


def _in_circle(p: Column, q: Column, r: Column, s: Column) -> Column:
    """Whether s lies within the circle through p, q and r."""
    row = lambda x: (x["lon"] - s["lon"], x["lat"] - s["lat"])
    (ax, ay), (bx, by), (cx, cy) = row(p), row(q), row(r)
    det = (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay)
    return det * F.signum(_side(p, q, r)) > 0


def mesh_triangles(mesh: DataFrame) -> DataFrame:
    """(qi, qj, k, a, b, c): the triangles of a curvilinear grid mesh(i, j, lat, lon), corners as (i, j, lat, lon).

    Each point goes to the four cells that it is a corner of, so one exchange gathers the corners. A cell is cut along the diagonal that lies inside it, and if both
    do along the one whose triangles' circles hold no fourth corner. With one corner missing a cell is one triangle; points without coordinates are missing.
    """
    at = lambda di, dj: F.struct((F.col("i") - di).alias("qi"), (F.col("j") - dj).alias("qj"), F.lit(2 * di + dj).alias("corner"))
    point = F.struct("i", "j", "lat", "lon")
    placed = mesh.filter("lat IS NOT NULL AND lon IS NOT NULL").select(F.explode(F.array(at(0, 0), at(0, 1), at(1, 0), at(1, 1))).alias("at"), point.alias("p")).select("at.*", "p")
    corners = placed.groupBy("qi", "qj").agg(*(F.max(F.when(F.col("corner") == k, F.col("p"))).alias(f"p{k}") for k in range(4)))
    a, b, c, d = (F.col(f"p{k}") for k in range(4))  # b and c lie between a and d
    tri = lambda k, x, y, z: F.struct(F.lit(k).alias("k"), x.alias("a"), y.alias("b"), z.alias("c"))
    across, along = _side(b, c, a) * _side(b, c, d) < 0, _side(a, d, b) * _side(a, d, c) < 0
    turned = along & (~across | _in_circle(a, b, c, d))
    whole = F.when(turned, F.array(tri(0, a, b, d), tri(1, a, d, c))).otherwise(F.array(tri(0, a, b, c), tri(1, d, c, b)))
    three = F.when(a.isNull(), F.array(tri(0, d, c, b))).when(b.isNull(), F.array(tri(0, a, d, c))).when(c.isNull(), F.array(tri(0, a, b, d))).otherwise(F.array(tri(0, a, b, c)))
    there = sum(p.isNotNull().cast("int") for p in (a, b, c, d))
    cut = corners.filter(there >= 3).select("qi", "qj", F.explode(F.when(there == 4, whole).otherwise(three)).alias("t")).select("qi", "qj", "t.*")
    return cut.filter(_side(F.col("a"), F.col("b"), F.col("c")) != 0)


def mesh_weights(triangles: DataFrame, step: float, origin: tuple[float, float] | None = None) -> DataFrame:
    """(i, j, i_lat, i_lon, w): what each mesh point counts for at the points origin + step * (i_lat, i_lon), that lie in a triangle.

    A triangle meets only the target points in its own bounding box, so points are located without a product of grids; their number follows the area. A
    point on a shared edge takes the first triangle, which gives the same value. The origin is the mesh's lowest latitude and longitude, from where targets reach up.
    """
    corner = [F.col(c) for c in "abc"]
    if origin is None:
        low = triangles.agg(*(F.min(F.least(*(c[n] for c in corner))).alias(f"o_{n}") for n in ("lat", "lon")))
        placed = triangles.crossJoin(F.broadcast(low))
    else:
        placed = triangles.withColumns({"o_lat": F.lit(float(origin[0])), "o_lon": F.lit(float(origin[1]))})
    box = {}
    for n in ("lat", "lon"):
        ends = [(f(*(c[n] for c in corner)) - F.col(f"o_{n}")) / step for f in (F.least, F.greatest)]
        box |= {f"lo_{n}": F.greatest(F.ceil(ends[0] - 1e-9), F.lit(0)).cast("int"), f"hi_{n}": F.floor(ends[1] + 1e-9).cast("int")}
    touched = placed.withColumns(box).filter("lo_lat <= hi_lat AND lo_lon <= hi_lon").withColumn("i_lat", F.explode(F.sequence("lo_lat", "hi_lat"))).withColumn("i_lon", F.explode(F.sequence("lo_lon", "hi_lon")))
    at = F.struct((F.col("o_lat") + F.col("i_lat") * step).alias("lat"), (F.col("o_lon") + F.col("i_lon") * step).alias("lon"))
    a, b, c = corner
    parts = [_side(b, c, at) / _side(a, b, c), _side(c, a, at) / _side(a, b, c), _side(a, b, at) / _side(a, b, c)]
    point = lambda p, w: F.struct(p["i"].alias("i"), p["j"].alias("j"), F.greatest(w, F.lit(0.0)).alias("w"))
    inside = touched.filter(F.least(*parts) >= -1e-9).select("i_lat", "i_lon", F.struct("qi", "qj", "k", F.array(*(point(p, w) for p, w in zip(corner, parts, strict=True))).alias("points")).alias("t"))
    first = inside.groupBy("i_lat", "i_lon").agg(F.min_by("t", F.struct("t.qi", "t.qj", "t.k")).alias("t"))
    return first.select("i_lat", "i_lon", F.explode("t.points").alias("p")).select("p.i", "p.j", "i_lat", "i_lon", "p.w").filter("w > 0")


def on_mesh(df: DataFrame, weights: DataFrame, others: Sequence[str], *, value: str = "value") -> DataFrame:
    """(i_lat, i_lon, others, value): linear interpolation of df(i, j, others, value) by mesh weights. NULL if a corner that counts is missing; no row outside the mesh."""
    w = F.col("w")
    got = df.join(weights, ["i", "j"]).groupBy("i_lat", "i_lon", *others).agg(F.sum(w * F.col(value)).alias("v"), F.sum(F.when(F.col(value).isNotNull(), w)).alias("n"))
    return got.select("i_lat", "i_lon", *others, F.when(F.col("n") >= 1 - 1e-9, F.col("v") / F.col("n")).alias(value))


def at_stations(df: DataFrame, stations: DataFrame, lats: DataFrame, lons: DataFrame, resolution: float, *, key: str = "station_id", tolerance: float | None = None) -> DataFrame:
    """(station, rest of df): the values of the cell nearest to each station, by axis. Stations farther than the tolerance have no row."""
    limit = resolution / 2 if tolerance is None else tolerance
    s = stations.select(key, F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    d = F.abs(F.col("slon") - F.col("lon"))
    la = s.crossJoin(F.broadcast(lats)).groupBy(key).agg(F.min(F.struct(F.abs(F.col("slat") - F.col("lat")).alias("d"), "i_lat")).alias("a"))
    lo = s.crossJoin(F.broadcast(lons)).groupBy(key).agg(F.min(F.struct(F.least(d, 360 - d).alias("d"), "i_lon")).alias("b"))
    cells = la.join(lo, key).filter((F.col("a.d") <= limit + 1e-9) & (F.col("b.d") <= limit + 1e-9)).select(key, "a.i_lat", "b.i_lon")
    return df.join(cells, ["i_lat", "i_lon"])


def match_stations(sims: DataFrame, refs: DataFrame, *, key: str = "station_id", radius: float = 0.01, per_square: int = 4) -> DataFrame:
    """(sim id, ref id, distance): equal ids, or if there are none the nearest ref within radius.

    Refs are looked for in the neighbouring squares. Squares as wide as the radius may hold many, so the first have a side at which
    per_square refs lie in one on the average; a place with none within a side goes on to squares twice as wide, up to the radius.
    Places are compared, with the smallest id of each; how wide the first squares are doesn't change results.
    """
    same = sims.join(refs, key).select(F.col(key).alias("sim_id"), F.col(key).alias("ref_id"), F.lit(0.0).alias("distance"))
    if not same.isEmpty():
        return same
    a = spooled(sims.filter("lat IS NOT NULL AND lon IS NOT NULL").groupBy(F.col("lat").alias("a"), F.col("lon").alias("b")).agg(F.count(F.lit(1)).alias("n")).drop("n"), "places")
    b = spooled(refs.filter("lat IS NOT NULL AND lon IS NOT NULL").groupBy("lat", "lon").agg(F.min(key).alias("ref_id")), "places")
    square = lambda c, side: F.floor(F.col(c) / side).cast("long")
    held = b.agg(F.count(F.lit(1)), *(F.approx_count_distinct(F.struct(square("lat", radius / 2**k), square("lon", radius / 2**k))) for k in range(MOST_HALVINGS + 1))).first()
    halvings = next((k for k, n in enumerate(held[1:]) if held[0] <= per_square * n), MOST_HALVINGS)
    around = F.sequence(F.lit(-1), F.lit(1))
    d = F.sqrt(F.pow(F.col("a") - F.col("lat"), 2) + F.pow(F.col("b") - F.col("lon"), 2))
    open_, found = a, []
    for k in range(halvings, -1, -1):
        side = radius / 2**k
        own = open_.withColumns({"i": square("a", side), "j": square("b", side)}).withColumn("di", F.explode(around)).withColumn("dj", F.explode(around)).select("a", "b", (F.col("i") + F.col("di")).alias("i"), (F.col("j") + F.col("dj")).alias("j"))
        close = own.join(b.withColumns({"i": square("lat", side), "j": square("lon", side)}), ["i", "j"]).withColumn("distance", d).filter(F.col("distance") <= (side * (1 - 1e-9) if k else side))  # what rounding puts two squares off waits
        # the nearest distance first: the least of structs would have every pair sorted
        least = close.groupBy("a", "b", "distance").agg(F.min("ref_id").alias("ref_id")).groupBy("a", "b").agg(F.min(F.struct("distance", "ref_id")).alias("m"))
        found.append(spooled(least.select("a", "b", "m.ref_id", "m.distance"), "nearest"))
        open_ = open_.join(found[-1], ["a", "b"], "left_anti")
    places = sims.select(F.col(key).alias("sim_id"), F.col("lat").alias("a"), F.col("lon").alias("b"))
    near = places.join(functools.reduce(DataFrame.unionByName, found), ["a", "b"]).groupBy("sim_id").agg(F.min(F.struct("distance", "ref_id")).alias("m"))
    return near.select("sim_id", "m.ref_id", "m.distance")


def usable_stations(stations: DataFrame, *, min_years: int = 1, inclusive: bool = True, lat: tuple[float, float] = (-90, 90), lon: tuple[float, float] = (-180, 180), area: tuple[float, float] | None = None, max_error: float | None = None) -> DataFrame:
    """Stations with use_syear, use_eyear whose span, place, upstream area and allocation error are within limits.

    stations has syears and eyears (arrays), lat, lon, and area or error where limits on them are given.
    """
    span = F.col("use_eyear") - F.col("use_syear") + (1 if inclusive else 0)
    out = stations.withColumns({"use_syear": F.array_max("syears"), "use_eyear": F.array_min("eyears")})
    out = out.filter((span >= min_years) & F.col("lat").between(*lat) & F.col("lon").between(*lon))
    if area:
        out = out.filter(F.col("area").between(*area))
    return out if max_error is None else out.filter(F.col("error") <= max_error)


def valid_years(series: DataFrame, key: str = "station_id", value: str = "value", time: str = "time") -> DataFrame:
    """(station, syear, eyear): the first and last year with a value."""
    return series.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min(F.year(time)).alias("syear"), F.max(F.year(time)).alias("eyear"))


def coarsen(df: DataFrame, factor: int, others: Sequence[str], *, value: str = "value") -> DataFrame:
    """Block means of factor x factor cells; blocks that the edge cuts go."""
    i, j = F.floor(F.col("i_lat") / factor).cast("int"), F.floor(F.col("i_lon") / factor).cast("int")
    got = df.groupBy(i.alias("i_lat"), j.alias("i_lon"), *others).agg(F.avg(value).alias(value), F.countDistinct("i_lat", "i_lon").alias("__n"))
    return got.filter(F.col("__n") == factor * factor).drop("__n")


def wrap_longitude(df: DataFrame, sources: Sequence[str], order: str | None = None) -> DataFrame:
    """Longitudes from -180 to 180 for sources that count beyond it; of cells that then meet the first by order stays."""
    w = W.partitionBy(*sources)
    beyond = F.max("lon").over(w) > 180
    wrapped = df.withColumn("__from", F.col("lon")).withColumn("lon", F.when(beyond, F.pmod(F.col("lon") + 180, F.lit(360.0)) - 180).otherwise(F.col("lon")))
    same = [c for c in ("lat", "lon", "time", "cell") if c in df.columns]
    n = F.row_number().over(W.partitionBy(*sources, *same).orderBy(order or "__from"))
    return wrapped.withColumn("__n", n).filter("__n = 1").drop("__n", "__from")


def longitude_in(lon: Column, low: float, high: float) -> Column:
    """lon, or lon a turn on or back, whichever lies in the range; NULL if none does."""
    return F.coalesce(*(F.when((lon + k).between(low, high), lon + k) for k in (0.0, 360.0, -360.0)))


def spatial_weight(kind: str, lat: str = "lat", reference_mean: str = "o_mean") -> Column:
    """area: cos(lat); mass: that times |mean of the reference|; none: 1."""
    area = F.cos(F.radians(lat))
    return {"area": area, "mass": area * F.coalesce(F.abs(F.col(reference_mean)), F.lit(0.0)), "none": F.lit(1.0)}[kind]


def spatial_mean(df: DataFrame, keys: Sequence[str], names: Sequence[str], kind: str = "area", **columns) -> DataFrame:
    weighted = df.withColumn("__w", spatial_weight(kind, **columns))
    return weighted.groupBy(*keys).agg(*(weighted_mean(n, "__w").alias(n) for n in names))


def domain(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float], margin: float = 1.0) -> DataFrame:
    """Cells in the box and a margin round it, before regridding."""
    return df.filter(F.col("lat").between(lat[0] - margin, lat[1] + margin) & F.col("lon").between(lon[0] - margin, lon[1] + margin))
