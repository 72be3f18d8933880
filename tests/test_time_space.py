from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import units
from tidemark.operators import compare, grid, inventory, normalize, pairing, timeops


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_decoding(spark):
    since = F.lit("2000-01-31").cast("date")
    assert one(spark, timeops.decode_offset(F.lit(1), "months", since)) == datetime(2000, 2, 29)
    assert one(spark, timeops.decode_offset(F.lit(1), "seasons", since)) == datetime(2000, 4, 30)
    assert one(spark, timeops.decode_offset(F.lit(1.5), "days", since)) == datetime(2000, 2, 1, 12)
    assert one(spark, timeops.decode_number(F.lit(20010203.0))) == datetime(2001, 2, 3)
    assert one(spark, timeops.decode_number(F.lit(200102.0))) == datetime(2001, 2, 1)
    assert one(spark, timeops.decode_number(F.lit(2000.5))) == datetime(2000, 7, 2)
    assert one(spark, timeops.decode_number(F.lit(17.0))) is None
    assert one(spark, timeops.decode_parts(F.lit(2001), F.lit(2), F.lit(30))) == datetime(2001, 2, 28)


def test_climatologies_weigh_by_days(spark):
    rows = [(1, datetime(2001, m, 1), float(m)) for m in range(1, 13)]
    df = spark.createDataFrame(rows, "cell int, time timestamp_ntz, value double")
    days = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    assert timeops.annual_climatology(df, ["cell"]).first().value == pytest.approx((days * np.arange(1, 13)).sum() / 365)
    feb = spark.createDataFrame([(1, datetime(2000, 2, 1), 29.0), (1, datetime(2001, 2, 1), 28.0)], df.schema)
    assert timeops.monthly_climatology(feb, ["cell"]).first().value == pytest.approx((29 * 29 + 28 * 28) / 57)
    assert timeops.climatology_findings(["APFB", "bias", "KGE"], 1) == ["APFB is not defined for a climatology", "KGE needs two points in time"]


def test_resampling_and_axes(spark):
    rows = [(1, datetime(2000, 1, d), v) for d, v in zip((1, 2, 3, 4), (1.0, 3.0, 5.0, 7.0), strict=True)]
    df = spark.createDataFrame(rows, "cell int, time timestamp_ntz, value double")
    assert [r.value for r in timeops.resample(df, ["cell"], "2 days").orderBy("time").collect()] in ([2.0, 6.0], [1.0, 4.0, 7.0])
    steps = timeops.axis(spark, "2000-01-01", "2000-01-06", "day")
    noon = df.withColumn("time", timeops.stamp("time", "day"))
    assert timeops.on_axis(noon, ["cell"], steps).count() == 6
    assert timeops.missing(noon, ["cell"], steps).count() == 2
    assert timeops.adds_up("Precipitation", "mm") and not timeops.adds_up("Precipitation", "mm day-1")
    assert timeops.upsampled(timeops.infer_step(df, ["cell"]), "hour").count() == 1
    weeks = spark.createDataFrame([(1, datetime(2000, 1, d)) for d in (1, 9, 17, 25)], "cell int, time timestamp_ntz")
    assert timeops.infer_step(weeks, ["cell"]).first().resolution == "week" and timeops.upsampled(timeops.infer_step(weeks, ["cell"]), "week").count() == 0
    with pytest.raises(ValueError):
        timeops.years(df, 2001, 2000)


@pytest.mark.parametrize(
    ("value", "unit", "want", "base"),
    [(1.0, "kg m-2 s-1", 86400.0, "mm day-1"), (20.0, "degC", 293.15, "k"), (212.0, "F", 373.15, "k"), (50.0, " % ", 0.5, "unitless"), (3.0, "furlong", 3.0, "furlong"), (31.0, "mm month-1", 1.0, "mm day-1"), (5.0, "mm", 5.0, "mm"), (2.0, "hPa", 200.0, "pa")],
)
def test_units(spark, value, unit, want, base):
    df = spark.createDataFrame([(value, unit, datetime(2001, 1, 15))], "value double, unit string, time timestamp_ntz")
    got = units.normalise(df).first()
    assert got.value == pytest.approx(want) and got.unit == base


def test_conservative_with_missing_half(spark):
    axis = lambda points: spark.createDataFrame([(i, float(p)) for i, p in enumerate(points)], "i_lon int, lon double")
    fine, coarse = axis([0.5, 1.5]), spark.createDataFrame([(0, 0.0, 2.0, 1.0)], "i_lon int, lo double, hi double, lon double")
    w = spark.createDataFrame([(0, 0, 0.5), (1, 0, 0.5)], "src int, tgt int, w double")
    row = spark.createDataFrame([(0, 0, 1.0)], "src int, tgt int, w double")
    data = spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "i_lat int, i_lon int, value double")
    assert grid.conservative(data, row, w, [], nan_threshold=1.0).first().value == pytest.approx(1.0)
    assert grid.conservative(data, row, w, [], nan_threshold=0.0).first().value is None
    assert fine.count() == 2 and coarse.count() == 1
    lat, tlat = grid.axis(spark, -90, 90, 30.0, "lat"), grid.axis(spark, -90, 90, 60.0, "lat")
    sums = grid.overlap_weights(lat, tlat, "lat", latitude=True).groupBy("tgt").agg(F.sum("w").alias("w")).collect()
    assert [r.w for r in sums] == pytest.approx([1, 1, 1])


def test_cubic_spline_is_exact_for_cubics():
    x = np.array([0.0, 1, 2.5, 3, 4.2, 6])
    f = lambda t: 1 - 2 * t + 0.5 * t**2 + 0.3 * t**3
    at = np.linspace(0, 6, 31)
    assert np.allclose(grid.cubic_spline(x, f(x), at), f(at))


def test_stations_and_longitudes(spark):
    a = spark.createDataFrame([("a", 1.0, 2.0), ("b", 5.0, 5.0)], "station_id string, lat double, lon double")
    b = spark.createDataFrame([("x", 1.004, 2.0), ("y", 1.006, 2.0), ("z", 5.5, 5.0)], "station_id string, lat double, lon double")
    assert [(r.sim_id, r.ref_id) for r in grid.match_stations(a, b).collect()] == [("a", "x")]
    assert [(r.sim_id, r.ref_id) for r in grid.match_stations(a, a.filter("station_id = 'b'")).collect()] == [("b", "b")]
    df = spark.createDataFrame([("s", 0.0, 0.0, 1.0), ("s", 0.0, 360.0, 2.0), ("s", 0.0, 270.0, 3.0)], "source string, lat double, lon double, value double")
    assert sorted((r.lon, r.value) for r in grid.wrap_longitude(df, ["source"]).collect()) == [(-90.0, 3.0), (0.0, 1.0)]


def test_expressions(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, [1.0, 2.0], [1.0, 3.0])], "id int, A double, b double, v array<double>, w array<double>")
    assert normalize.derive(df, "c = A + b; if zz: c = zz; c * 2").first().value == 10.0
    got = normalize.select_variable(df.select("id", "A", "b"), "x", [{"varname": "nope"}, {"varname": "a", "unit": "m", "convert": "value + b"}], ["id"]).first()
    assert (got.value, got.unit) == (5.0, "m")
    with pytest.raises(ValueError):
        normalize.select_variable(df, "x", [], ["id"])
    assert normalize.over_levels(df, "v", "w").first().value == pytest.approx(1.75)
    assert normalize.at_level(df, "v", 5).first().value is None


def test_masks_and_ensembles(spark):
    sims = spark.createDataFrame([("A", "v", 1, 1, 1.0), ("B", "v", 1, 1, 2.0), ("A", "v", 1, 2, 1.0), ("B", "v", 1, 2, float("nan"))], "source string, variable string, cell int, time int, value double")
    refs = spark.createDataFrame([("R", "v", 1, 1, 1.0), ("R", "v", 1, 2, 1.0), ("R", "v", 1, 3, 1.0)], sims.schema)
    assert sorted(r.time for r in pairing.unified_mask(sims, refs).collect()) == [1, 3]  # no sim has a say at time 3
    assert pairing.pair(sims, refs).count() == 3
    field = spark.createDataFrame([("A", 1, 1.0), ("B", 1, 3.0), ("A", 2, 2.0)], "sim string, cell int, value double")
    got = {(r.sim, r.cell): r.relative for r in compare.relative_score(field, ["cell"]).collect()}
    assert got == {("A", 1): -1.0, ("B", 1): 1.0, ("A", 2): None}


def test_smpi_bootstrap_has_a_seed_and_brackets_the_value(spark):
    rng = np.random.default_rng(0)
    rows = [("R", "A", c, 1.0, datetime(2000 + t // 12, t % 12 + 1, 1), float(rng.normal(1, 1)), float(rng.normal(0, 1))) for c in range(4) for t in range(60)]
    df = spark.createDataFrame(rows, "ref string, sim string, cell int, w double, time timestamp_ntz, s double, o double")
    a, b = (compare.smpi_bootstrap(df.repartition(n), ["ref", "sim"], "cell", replicates=200).first() for n in (1, 4))
    assert (a.low, a.high) == pytest.approx((b.low, b.high)) and a.low < a.value < a.high


def test_file_names(spark):
    names = ["/a/gpp_v2010_200101.nc", "/a/x_2001-02-03.nc", "/a/y.nc", "/a/FLX_US-Ha1_2001_2010.csv", "/a/tas.201001.nc", "/a/x_r2050.nc", "/a/x_200101_2020.nc"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    token, kind = inventory.date_token("path")
    got = {r.path: (r.t, r.k) for r in df.select("path", token.alias("t"), kind.alias("k")).collect()}
    assert got[names[0]] == ("200101", "month") and got[names[1]] == ("20010203", "day") and got[names[2]][1] is None
    assert df.select(inventory.station_id("path").alias("s")).collect()[3].s == "US-Ha1"
    assert got["/a/tas.201001.nc"] == ("201001", "month") and got["/a/x_r2050.nc"] == (None, None) and got["/a/x_200101_2020.nc"] == ("200101", "month")
    per = {r.folder: r.granularity for r in inventory.files(spark.createDataFrame([("/m/a_200101.nc",), ("/m/a_20010203.nc",), ("/s/a_2001.nc",), ("/n/a.nc",), ("/n/b.nc",)], "path string")).collect()}
    assert per == {"/m": "day", "/s": "single", "/n": "year"}


def test_signatures_do_not_depend_on_order_but_on_every_file(spark):
    rows = [("t", f"f{k}", k, k) for k in range(40)]
    sign = lambda r, config="c": inventory.signatures(spark.createDataFrame(r, "task string, path string, size long, modified long").repartition(3), ["task"], config, "1").first().hash
    assert sign(rows) == sign(rows[::-1]) != sign(rows[1:])
    assert len({sign(rows), sign([("t", "f0", 0, 1), *rows[1:]]), sign([*rows, rows[0]]), sign(rows, "d")}) == 4


def bent(n):
    mesh = [(i, j, i + 0.3 * j + 0.05 * (i * j % 3), 1.2 * j - 0.2 * i + 0.04 * (i + 2 * j) % 0.3) for i in range(n) for j in range(n)]
    return mesh


def test_a_linear_field_on_a_bent_grid_is_reproduced(spark):
    mesh = spark.createDataFrame([(i, j, float(a), float(b), 2 * a - 3 * b + 1, 7) for i, j, a, b in bent(12)], "i int, j int, lat double, lon double, value double, time int")
    triangles = grid.mesh_triangles(mesh)
    assert triangles.count() == 2 * 11 * 11
    weights = grid.mesh_weights(triangles, 0.37)
    got = grid.on_mesh(mesh, weights, ["time"]).collect()
    lat0, lon0 = min(p[2] for p in bent(12)), min(p[3] for p in bent(12))
    assert len(got) > 500 and all(abs(r.value - (2 * (lat0 + 0.37 * r.i_lat) - 3 * (lon0 + 0.37 * r.i_lon) + 1)) < 1e-9 for r in got)
    assert weights.groupBy("i_lat", "i_lon").agg(F.sum("w").alias("w")).filter("abs(w - 1) > 1e-9").count() == 0


def test_meshes_with_holes_and_a_pinned_value(spark):
    # one cell with corners (0, 0), (0, 2), (2, 0), (2, 2) and values 0, 2, 4, 10: both diagonals fit, the first stays, so (0.5, 0.5) lies in the triangle of the first three
    square = [(0, 0, 0.0, 0.0, 0.0), (0, 1, 0.0, 2.0, 2.0), (1, 0, 2.0, 0.0, 4.0), (1, 1, 2.0, 2.0, 10.0)]
    make = lambda rows: spark.createDataFrame(rows, "i int, j int, lat double, lon double, value double")
    at = lambda rows, **o: {(r.i_lat, r.i_lon): r.value for r in grid.on_mesh(make(rows), grid.mesh_weights(grid.mesh_triangles(make(rows)), 0.5, **o), []).collect()}
    got = at(square)
    assert got[1, 1] == pytest.approx(1.5) and got[3, 3] == pytest.approx(10 - 0.25 * 6 - 0.25 * 8) and len(got) == 25
    # without a corner only its triangle stays, and a missing value is NULL where it counts
    assert set(at(square[:3])) == {(a, b) for a in range(5) for b in range(5) if a + b <= 4} and at(square[:3])[1, 1] == pytest.approx(1.5)
    holed = at([*square[:3], (1, 1, 2.0, 2.0, None)])
    assert holed[3, 3] is None and holed[1, 1] == pytest.approx(1.5)
    assert at([(0, 0, None, 0.0, 1.0), *square[1:3]]) == {}
    assert set(at(square, origin=(0.25, 0.25))) == {(a, b) for a in range(4) for b in range(4)}


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date", "string"])
def test_counts_of_different_times(spark, kind):
    times = ["1969-12-30 23:00:00", "1969-12-31 23:59:59.999999", "1970-01-01 00:00:00", "1970-01-01 00:00:00", "1970-01-01 00:00:01", "1970-01-02 23:00:00", "1970-01-03 00:00:00", "2000-02-29 05:30:00", None]
    df = spark.createDataFrame([("a", t, k) for t in times for k in ("year", "month")] + [("b", None, "day")], "file string, t string, kind string").withColumn("time", F.col("t").cast(kind))
    want = {r.file: r.n for r in df.groupBy("file").agg(F.countDistinct("time").alias("n")).collect()}
    got = {r.file: r.n for r in timeops.resolution_by_count(df, "file", files="kind").collect()}
    assert got == want


def test_counts_of_times_that_the_zone_leaves_out(spark):
    df = spark.sql("SELECT 'a' AS file, to_timestamp_ntz(t) AS time FROM VALUES ('2021-03-14 01:30:00'), ('2021-03-14 02:30:00'), ('2021-03-14 03:30:00'), ('2021-11-07 01:30:00') AS v(t)")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert timeops.resolution_by_count(df, "file").first().n == 4
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_hours_of_a_file_meet_before_the_shuffle(spark):
    hours = spark.range(4800).select(F.lit("a").alias("file"), F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("time"))
    got = timeops.resolution_by_count(hours.coalesce(1), "file")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.first().n == 4800 and "shiftleft" in plan.lower() and "count(distinct" not in plan.lower()


def test_nearest_stations_in_crowded_squares(spark):
    rng = np.random.default_rng(4)
    some = lambda n, first: [(first + i, *map(float, np.round(rng.normal(0, 3, 2) if i % 3 else rng.uniform(-40, 40, 2), 1))) for i in range(n)]
    a, b = some(300, 0), [*some(400, 1000), (5000, None, 1.0)]
    dfs = [spark.createDataFrame(x, "station_id long, lat double, lon double") for x in (a, b)]
    want = {}
    for i, lat, lon in a:
        d, ref = min((((lat - y) ** 2 + (lon - x) ** 2) ** 0.5, k) for k, y, x in b if y is not None)
        if d <= 5:
            want[i] = (ref, d)
    for per_square in (1, 4, 10**6):
        got = {r.sim_id: (r.ref_id, r.distance) for r in grid.match_stations(*dfs, radius=5.0, per_square=per_square).collect()}
        assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
