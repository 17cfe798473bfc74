"""Golden values of single operators, and properties of the statistics."""

import json
from datetime import datetime, timedelta

import pytest
from gridtide.functions import calendar, geo, identity
from gridtide.model import Region
from gridtide.operators import combine, spatial, stats, temporal
from gridtide.plans import metadata
from gridtide.sources.standardize import coordinate_role, open_sources, standard_variable, standardize
from gridtide.streaming.stats_stream import read_samples, windowed_statistics, write_statistics
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

T0 = datetime(2020, 1, 1)
CELL = "ts timestamp_ntz, gy int, gx int, value double"


def cube(spark, n, step, start=T0, unit="hours"):
    rows = [(start + timedelta(**{unit: t * step}), y, x, float(t * 9 + y * 3 + x), 1.0, float(y), [179.0, -179.0, -177.0][x]) for t in range(n) for y in range(3) for x in range(3)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, gy int, gx int, value double, cell_area double, lat double, lon double")


@pytest.mark.parametrize(
    ("n", "step", "native", "target", "start", "found"),
    [
        (24, 1, "1H", "1D", T0, 1), (23, 1, "1H", "1D", T0, 0), (8, 3, "3H", "1D", T0 + timedelta(minutes=90), 1), (31, 24, "1D", "1MS", T0, 1), (30, 24, "1D", "1MS", T0, 0),
        (366, 24, "1D", "1YS", T0, 1), (365, 24, "1D", "1YS", T0, 0),
    ],
)
def test_complete_periods(spark, n, step, native, target, start, found):
    out = temporal.temporal_product(stats.expand(cube(spark, n, step, start)), native, target, "gy", "gx")
    rows = out.filter("gy = 1 AND gx = 1").select("ts", stats.finalized("mean").alias("v")).collect()
    assert len(rows) == found
    if found:
        assert rows[0]["ts"] == datetime(2020, 1, 1) and rows[0]["v"] == pytest.approx(9 * (n - 1) / 2 + 4)


def test_finer_targets_and_unknown_reducers_are_refused(spark):
    with pytest.raises(ValueError, match="finer"):
        temporal.temporal_product(cube(spark, 1, 1), "1D", "1H", "gy", "gx")
    with pytest.raises(ValueError, match="reducer"):
        stats.reducer("mode")
    with pytest.raises(ValueError):
        temporal.product_policy("1W")
    assert temporal.product_policy("1MS") == [("Source", 1), ("Year", 1), ("Year", 2)]


def test_coarse_grid(spark):
    data = cube(spark, 1, 1)
    grid = {(r["gy"], r["gx"]): r for r in spatial.coarsen_grid(data, 2).collect()}
    assert [[grid[y, x]["cell_area"] for x in (0, 1)] for y in (0, 1)] == [[4, 2], [2, 1]] and grid[0, 0]["lon"] == pytest.approx(180)
    of = lambda how: {(r["gy"], r["gx"]): r["value"] for r in spatial.coarsen(data, 2, how).collect()}
    assert of("first") == {(0, 0): 0, (0, 1): 2, (1, 0): 6, (1, 1): 8} and of("mean")[1, 1] == 8.0
    assert [spatial.auxiliary_method(*a) for a in (("source_count",), ("cell_area",), ("quality", True), ("depth",), ("name", False, False))] == ["max", "sum", "first", "mean", "first"]


def test_area_weighted_mean_without_an_area(spark):
    rows = spark.createDataFrame([(T0, 0, 0, 0.0, 0.0), (T0, 1, 0, 10.0, 60.0), (T0, 2, 0, None, 0.0)], CELL + ", lat double")
    out = stats.merge(stats.expand(rows, area=None), "ts").select("*", stats.finalized("mean").alias("v")).first()
    assert (out["weighted_sum"], out["weight_sum"], out["min_v"], out["max_v"]) == pytest.approx((5, 1.5, 0, 10)) and out["v"] == pytest.approx(10 / 3)


def test_missing_values(spark):
    rows = spark.createDataFrame([(T0, 0, 0, float("nan")), (T0, 0, 1, None), (T0, 0, 2, 1.0)], CELL).withColumn("value", stats.missing_to_null("value"))
    assert [r["value"] for r in rows.orderBy("gx").collect()] == [None, None, 1.0]
    found = stats.find(rows, "ne", 5).orderBy("gx").collect()
    assert [r["matches"] for r in found] == [False, False, True]
    empty = stats.timeseries(stats.expand(rows.filter("gx < 2").withColumn("cell_area", F.lit(1.0))), "mean").first()
    assert empty["value"] is None


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 47), st.integers(0, 4), st.integers(0, 4), st.one_of(st.none(), st.integers(-9, 9))), min_size=1, max_size=40, unique_by=lambda r: r[:3]))
def test_merging_in_any_order_is_the_same(spark, rows):
    data = spark.createDataFrame([(T0 + timedelta(hours=t), y, x, None if v is None else float(v)) for t, y, x, v in rows], CELL).withColumn("cell_area", F.col("gy") + 1e0)
    native = stats.expand(data)
    products = spatial.spatial_product(temporal.temporal_product(native, "1H", "1D", "gy", "gx", complete=False), 2, "ts")
    for how in stats.AGGREGATIONS:
        a, b = (stats.merge(x, F.lit(1).alias("k")).select(stats.finalized(how).alias("v")).first()["v"] for x in (native, products))
        assert a == b or a == pytest.approx(b)


def test_buckets(spark):
    tiles = geo.BucketGrid()
    assert tiles.point(0, -10) == "r3_c5" and tiles.point(90, 360) == "r5_c0"
    table = {r["bucket_id"]: r for r in tiles.table(spark).collect()}
    assert len(table) == 36 and (table["r0_c0"]["lat_max"], table["r5_c5"]["lon_min"]) == (-60, 300)
    points = spark.createDataFrame([(la, lo) for la in (-75.0, 15.0) for lo in (-10.0, 10.0)], "lat double, lon double")
    assert [r[0] for r in points.select(tiles.code("lat", "lon")).collect()] == [5, 0, 23, 18]
    with pytest.raises(ValueError):
        geo.BucketGrid(lon_size=70)
    cells = spark.createDataFrame([(y, x, [-75.0, -45.0, -15.0][y], [10.0, 70.0, 130.0][x]) for y in range(3) for x in range(3)], "gy int, gx int, lat double, lon double")
    windows = spatial.extent(cells.withColumn("code", tiles.code("lat", "lon")), "code").orderBy("code").collect()
    assert len(windows) == 9 and tuple(windows[4])[1:] == (1, 2, 1, 2)


def test_axes_and_areas(spark):
    axis = spark.createDataFrame([(10.0,), (12.0,)], "lat double")
    assert [(r["lat_lo"], r["lat_hi"]) for r in spatial.axis_bounds(axis, "lat").orderBy("lat").collect()] == [(9, 11), (11, 13)]
    assert spatial.axis_bounds(axis.limit(1), "lat").first()["lat_hi"] == 10.5
    globe = spark.range(1).select(geo.cell_area(F.lit(-91.0), F.lit(91.0), F.lit(0.0), F.lit(360.0)).alias("a")).first()["a"]
    assert globe == pytest.approx(4 * 3.141592653589793 * geo.EARTH_RADIUS_M**2)
    assert metadata.axis_spacing(spark.createDataFrame([(0.0,), (1.0,), (3.0,)], "x double"), "x").first()[0] == 2.0
    assert metadata.axis_spacing(axis.limit(1), "lat").first()[0] == 1.0
    assert metadata.display_bounds(0, 360) == (-180, 180) and metadata.display_bounds(200, 250) == (-160, -110) and metadata.display_bounds(10, 20) == (10, 20)


def test_lambert(spark):
    cone = geo.Lambert(80, 80, 80, 326)
    x, y = cone.axes((70.135, 340.592), 3, 2, 2500, 2500)
    assert x[1] - x[0] == 2500 and y[1] - y[0] == 2500
    px, py = cone.forward(F.lit(70.135), F.lit(340.592))
    back = spark.range(1).select(px.alias("x"), py.alias("y")).select("x", "y", *(c.alias(n) for c, n in zip(cone.inverse("x", "y"), ("lat", "lon"), strict=True))).first()
    assert (back["x"], back["y"]) == pytest.approx((x[0], y[0])) and (back["lat"], back["lon"]) == pytest.approx((70.135, 340.592))


def test_cadence(spark):
    axis = lambda *ts: spark.createDataFrame([(t,) for t in ts], "ts timestamp_ntz")
    assert calendar.infer_cadence(axis(*(T0 + timedelta(hours=3 * k) for k in range(4)))) == "3H"
    assert calendar.infer_cadence(axis(datetime(2020, 1, 1), datetime(2020, 2, 1), datetime(2020, 3, 1))) == "1MS"
    assert calendar.infer_cadence(axis(datetime(2019, 1, 1), datetime(2020, 1, 1), datetime(2021, 1, 1))) == "1YS"
    assert calendar.infer_cadence(axis(T0), declared="d") == "1D"
    for bad in (axis(T0, T0), axis(T0, T0 + timedelta(hours=1), T0 + timedelta(hours=3))):
        with pytest.raises(ValueError):
            calendar.infer_cadence(bad)
    assert calendar.expected_timestamps(datetime(2020, 1, 15), datetime(2020, 3, 1), "1MS") == [datetime(2020, 2, 1), datetime(2020, 3, 1)]
    assert len(calendar.expected_timestamps(datetime(2020, 1, 1, 1), datetime(2020, 1, 1, 23), "3H")) == 7
    with pytest.raises(ValueError):
        calendar.expected_timestamps(T0, T0, "1W")


def test_daily_coverage_and_regridding(spark):
    rows = [(T0 + timedelta(hours=3 * h), 0, x, None if (x, h) in {(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)} else 5.0) for h in range(8) for x in range(3)]
    day = combine.daily_mean_with_coverage(spark.createDataFrame(rows, CELL), combine.required_samples("3H", 0.75), "gy", "gx")
    assert [r["value"] for r in day.orderBy("gx").collect()] == [5.0, 5.0, None]
    both = spark.createDataFrame([(T0, 0, 0, 2.0), (T0, 0, 1, 4.0), (T0, 0, 0, 6.0), (T0, 0, 1, None)], CELL)
    assert [(r["value"], r["source_count"]) for r in combine.weighted_mean(both, "ts", "gy", "gx").orderBy("gx").collect()] == [(4.0, 2), (4.0, 1)]
    lat = spark.createDataFrame([(0, 0.0), (1, 10.0)], "gy int, lat double")
    lon = spark.createDataFrame([(0, 0.0), (1, 180.0)], "gx int, lon double")
    target = spark.createDataFrame([(0, 0, 5.0, 90.0), (0, 1, 5.0, 270.0), (1, 0, 50.0, 90.0), (2, 0, 10.0, 0.0)], "gy int, gx int, lat double, lon double")
    weights = combine.bilinear_weights(lat, lon, target, periodic=True)
    values = spark.createDataFrame([(T0, 0, 0, 1.0), (T0, 0, 1, 3.0), (T0, 1, 0, 5.0), (T0, 1, 1, None)], CELL)
    found = {(r["gy"], r["gx"]): r["value"] for r in combine.apply_weights(values, weights, "ts").collect()}
    assert found == {(0, 0): 3.0, (0, 1): 3.0, (2, 0): 5.0}
    with pytest.raises(ValueError):
        combine.source_weight({"a": 0.0})
    with pytest.raises(ValueError):
        combine.required_samples("1H", 0)


def test_regions():
    assert Region.of(-180, 180, -90, 90).longitude_span == 360 and Region(300, 20, 0, 1).longitude_span == 80
    assert Region(300, 20, 0, 1).longitude_intervals == [(300, 360.0), (0.0, 20)]
    with pytest.raises(ValueError, match="south"):
        Region.of(0, 1, 5, 5)


def test_identities():
    assert identity.variant_id("a", "b") == identity.variant_id("a", "b", {}) != identity.variant_id("a", "b", {"x": "1"}) and len(identity.variant_id("a", "b")) == 32
    assert identity.grid_id("projected", [1], [2], {"lat_1": 80}) != identity.grid_id("projected", [1], [2], {"lat_1": 81})


def test_standardizing(spark):
    assert coordinate_role(StructField("q", DoubleType(), True, {"units": "degrees_north"})) == "latitude" and coordinate_role(StructField("nav_lon", DoubleType())) == "longitude"
    source = spark.createDataFrame([(T0, 10.0, -5.0, float("nan"), "cold"), (T0, 5.0, 0.0, 2.0, "cold"), (T0, 10.0, 0.0, 3.0, "cold"), (T0, 5.0, -5.0, 4.0, "cold")], "time timestamp_ntz, lat double, lon double, sst double, expver string")
    out = standardize(source, "sst", {"sst": "temperature"})
    assert out.variable == "temperature" and out.constants == {"expver": "cold"} and out.grid_type == "rectilinear"
    assert [(r["gy"], r["gx"], r["value"]) for r in out.data.orderBy("gy", "gx").collect()] == [(0, 0, 2.0), (0, 1, 4.0), (1, 0, 3.0), (1, 1, None)]
    for bad in (source.withColumn("latitude", F.col("lat")), source.withColumn("lat", F.lit(95.0)), source.drop("time"), source.withColumn("temperature", F.lit(1))):
        with pytest.raises(ValueError):
            standardize(bad, "sst", {"sst": "temperature"})
    with pytest.raises(ValueError, match="standard name"):
        standard_variable("sst", {}, ["sst"])
    with pytest.raises(ImportError):
        open_sources(spark, ["x"], "netcdf")


def test_streaming_statistics_equal_batch(spark, tmp_path):
    schema = "ts timestamp, gy int, gx int, value double, cell_area double"
    rows = [(T0 + timedelta(hours=h), 0, x, float(h + x), 1.0 + x) for h in range(60) for x in (0, 1)]
    batch = spark.createDataFrame(rows, schema)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    query = write_statistics(windowed_statistics(read_samples(spark, str(tmp_path / "in"), schema)), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    got = {(r["ts"], r["gx"]): (r["weighted_sum"], r["min_v"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    day = batch.groupBy(F.date_trunc("day", "ts").alias("ts"), "gx").agg(F.sum(F.col("value") * F.col("cell_area")).alias("s"), F.min("value").alias("m"), F.count("*").alias("n"))
    assert got == {(r["ts"], r["gx"]): (r["s"], r["m"], r["n"]) for r in day.collect() if r["ts"] < datetime(2020, 1, 3)}  # the last day is still open


def test_registered_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "timeseries_mean" in e.queries()
    json.dumps(sorted(e.queries()))
