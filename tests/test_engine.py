"""Store, planner and execution, with hand-computed answers."""

import math
from datetime import datetime, timedelta

import pytest
from gridtide.config import Settings
from gridtide.ingest import Source, blend, from_table, ingest
from gridtide.jobs import DataObject, JobService, clean_outputs
from gridtide.operators import combine
from gridtide.plans.engine import Engine, serialize
from gridtide.plans.normalize import normalize_query
from gridtide.sources.store import ProductStore

SETTINGS = Settings(
    repositories={"lab": {"two": {"variables": {"v": "temperature"}, "additional_parameters": {"height": ["15m", "30m"]}}}, "gridtide": {"combined": {"variables": {"v": "temperature"}}}},
    temporal_reducers={"rain": "sum"},
)
QUERY = {
    "repository": "lab", "dataset": "two", "variable": "temperature", "time_start": "2020-01-01", "time_end": "2020-01-02", "time_unit": "Day", "coarseness_factor": 1,
    "region": {"west": 0, "east": 80, "south": 0, "north": 20}, "function": "timeseries", "aggregation": "mean",
}
GRID = "gy int, gx int, lat double, lon double, cell_area double, lat_lo double, lat_hi double, lon_lo double, lon_hi double"


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    """Two cells and two days; areas 1 and 3."""
    store = ProductStore(spark, f"file://{tmp_path_factory.mktemp('store')}")
    cells = spark.createDataFrame([(0, 0, 10.0, 10.0, 1.0, 9.0, 11.0, 0.0, 40.0), (0, 1, 10.0, 70.0, 3.0, 9.0, 11.0, 40.0, 100.0)], GRID)
    grid = store.ensure_grid(cells, "rectilinear")
    variant = store.upsert_dataset("lab", "two", {"temperature": {"units": "K"}})
    day = [datetime(2020, 1, 1), datetime(2020, 1, 2)]
    rows = [(day[0], 0, 0, 0.0, 1.0, 0.0, 0.0), (day[0], 0, 1, 30.0, 3.0, 10.0, 10.0), (day[1], 0, 0, 2.0, 1.0, 2.0, 2.0), (day[1], 0, 1, 42.0, 3.0, 14.0, 14.0)]
    data = spark.createDataFrame(rows, "ts timestamp_ntz, gy int, gx int, weighted_sum double, weight_sum double, min_v double, max_v double")
    assert store.write_product(data, variant, "temperature", grid, "Day", 1, "1D") == 1
    assert store.write_product(data, variant, "temperature", grid, "Day", 1, "1D") == 0  # idempotent
    assert store.ensure_grid(cells, "rectilinear") == grid and store.catalog("grids").count() == 1
    return Engine(store, SETTINGS)


def values(result, *order):
    return [r["value"] for r in result.data.orderBy(*order).collect()]


def test_the_five_functions(engine):
    assert values(engine.execute(QUERY), "ts") == [7.5, 11.0]
    assert values(engine.execute(QUERY | {"function": "heatmap"}), "gx") == [1.0, 12.0]
    found = engine.execute(QUERY | {"function": "find_time", "predicate": ">", "filter_value": "8"})
    assert [r["matches"] for r in found.data.orderBy("ts").collect()] == [False, True]
    found = engine.execute(QUERY | {"function": "find-area", "predicate": "ge", "filter_value": 5}, only_matches=True)
    assert [r["gx"] for r in found.data.collect()] == [1]
    data = engine.execute(QUERY | {"function": "get-data", "aggregation": "max"})
    assert values(data, "ts", "gx") == [0.0, 10.0, 2.0, 14.0]
    assert data.groups[0]["window"] == (0, 1, 0, 2) and data.groups[0]["misses"] == 0 and data.groups[0]["units"] == "K"


def test_plan_prunes_and_warns(engine):
    none = engine.execute(QUERY | {"time_start": "2021-01", "time_end": "2021-02"})
    assert none.data is None and "No matching product partitions" in none.warnings[0]
    assert engine.execute(QUERY | {"time_unit": "hour"}).data is None
    plan = engine.plan(QUERY | {"time_end": "2020-01-04"})
    assert any("is missing" in w for w in plan.warnings)
    assert engine.enforce_limits(plan)["groups"] == 1
    with pytest.raises(ValueError, match="exceeds the limit"):
        engine.enforce_limits(engine.plan(QUERY | {"time_end": "2020-03-31"}))
    text = engine.execute(QUERY).data._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in text and "time_unit" in text and "Python" not in text


def test_serialized_results(engine, tmp_path):
    out = serialize(engine.execute(QUERY))["groups"][0]["data"]
    assert out == {"kind": "timeseries", "timestamps": ["2020-01-01T00:00:00", "2020-01-02T00:00:00"], "values": [7.5, 11.0]}
    out = serialize(engine.execute(QUERY | {"function": "heatmap"}))["groups"][0]["data"]
    assert out["values"] == [[1.0, 12.0]] and out["longitudes"] == [[10.0, 70.0]] and out["grid_x_indices"] == [0, 1]
    out = serialize(engine.execute(QUERY | {"function": "get-data"}))["groups"][0]["data"]
    assert out["grid_shape"] == [1, 2] and "values" not in out
    path = engine.write_result(engine.execute(QUERY), f"file://{tmp_path}")
    assert engine.store.spark.read.parquet(path).count() == 2
    assert DataObject(engine, **QUERY).query("heatmap", aggregation="min").data.count() == 2


@pytest.mark.parametrize(
    "change",
    [
        {"variable": ["temperature"]}, {"coarseness_factor": 3}, {"coarseness_factor": True}, {"coarseness_factor": 1.5}, {"time_unit": "Minute"}, {"function": "histogram"}, {"aggregation": "median"},
        {"time_start": "2020-02-01T00:30"}, {"time_start": "2020-02"}, {"repository": "x"}, {"dataset": "x"}, {"region": {"west": 10, "east": 5, "south": 0, "north": 1}}, {"region": None},
        {"predicate": "gt", "filter_value": 1}, {"function": "find-time"}, {"function": "find-time", "predicate": "gt", "filter_value": math.inf}, {"additional_parameters": {"height": "1m"}},
    ],
)
def test_bad_queries(change):
    with pytest.raises(ValueError):
        normalize_query(QUERY | change, SETTINGS)


def test_normalized_query():
    q = normalize_query(QUERY | {"region": {"west": -50.12345, "east": 20.67891, "south": 40, "north": 80}, "time_start": "2020-02", "time_end": "2020-03", "additional_parameters": {"height": "15m"}}, SETTINGS)
    assert (q.region.west, q.region.east) == (309.877, 20.679) and len(q.region.longitude_intervals) == 2
    assert q.time_end == datetime(2020, 3, 31, 23)


def test_ingest_builds_a_pyramid_that_agrees_with_native_data(spark, tmp_path):
    rows = [(f"2020-01-{d:02d} {h:02d}:00:00", lat, lon, float(d * h + lat)) for d in range(1, 32) for h in range(0, 24, 3) for lat in (5.0, 15.0) for lon in (-10.0, 0.0, 10.0)]
    table = spark.createDataFrame(rows, "time string, lat double, lon double, v double").withColumnRenamed("lat", "latitude")
    source = from_table(table, "lab", "two", "v", "K", SETTINGS)
    store = ProductStore(spark, f"file://{tmp_path}/a")
    written = ingest(store, source, SETTINGS)
    assert written == {("Source", 1): 1, ("Day", 1): 1, ("Month", 1): 1, ("Month", 2): 1, ("Year", 1): 0, ("Year", 2): 0}
    engine = Engine(store, SETTINGS)
    ask = QUERY | {"region": {"west": -20, "east": 20, "south": 0, "north": 20}, "time_end": "2020-01-31", "function": "heatmap"}
    for how in ("mean", "min", "max"):
        month, day, native = (values(engine.execute(ask | {"aggregation": how, "time_unit": u}), "gy", "gx") for u in ("Month", "Day", "Source"))
        assert month == pytest.approx(day) and day == pytest.approx(native)
    coarse = engine.execute(ask | {"time_unit": "Month", "coarseness_factor": 2}).data.orderBy("gx").collect()
    assert [(r["gy"], r["gx"]) for r in coarse] == [(0, 0), (0, 2)]
    path = store.catalog("product_index").first()["relative_path"]
    store.compact(path)
    assert values(engine.execute(ask | {"aggregation": "max", "time_unit": "Source"}), "gy", "gx") == pytest.approx(native)


def test_blended_sources(spark, tmp_path):
    cells = spark.createDataFrame([(0, 0, 10.0, 10.0, 1.0, 9.0, 11.0, 0.0, 40.0), (0, 1, 10.0, 70.0, 3.0, 9.0, 11.0, 40.0, 100.0)], GRID)
    start, schema = datetime(2020, 1, 1), "ts timestamp_ntz, gy int, gx int, value double"
    hourly = spark.createDataFrame([(start + timedelta(hours=h), 0, x, 2.0) for h in range(24) for x in (0, 1)], schema)
    three = spark.createDataFrame([(start + timedelta(hours=h), 0, x, None if x and h < 9 else 4.0) for h in range(0, 24, 3) for x in (0, 1)], schema)
    a, b = Source("lab", "a", "temperature", "K", hourly, cells), Source("lab", "b", "temperature", "K", three, cells)
    out = blend([a, b], a, SETTINGS, {})
    assert [(r["value"], r["source_count"]) for r in out.data.orderBy("gx").collect()] == [(3.0, 2), (2.0, 1)]
    with pytest.raises(ValueError, match="incompatible units"):
        blend([a, Source("lab", "b", "temperature", "C", three, cells)], a, SETTINGS, {})
    assert combine.required_samples("3H", 0.75) == 6
    store = ProductStore(spark, f"file://{tmp_path}/b")
    assert ingest(store, out, SETTINGS, combined=True)["Day", 1] == 1


def test_jobs(engine, tmp_path):
    jobs = JobService(engine, SETTINGS, tmp_path)
    job = jobs.submit(QUERY)
    with pytest.raises(ValueError):
        jobs.submit(QUERY, outputs=("netcdf",))
    jobs.close()
    assert jobs.get(job.id).state == "completed" and jobs.counts()["completed"] == 1
    assert job.artifacts["plot-json"]["groups"][0]["data"]["values"] == [7.5, 11.0]
    assert (tmp_path / "query_log.jsonl").read_text().count("\n") == 1
    job.finished -= 10_000
    assert jobs.expire() == 1 and jobs.get(job.id).state == "expired"
    (tmp_path / ("0" * 32)).mkdir()
    assert clean_outputs(tmp_path, older_than=-1, dry_run=True) == ["0" * 32] and clean_outputs(tmp_path, older_than=-1) == ["0" * 32]
