"""Answers from a store: deliveries that overlap, blocks at a window's edge, sources on other grids."""

from datetime import datetime

import duckdb
import pytest
from gridtide import queries
from gridtide.config import Settings
from gridtide.functions.geo import Lambert
from gridtide.ingest import Source, blend
from gridtide.model import Operation, Product, Query, Region, Selection
from gridtide.operators import combine
from gridtide.plans.engine import Engine, united
from gridtide.sources.store import ProductStore

DATA = "/root/testdata/sf0.01"
GRID = "gy int, gx int, lat double, lon double, cell_area double, lat_lo double, lat_hi double, lon_lo double, lon_hi double"


def ask(unit, factor, region, function, days=2):
    return Query(Selection("t"), (datetime(2020, 1, 1), datetime(2020, 1, days, 23)), region, Product(unit, factor), Operation(function, "mean"))


@pytest.fixture
def store(spark, tmp_path):
    return ProductStore(spark, f"file://{tmp_path}/store")


def test_a_day_that_is_delivered_twice_counts_once(spark, store):
    cells = spark.createDataFrame([(0, 0, 10.0, 10.0, 1.0, 9.0, 11.0, 0.0, 20.0)], GRID)
    grid, variant = store.ensure_grid(cells, "rectilinear"), store.upsert_dataset("lab", "a", {"t": {"units": "K"}})
    day = [(datetime(2020, 1, 1), 0, 0, 1.0), (datetime(2020, 1, 2), 0, 0, 5.0)]
    schema = "ts timestamp_ntz, gy int, gx int, value double"
    for rows in (day[:1], day):
        assert store.write_product(spark.createDataFrame(rows, schema), variant, "t", grid, "Source", 1, "1D") == 1
    engine, box = Engine(store, Settings()), Region(0.0, 20.0, 0.0, 20.0)
    assert [r["value"] for r in engine.execute(ask("Source", 1, box, "heatmap")).data.collect()] == [3.0]
    assert sorted(r["value"] for r in engine.execute(ask("Source", 1, box, "get-data")).data.collect()) == [1.0, 5.0]


def test_blocks_at_the_edge_are_whole(spark, store):
    """Latitudes 25 and 35 make a cell at 30: a box from 31 north doesn't have it, one from 29 does."""
    cells = spark.createDataFrame([(y, 0, 25.0 + 10 * y, 10.0, 1.0, 20.0 + 10 * y, 30.0 + 10 * y, 0.0, 20.0) for y in range(4)], GRID)
    grid, variant = store.ensure_grid(cells, "rectilinear"), store.upsert_dataset("lab", "a", {"t": {"units": "K"}})
    rows = [(datetime(2020, 1, 1), y, 0, 2.0 * y, 2.0, 0.0, 9.0) for y in range(2)]
    data = spark.createDataFrame(rows, "ts timestamp_ntz, gy int, gx int, weighted_sum double, weight_sum double, min_v double, max_v double")
    store.write_product(data, variant, "t", grid, "Month", 2, "1D")
    engine = Engine(store, Settings())
    found = engine.execute(ask("Month", 2, Region(0.0, 20.0, 31.0, 60.0), "heatmap")).data.collect()
    assert [(r["gy"], r["lat"], r["value"]) for r in found] == [(2, 50.0, 1.0)]
    found = engine.execute(ask("Month", 2, Region(0.0, 20.0, 29.0, 60.0), "heatmap")).data.orderBy("gy").collect()
    assert [(r["gy"], r["lat"], r["value"]) for r in found] == [(0, 30.0, 0.0), (2, 50.0, 1.0)]


def test_united_ranges():
    assert united([(5, 6), (1, 3), (2, 4), (4, 4)]) == [(1, 4), (5, 6)] and united([]) == []


def test_blend_regrids_or_refuses(spark):
    cells = lambda lons: spark.createDataFrame([(0, k, 10.0, x, 1.0, 9.0, 11.0, x - 5, x + 5) for k, x in enumerate(lons)] + [(1, k, 20.0, x, 1.0, 19.0, 21.0, x - 5, x + 5) for k, x in enumerate(lons)], GRID)
    data = spark.createDataFrame([(datetime(2020, 1, 1), y, x, 10.0 * x) for y in (0, 1) for x in (0, 1, 2)], "ts timestamp_ntz, gy int, gx int, value double")
    target = Source("lab", "b", "t", "K", data.limit(0), cells([15.0, 25.0]), native="1D")
    found = blend([Source("lab", "a", "t", "K", data, cells([10.0, 20.0, 30.0]), native="1D")], target, Settings(), {}).data
    assert sorted((r["gx"], r["value"]) for r in found.filter("gy = 0").collect()) == [(0, 5.0), (1, 15.0)]
    with pytest.raises(ValueError, match="regrid weights"):
        blend([Source("lab", "a", "t", "K", data, cells([10.0, 20.0, 30.0]), "projected", native="1D")], target, Settings(), {})


def test_projected_weights_reproduce_a_plane(spark):
    projection = Lambert(80.0, 80.0, 80.0, 326.0)
    cells = spark.createDataFrame([(0, 0, 75.0, 330.0), (0, 1, 82.0, 310.0), (9, 9, -40.0, 10.0)], "gy int, gx int, lat double, lon double")
    weights = combine.projected_weights(projection, (-2e6, 1e5, 41), (2e6, -1e5, 41), cells).collect()
    assert {(r["dst_gy"], r["dst_gx"]) for r in weights} == {(0, 0), (0, 1)}
    for gx, place in ((0, (75.0, 330.0)), (1, (82.0, 310.0))):
        x, y = projection.origin(*place)
        own = [r for r in weights if r["dst_gx"] == gx]
        assert sum(r["w"] for r in own) == pytest.approx(1)
        assert (sum(r["w"] * (-2e6 + 1e5 * r["src_gx"]) for r in own), sum(r["w"] * (2e6 - 1e5 * r["src_gy"]) for r in own)) == pytest.approx((x, y), abs=1e-3)


def test_registered_queries_run_over_whole_tables(spark):
    import __spark_entry__ as e

    names = set(e.queries())
    assert not names & queries.WINDOWED and {"store_overlapping_writes", "regrid_projected_apply", "region_full_globe_whole"} <= names
    db = duckdb.connect()
    for table in ("lineitem", "supplier"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = queries.QUERIES["store_overlapping_writes"](spark, DATA).collect()
    assert sorted(map(tuple, found)) == sorted(db.execute(queries.ORACLES["store_overlapping_writes"]).fetchall())
