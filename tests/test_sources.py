"""Requests, migration and small metadata helpers."""

from datetime import date

from gridtide.plans.metadata import grid_mapping, nearest_product
from gridtide.sources.requests import merge_intervals, month_request, split_by_month
from gridtide.sources.store import SCHEMAS, ProductStore


def test_interests(spark):
    rows = spark.createDataFrame([("a", date(2020, 11, 5), date(2021, 2, 1)), ("a", date(2020, 1, 3), date(2020, 1, 20))], "k string, start date, end date")
    assert [(r["start"], r["end"]) for r in split_by_month(rows).orderBy("start").collect()] == [(date(2020, 11, 1), date(2020, 12, 1)), (date(2020, 12, 1), date(2021, 1, 1)), (date(2021, 1, 1), date(2021, 2, 1))]
    more = rows.unionByName(spark.createDataFrame([("a", date(2020, 1, 20), date(2020, 2, 2)), ("b", date(2020, 1, 1), date(2020, 1, 2))], rows.schema))
    assert [tuple(r) for r in merge_intervals(more, "k").orderBy("k", "start").collect()] == [("a", date(2020, 1, 3), date(2020, 2, 2)), ("a", date(2020, 11, 5), date(2021, 2, 1)), ("b", date(2020, 1, 1), date(2020, 1, 2))]
    made = month_request("sst", date(2020, 12, 1), date(2021, 2, 1), (1, 2, 3, 4), product_type="reanalysis")
    assert made["year"] == ["2020", "2021"] and made["month"] == ["01", "02", "12"] and made["area"] == [4, 2, 3, 1] and made["product_type"] == "reanalysis"


def test_grid_migration_unites_equal_grids(spark, tmp_path):
    store = ProductStore(spark, f"file://{tmp_path}")
    cells = spark.createDataFrame([(0, 0, 10.0, 10.0, 1.0)], "gy int, gx int, lat double, lon double, cell_area double")
    for name in ("old1", "old2"):
        cells.write.parquet(f"{store.root}/grids/{name}")
    spark.createDataFrame([("old1", "rectilinear", 1, 1, "grids/old1"), ("old2", "rectilinear", 1, 1, "grids/old2")], SCHEMAS["grids"]).write.parquet(f"{store.root}/catalogs/grids")
    spark.createDataFrame([("old1", 0, "r3_c0", 0, 1, 0, 1), ("old2", 0, "r3_c0", 0, 1, 0, 1)], SCHEMAS["bucket_windows"]).write.parquet(f"{store.root}/catalogs/bucket_windows")
    spark.createDataFrame([], SCHEMAS["product_index"]).write.parquet(f"{store.root}/catalogs/product_index")
    moved = store.migrate_grid_ids()
    assert len(set(moved.values())) == 1 and store.catalog("grids").count() == 1 and store.catalog("bucket_windows").count() == 1
    assert store.migrate_grid_ids() == {v: v for v in moved.values()} and store.ensure_grid(cells, "rectilinear") == moved["old1"]


def test_small_helpers():
    assert grid_mapping({"earth_radius": 1, "x": 2}) == {"earth_radius": 1} and grid_mapping({}) is None
    made = [("Source", 1), ("Month", 1), ("Month", 2)]
    assert nearest_product(made, "Month", 2) == ("Month", 2) and nearest_product(made, "Month", 4) == ("Month", 1) and nearest_product(made, "Day", 1) == ("Source", 1) and nearest_product([], "Day", 1) is None
