"""Availability, axes and coverage against SQL; standardized output, sources of a blend and paths of products."""

import json
from datetime import datetime

import duckdb
import pytest
from gridtide import queries
from gridtide.functions.identity import source_key
from gridtide.operators import spatial
from gridtide.sources import store as stores
from gridtide.sources.standardize import standardize, write_standardized

DATA = "/root/testdata/sf0.01"
NAMES = ("availability_listing", "covered_cells", "grid_periodicity", "corner_unwrap", "axis_edges_lat", "axis_edges_lon", "clean_regridded_axes")


@pytest.fixture(scope="module")
def db():
    made = duckdb.connect()
    for table in ("lineitem", "supplier"):
        made.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return made


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_sql(spark, db, name):
    found, sql = queries.QUERIES[name](spark, DATA), db.execute(queries.ORACLES[name])
    columns = [c[0] for c in sql.description]
    assert sorted(columns) == sorted(found.columns)
    rows = sorted(map(tuple, found.select(columns).collect()))
    assert rows and rows == sorted(sql.fetchall())


def test_edges_between_centres(spark):
    axis = spark.createDataFrame([(0.0,), (1.0,), (3.0,), (3.0,)], "c double")
    assert [r["edge"] for r in spatial.axis_edges(axis, "c").orderBy("position").collect()] == [-0.5, 0.5, 2.0, 4.0]
    assert [r["edge"] for r in spatial.axis_edges(axis.limit(1), "c").orderBy("position").collect()] == [-0.5, 0.5]
    assert spatial.axis_edges(axis.filter("c > 9"), "c").count() == 0


def test_repeated_axis_values_keep_the_first(spark):
    cells = spark.createDataFrame([(y, x, lat, lon, 10 * y + x) for y, lat in enumerate((5.0, 6.0, 5.0)) for x, lon in enumerate((350.0, 10.0, -10.0))], "gy int, gx int, lat double, lon double, v int")
    found = spatial.clean_axes(cells, "v").collect()
    assert sorted(map(tuple, found)) == [(0, 0, 5.0, -10.0, 0), (0, 1, 5.0, 10.0, 1), (1, 0, 6.0, -10.0, 10), (1, 1, 6.0, 10.0, 11)]


def test_sources_of_a_blend():
    record = {"repository": "lab", "dataset": "a", "variable": "t"}
    assert source_key(record) == ("lab", "a", "t", "{}") == source_key(record | {"additional_parameters": None})
    assert source_key(record | {"additional_parameters": {"z": 1, "b": 2}})[3] == '{"b":2,"z":1}'


def test_standardized_output(spark, tmp_path):
    source = spark.createDataFrame([(datetime(2020, 1, 1), 10.0, x, 1.0, 2) for x in (350.0, 10.0)], "time timestamp_ntz, lat double, lon double, sst double, height int")
    raw, manifest = f"file://{tmp_path}/raw", f"file://{tmp_path}/manifest"
    source.write.parquet(raw)
    record = {"repository": "lab", "dataset": "a", "file_paths": [raw]}
    with pytest.raises(Exception, match="scheme"):
        write_standardized(standardize(spark.read.parquet(raw), "sst", {"sst": "temperature"}), "nowhere://x", record, manifest, remove_sources=True)
    assert (tmp_path / "raw").exists() and not (tmp_path / "manifest").exists()
    for _ in range(2):
        made = write_standardized(standardize(source, "sst", {"sst": "temperature"}), f"file://{tmp_path}/out", record, manifest, remove_sources=True)
        assert spark.read.parquet(f"{made['file_path']}/data").count() == 2 and spark.read.parquet(f"{made['file_path']}/grid").count() == 2
    lines = [json.loads(r["value"]) for r in spark.read.text(manifest).collect()]
    assert len(lines) == 2 and made in lines and made["variable"] == "temperature" and made["constants"] == {"height": 2} and "file_paths" not in made
    assert not (tmp_path / "raw").exists()


def test_paths_stay_inside_the_store(spark, tmp_path):
    made = stores.ProductStore(spark, f"file://{tmp_path}/s")
    assert made.product_paths() == []
    row = lambda path, day: (path, "v", "t", "g", "Day", 1, "2020-01", datetime(2020, 1, day), datetime(2020, 1, day), 0, 1, 0, 1, "1D", path)
    add = lambda *rows: spark.createDataFrame(rows, stores.SCHEMAS["product_index"]).write.mode("append").parquet(f"{made.root}/catalogs/product_index")
    add(row("products/b", 1), row("products/a", 2), row("products/b", 3))
    assert made.product_paths() == [f"{made.root}/products/b", f"{made.root}/products/a"]
    add(row("products/../../x", 4))
    with pytest.raises(ValueError, match="leaves the store"):
        made.product_paths()
