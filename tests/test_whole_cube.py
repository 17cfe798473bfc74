"""Spatial products and regridding over all samples, not a window of them, against DuckDB."""

import duckdb
import pytest
from gridtide import queries
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01"
NAMES = [*(f"coarsen2_{how}" for how in ("mean", "min", "max", "sum", "first")), "regrid_bilinear_apply"]


@pytest.mark.parametrize("name", NAMES)
def test_whole_cube(spark, name):
    db = duckdb.connect()
    for table in ("lineitem", "supplier"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = queries.QUERIES[f"{name}_whole"](spark, DATA)
    assert sorted(map(tuple, found.collect())) == sorted(db.execute(queries.ORACLES[f"{name}_whole"]).fetchall())
    span = found.agg(F.min("ts"), F.max("ts")).first()
    assert span[1] > queries.END
    inside = queries.QUERIES[name](spark, DATA)
    assert inside.exceptAll(queries.in_window(found)).isEmpty() and queries.in_window(found).exceptAll(inside).isEmpty()
