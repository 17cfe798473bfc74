"""Raster cubes made of the relational test tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import cell_area


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources with daily samples: ``dataset, ts, gy, gx, value``."""
    dataset = F.concat(F.lit("src_"), F.lower("l_returnflag")).alias("dataset")
    cell = [F.floor(F.col("l_suppkey") / 10e0).cast("int").alias("gy"), (F.col("l_suppkey") % 10).cast("int").alias("gx")]
    return table(spark, sf_dir, "lineitem").groupBy(dataset, F.col("l_shipdate").alias("ts"), *cell).agg(F.avg("l_quantity").alias("value"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five sources with hourly samples."""
    cell = [F.floor(F.col("user_id") / 15e0).cast("int").alias("gy"), (F.col("user_id") % 15).cast("int").alias("gx")]
    ts = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("dataset"), ts, *cell).agg(F.avg("value").alias("value"))


def grid_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The global equal-angle grid of ``daily``, with centres, bounds and areas."""
    supplier = table(spark, sf_dir, "supplier")
    height = 180e0 / math.ceil(supplier.count() / 10)
    row, col = F.floor(F.col("s_suppkey") / 10e0), F.col("s_suppkey") % 10
    bounds = {"lat_lo": -90e0 + row * height, "lat_hi": -90e0 + (row + 1) * height, "lon_lo": col * 36e0, "lon_hi": (col + 1) * 36e0}
    cells = supplier.select(
        row.cast("int").alias("gy"), col.cast("int").alias("gx"), (-90e0 + (row + 5e-1) * height).alias("lat"), ((col + 5e-1) * 36e0).alias("lon"),
        *(x.cast("double").alias(c) for c, x in bounds.items()),
    )
    return cells.withColumn("cell_area", cell_area(*(F.col(c) for c in bounds)))
