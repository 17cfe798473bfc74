"""The registered queries and the same in DuckDB SQL, name by name."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions import calendar, geo
from .ingest import Source, ingest
from .model import Operation, Product, Query, Region, Selection
from .operators import combine, spatial, stats, temporal
from .plans import metadata
from .plans.engine import Engine
from .sources import driver_tables as src
from .sources.store import ProductStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The same products of a window of the samples, to compare with; they are not registered.
WINDOWED = frozenset({"coarsen2_mean", "coarsen2_min", "coarsen2_max", "coarsen2_sum", "coarsen2_first", "regrid_bilinear_apply"})
#: The query window that most queries use, and a box across the seam.
START, END = datetime(1995, 1, 1), datetime(1996, 12, 31)
BOX, SEAM, GLOBE = Region(30.0, 200.0, -60.0, 60.0), Region(250.0, 60.0, -45.0, 70.0), Region(180.0, 180.0, -90.0, 90.0)
FACTOR = 2

#: The fixture tables as common table expressions.
DAILY = """daily AS (
    SELECT concat('src_', lower(l_returnflag)) AS dataset, l_shipdate AS ts, CAST(floor(l_suppkey / 10e0) AS INT) AS gy,
           CAST(l_suppkey % 10 AS INT) AS gx, avg(l_quantity) AS value
    FROM lineitem GROUP BY 1, 2, 3, 4)"""
HOURLY = """hourly AS (
    SELECT event_type AS dataset, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, CAST(floor(user_id / 15e0) AS INT) AS gy,
           CAST(user_id % 15 AS INT) AS gx, avg(value) AS value
    FROM events GROUP BY 1, 2, 3, 4)"""
GRID = """grid AS (
    SELECT CAST(floor(s_suppkey / 10e0) AS INT) AS gy, CAST(s_suppkey % 10 AS INT) AS gx,
           -90e0 + (floor(s_suppkey / 10e0) + 5e-1) * (180e0 / n.ny) AS lat, (s_suppkey % 10 + 5e-1) * 36e0 AS lon,
           -90e0 + floor(s_suppkey / 10e0) * (180e0 / n.ny) AS lat_lo, -90e0 + (floor(s_suppkey / 10e0) + 1) * (180e0 / n.ny) AS lat_hi,
           (s_suppkey % 10) * 36e0 AS lon_lo, (s_suppkey % 10 + 1) * 36e0 AS lon_hi,
           6371008.8e0 * 6371008.8e0 * radians(36e0) * abs(sin(radians(-90e0 + (floor(s_suppkey / 10e0) + 1) * (180e0 / n.ny)))
             - sin(radians(-90e0 + floor(s_suppkey / 10e0) * (180e0 / n.ny)))) AS cell_area
    FROM supplier CROSS JOIN (SELECT ceil(count(*) / 10e0) AS ny FROM supplier) n)"""
SAMPLES = f"{DAILY}, {GRID}, samples AS (SELECT d.*, g.lat, g.lon, g.cell_area FROM daily d JOIN grid g USING (gy, gx))"
WINDOW = "ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'"
IN_BOX = "lat BETWEEN -60 AND 60 AND lon BETWEEN 30 AND 200"
IN_SEAM = "lat BETWEEN -45 AND 70 AND (lon >= 250 OR lon <= 60)"
VALUE = {"mean": "sum(value * cell_area) / sum(cell_area)", "min": "min(value)", "max": "max(value)"}


def query(name: str, oracle: str | None = None):
    """Register a query under ``name``, with its SQL."""

    def add(run):
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return run

    return add


def r6(c: Column | str, name: str | None = None) -> Column:
    """Rounded to 6 digits, as sums depend on their order."""
    out = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return out.alias(name or c) if name or isinstance(c, str) else out


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Daily samples with the geometry of their cells."""
    return src.daily(spark, d).join(src.grid_daily(spark, d).select("gy", "gx", "lat", "lon", "cell_area"), ["gy", "gx"])


def in_window(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ts").between(F.lit(START).cast("timestamp_ntz"), F.lit(END).cast("timestamp_ntz")))


def windowed(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of the daily samples in the query window."""
    daily = in_window(src.daily(spark, d))
    return stats.expand(daily.join(src.grid_daily(spark, d).select("gy", "gx", "lat", "lon", "cell_area"), ["gy", "gx"]))


# --- the five functions -------------------------------------------------------------------------------------------

for _how in ("mean", "min", "max"):

    @query(f"get_data_{_how}", f"WITH {SAMPLES} SELECT dataset, ts, gy, gx, round(value, 6) AS value FROM samples WHERE {WINDOW} AND {IN_BOX}")
    def _get_data(spark, d, how=_how):
        found = stats.get_data(windowed(spark, d).filter(stats.region_mask(BOX)), how, "dataset", "ts", "gy", "gx")
        return found.select("dataset", "ts", "gy", "gx", r6("value"))

    @query(f"timeseries_{_how}", f"WITH {SAMPLES} SELECT dataset, ts, round({VALUE[_how]}, 6) AS value FROM samples WHERE {WINDOW} AND {IN_BOX} GROUP BY 1, 2" if _how != "mean" else f"WITH {SAMPLES} SELECT dataset, ts, round({VALUE[_how]}, 6) AS value FROM samples WHERE {IN_BOX} GROUP BY 1, 2")
    def _timeseries(spark, d, how=_how):
        cells = windowed(spark, d) if how != "mean" else stats.expand(samples(spark, d))
        return stats.timeseries(cells, how, "dataset", region=BOX).select("dataset", "ts", r6("value"))

    @query(f"heatmap_{_how}", f"WITH {SAMPLES} SELECT dataset, gy, gx, round({VALUE[_how]}, 6) AS value FROM samples WHERE {WINDOW} AND {IN_BOX} GROUP BY 1, 2, 3")
    def _heatmap(spark, d, how=_how):
        return stats.heatmap(windowed(spark, d), how, "dataset", region=BOX).select("dataset", "gy", "gx", r6("value"))


for _name, _op, _sql, _value in (("gt", "gt", ">", 25.0), ("ne", "ne", "<>", 25.0), ("le", "<=", "<=", 20.0), ("eq", "==", "=", 50.0), ("lt", "<", "<", 15.0), ("ge", ">=", ">=", 30.0)):
    _dense = f"WITH {SAMPLES}, t AS (SELECT dataset, ts, round(sum(CASE WHEN {IN_SEAM} THEN value * cell_area END) / sum(CASE WHEN {IN_SEAM} THEN cell_area END), 6) AS value FROM samples WHERE {WINDOW} GROUP BY 1, 2)"

    @query(f"find_time_{_name}", f"{_dense} SELECT dataset, ts, value, coalesce(value {_sql} {_value}, false) AS matches FROM t")
    def _find_time(spark, d, op=_op, value=_value):
        series = stats.timeseries(windowed(spark, d), "mean", "dataset", region=SEAM, dense=True)
        return stats.find(series.select("dataset", "ts", r6("value")), op, value)

    @query(f"find_area_{_name}", f"WITH {SAMPLES}, t AS (SELECT dataset, gy, gx, round(max(value), 6) AS value FROM samples WHERE {WINDOW} GROUP BY 1, 2, 3) SELECT *, coalesce(value {_sql} {_value}, false) AS matches FROM t")
    def _find_area(spark, d, op=_op, value=_value):
        return stats.find(stats.heatmap(windowed(spark, d), "max", "dataset", region=GLOBE).select("dataset", "gy", "gx", r6("value")), op, value)


@query("region_seam_timeseries_whole", f"WITH {SAMPLES} SELECT dataset, ts, round({VALUE['mean']}, 6) AS value FROM samples WHERE {IN_SEAM} GROUP BY 1, 2")
def _seam(spark, d):
    return stats.timeseries(stats.expand(samples(spark, d)), "mean", "dataset", region=SEAM).select("dataset", "ts", r6("value"))


@query("region_full_globe_whole", f"WITH {SAMPLES} SELECT dataset, ts, round({VALUE['mean']}, 6) AS value FROM samples GROUP BY 1, 2")
def _globe(spark, d):
    return stats.timeseries(stats.expand(samples(spark, d)), "mean", "dataset", region=GLOBE).select("dataset", "ts", r6("value"))


@query("expand_statistics_fallback_whole", f"WITH {SAMPLES} SELECT dataset, ts, gy, gx, round(value * greatest(cos(radians(lat)), 0), 6) AS weighted_sum, round(greatest(cos(radians(lat)), 0), 6) AS weight_sum, round(value, 6) AS min_v, round(value, 6) AS max_v FROM samples")
def _expand(spark, d):
    found = stats.expand(samples(spark, d), area=None)
    return found.select("dataset", "ts", "gy", "gx", *(r6(c) for c in stats.STATISTICS))


# --- time ---------------------------------------------------------------------------------------------------------

for _name, _unit, _cadence in (("day", "day", "1D"), ("month", "month", "1MS"), ("year", "year", "1YS")):

    @query(f"resample_{_name}_mean", f"WITH {DAILY} SELECT dataset, gy, gx, CAST(date_trunc('{_unit}', ts) AS TIMESTAMP) AS ts, round(avg(value), 6) AS value FROM daily GROUP BY ALL")
    def _resample(spark, d, cadence=_cadence):
        return temporal.resample(src.daily(spark, d), cadence, "mean", "dataset", "gy", "gx").select("dataset", "gy", "gx", "ts", r6("value"))


@query("resample_3h_sum", f"WITH {HOURLY} SELECT dataset, gy, gx, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, round(sum(value), 6) AS value FROM hourly GROUP BY ALL")
def _resample_3h(spark, d):
    return temporal.resample(src.hourly(spark, d), "3H", "sum", "dataset", "gy", "gx").select("dataset", "gy", "gx", "ts", r6("value"))


def _complete(unit: str) -> str:
    label = f"CAST(date_trunc('{unit}', ts) AS TIMESTAMP)"
    steps = f"date_diff('day', {label}, {label} + INTERVAL 1 {unit})"
    return f"SELECT dataset, {label} AS ts, count(DISTINCT ts) AS n_steps FROM daily GROUP BY dataset, {label}, {steps} HAVING count(DISTINCT ts) = {steps}"


for _unit, _cadence in (("month", "1MS"), ("year", "1YS")):

    @query(f"complete_periods_{_unit}", f"WITH {DAILY} {_complete(_unit)}")
    def _periods(spark, d, cadence=_cadence):
        return temporal.complete_periods(src.daily(spark, d), "1D", cadence, "dataset").select("dataset", "ts", "n_steps")


@query("complete_days_pooled", f"WITH {HOURLY} SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, count(DISTINCT ts) AS n_steps FROM hourly GROUP BY 1 HAVING count(DISTINCT ts) = 24")
def _days(spark, d):
    return temporal.complete_periods(src.hourly(spark, d), "1H", "1D").select("ts", "n_steps")


_MONTHS = f"""WITH {SAMPLES}, whole AS ({_complete('month')}),
    p AS (SELECT dataset, gy, gx, CAST(date_trunc('month', ts) AS TIMESTAMP) AS ts, sum(value * cell_area) AS ws, sum(cell_area) AS w, min(value) AS mn, max(value) AS mx
          FROM samples GROUP BY ALL),
    products AS (SELECT p.* FROM p SEMI JOIN whole USING (dataset, ts))"""


def monthly(spark: SparkSession, d: str) -> DataFrame:
    return temporal.temporal_product(stats.expand(samples(spark, d)), "1D", "1MS", "dataset", "gy", "gx", groups=("dataset",))


@query("temporal_product_month", f"{_MONTHS} SELECT dataset, gy, gx, ts, round(ws / 1e9, 3) AS weighted_sum, round(w / 1e6, 3) AS weight_sum, round(mn, 6) AS min_v, round(mx, 6) AS max_v FROM products")
def _product_month(spark, d):
    return monthly(spark, d).select("dataset", "gy", "gx", "ts", F.round(F.col("weighted_sum") / 1e9, 3).alias("weighted_sum"), F.round(F.col("weight_sum") / 1e6, 3).alias("weight_sum"), r6("min_v"), r6("max_v"))


@query("month_mean_from_stats", f"{_MONTHS} SELECT dataset, ts, round(sum(ws) / sum(w), 6) AS value FROM products GROUP BY 1, 2")
def _month_mean(spark, d):
    return stats.timeseries(monthly(spark, d), "mean", "dataset").select("dataset", "ts", r6("value"))


@query("temporal_sum_stats", f"""WITH {SAMPLES}, whole AS ({_complete('year')}),
    p AS (SELECT dataset, gy, gx, CAST(date_trunc('year', ts) AS TIMESTAMP) AS ts, sum(value) AS v, any_value(cell_area) AS a, min(value) AS mn, max(value) AS mx FROM samples GROUP BY ALL)
    SELECT dataset, gy, gx, ts, round(v * a / 1e9, 3) AS weighted_sum, round(a / 1e6, 3) AS weight_sum, round(mn, 6) AS min_v, round(mx, 6) AS max_v FROM p SEMI JOIN whole USING (dataset, ts)""")
def _sums(spark, d):
    found = temporal.temporal_product(stats.expand(samples(spark, d)), "1D", "1YS", "dataset", "gy", "gx", method="sum", groups=("dataset",))
    return found.select("dataset", "gy", "gx", "ts", F.round(F.col("weighted_sum") / 1e9, 3).alias("weighted_sum"), F.round(F.col("weight_sum") / 1e6, 3).alias("weight_sum"), r6("min_v"), r6("max_v"))


@query("temporal_first_aux", f"WITH {DAILY} SELECT dataset, gy, gx, CAST(date_trunc('month', ts) AS TIMESTAMP) AS ts, round(arg_min(value, ts), 6) AS value FROM daily GROUP BY ALL")
def _first(spark, d):
    return temporal.resample(src.daily(spark, d), "1MS", "first", "dataset", "gy", "gx").select("dataset", "gy", "gx", "ts", r6("value"))


@query("dedupe_timestamps", """SELECT user_id, ts, round(value, 6) AS value FROM (
    SELECT user_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, value, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_type, value) AS n FROM events) WHERE n = 1""")
def _dedupe(spark, d):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    rows = src.table(spark, d, "events").select("user_id", hour.alias("hour"), F.struct("ts", "event_type", "value").alias("at"))
    found = temporal.drop_repeated_timestamps(rows, "user_id", "hour", order="at")
    return found.select("user_id", F.col("hour").alias("ts"), r6(F.col("at.value"), "value"))


_STEPS = "SELECT count(*) AS n, count(DISTINCT t) AS n_distinct, min(date_diff('second', p, t)) AS least_step, max(date_diff('second', p, t)) AS most_step FROM (SELECT t, lag(t) OVER (ORDER BY t) AS p FROM a)"


@query("infer_cadence_daily", f"WITH a AS (SELECT DISTINCT l_shipdate AS t FROM lineitem) {_STEPS}")
def _cadence_daily(spark, d):
    axis = src.table(spark, d, "lineitem").select(F.col("l_shipdate").alias("ts")).distinct()
    return calendar.cadence_facts(axis).select("n", "n_distinct", "least_step", "most_step")


@query("infer_cadence_orders", f"WITH a AS (SELECT DISTINCT o_orderdate AS t FROM orders) {_STEPS}")
def _cadence_orders(spark, d):
    axis = src.table(spark, d, "orders").select(F.col("o_orderdate").alias("ts")).distinct()
    return calendar.cadence_facts(axis).select("n", "n_distinct", "least_step", "most_step")


@query("expected_timestamps", "SELECT CAST(t AS TIMESTAMP) AS ts FROM generate_series(TIMESTAMP '1995-02-01', TIMESTAMP '1996-12-31', INTERVAL 1 MONTH) g(t)")
def _expected(spark, d):
    return calendar.timestamp_table(spark, datetime(1995, 1, 15), END, "1MS")


_ORDER_DAYS = "e AS (SELECT CAST(t AS TIMESTAMP) AS ts FROM generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '1996-12-31', INTERVAL 1 DAY) g(t)), h AS (SELECT DISTINCT CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders)"


@query("coverage_hits", f"WITH {_ORDER_DAYS} SELECT ts FROM e SEMI JOIN h USING (ts)")
def _hits(spark, d):
    return metadata.coverage_hits(calendar.timestamp_table(spark, START, END, "1D"), src.table(spark, d, "orders").select(F.col("o_orderdate").alias("ts")), "ts")


@query("coverage_misses", f"WITH {_ORDER_DAYS} SELECT ts FROM e ANTI JOIN h USING (ts)")
def _misses(spark, d):
    return metadata.coverage_misses(calendar.timestamp_table(spark, START, END, "1D"), src.table(spark, d, "orders").select(F.col("o_orderdate").alias("ts")), "ts")


# --- space --------------------------------------------------------------------------------------------------------

_AGG = {"mean": "avg", "min": "min", "max": "max", "sum": "sum"}

for _how, _sql in _AGG.items():

    @query(f"coarsen2_{_how}", f"WITH {DAILY} SELECT dataset, ts, gy // 2 AS gy, gx // 2 AS gx, round({_sql}(value), 6) AS value FROM daily WHERE {WINDOW} GROUP BY ALL")
    def _coarsen(spark, d, how=_how):
        return spatial.coarsen(in_window(src.daily(spark, d)), FACTOR, how, "dataset", "ts").select("dataset", "ts", "gy", "gx", r6("value"))


@query("coarsen2_first", f"WITH {DAILY} SELECT dataset, ts, gy // 2 AS gy, gx // 2 AS gx, round(value, 6) AS value FROM daily WHERE {WINDOW} AND gy % 2 = 0 AND gx % 2 = 0")
def _coarsen_first(spark, d):
    return spatial.coarsen(in_window(src.daily(spark, d)), FACTOR, "first", "dataset", "ts").select("dataset", "ts", "gy", "gx", r6("value"))


#: Ingestion makes spatial products of all samples, without a window.
for _how, _sql in _AGG.items():

    @query(f"coarsen2_{_how}_whole", f"WITH {DAILY} SELECT dataset, ts, gy // 2 AS gy, gx // 2 AS gx, round({_sql}(value), 6) AS value FROM daily GROUP BY ALL")
    def _coarsen_whole(spark, d, how=_how):
        return spatial.coarsen(src.daily(spark, d), FACTOR, how, "dataset", "ts").select("dataset", "ts", "gy", "gx", r6("value"))


@query("coarsen2_first_whole", f"WITH {DAILY} SELECT dataset, ts, gy // 2 AS gy, gx // 2 AS gx, round(value, 6) AS value FROM daily WHERE gy % 2 = 0 AND gx % 2 = 0")
def _coarsen_first_whole(spark, d):
    return spatial.coarsen(src.daily(spark, d), FACTOR, "first", "dataset", "ts").select("dataset", "ts", "gy", "gx", r6("value"))


_CIRCLE = "round((degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))) + 360) % 360, 6)"


@query("coarsen2_grid", f"WITH {GRID} SELECT gy // 2 AS gy, gx // 2 AS gx, round(avg(lat), 6) AS lat, {_CIRCLE} AS lon, round(sum(cell_area) / 1e6, 3) AS cell_area, round(min(lat_lo), 6) AS lat_lo, round(max(lat_hi), 6) AS lat_hi, round(min(lon_lo), 6) AS lon_lo, round(max(lon_hi), 6) AS lon_hi FROM grid GROUP BY 1, 2")
def _coarsen_grid(spark, d):
    found = spatial.coarsen_grid(src.grid_daily(spark, d), FACTOR, bounds=True)
    return found.select("gy", "gx", r6("lat"), r6("lon"), F.round(F.col("cell_area") / 1e6, 3).alias("cell_area"), *(r6(c) for c in ("lat_lo", "lat_hi", "lon_lo", "lon_hi")))


@query("month_coarsen2_heatmap", f"{_MONTHS}, c AS (SELECT dataset, ts, gy // 2 AS gy, gx // 2 AS gx, sum(ws) AS ws, sum(w) AS w FROM products GROUP BY ALL) SELECT dataset, gy * 2 AS gy, gx * 2 AS gx, round(sum(ws) / sum(w), 6) AS value FROM c GROUP BY 1, 2, 3")
def _month_coarse(spark, d):
    coarse = spatial.spatial_product(monthly(spark, d), FACTOR, "dataset", "ts")
    found = stats.heatmap(coarse, "mean", "dataset")
    return found.select("dataset", spatial.native_index("gy", FACTOR).alias("gy"), spatial.native_index("gx", FACTOR).alias("gx"), r6("value"))


for _axis, _index in (("lat", "gy"), ("lon", "gx")):
    _half = f"coalesce((c - lag(c) OVER w) / 2, (lead(c) OVER w - c) / 2, 0.5)"
    _half2 = f"coalesce((lead(c) OVER w - c) / 2, (c - lag(c) OVER w) / 2, 0.5)"

    @query(f"axis_bounds_{_axis}", f"WITH {GRID}, a AS (SELECT DISTINCT {_index}, {_axis} AS c FROM grid) SELECT {_index}, round(c, 6) AS centre, round(c - {_half}, 6) AS lo, round(c + {_half2}, 6) AS hi FROM a WINDOW w AS (ORDER BY c)")
    def _bounds(spark, d, axis=_axis, index=_index):
        found = spatial.axis_bounds(src.grid_daily(spark, d).select(index, axis).distinct(), axis)
        return found.select(index, r6(F.col(axis), "centre"), r6(F.col(f"{axis}_lo"), "lo"), r6(F.col(f"{axis}_hi"), "hi"))


@query("cell_area", f"WITH {GRID} SELECT gy, gx, round(cell_area / 1e6, 3) AS cell_area FROM grid")
def _area(spark, d):
    return src.grid_daily(spark, d).select("gy", "gx", F.round(F.col("cell_area") / 1e6, 3).alias("cell_area"))


_CODE = "CAST((CASE WHEN lat = 90 THEN 5 ELSE floor((lat + 90) / 30) END) * 6 + floor((((lon % 360) + 360) % 360) / 60) AS INT)"


@query("bucket_code", f"WITH {GRID} SELECT gy, gx, {_CODE} AS code, printf('r%d_c%d', {_CODE} // 6, {_CODE} % 6) AS bucket_id FROM grid")
def _bucket(spark, d):
    tiles = geo.BucketGrid()
    return src.grid_daily(spark, d).select("gy", "gx", tiles.code("lat", "lon").alias("code")).withColumn("bucket_id", tiles.bucket_id(F.col("code")))


_BUCKETS = f"w AS (SELECT {_CODE} AS code, min(gy) AS y_start, max(gy) + 1 AS y_stop, min(gx) AS x_start, max(gx) + 1 AS x_stop FROM grid GROUP BY 1)"


def bucket_windows(spark: SparkSession, d: str) -> DataFrame:
    cells = src.grid_daily(spark, d).withColumn("code", geo.BucketGrid().code("lat", "lon"))
    return spatial.extent(cells, "code")


@query("bucket_windows", f"WITH {GRID}, {_BUCKETS} SELECT * FROM w")
def _bucket_windows(spark, d):
    return bucket_windows(spark, d)


@query("buckets_overlapping_region", "WITH b AS (SELECT CAST(r * 6 + c AS INT) AS code, r * 30 - 90 AS lat_min, r * 30 - 60 AS lat_max, c * 60 AS lon_min, c * 60 + 60 AS lon_max FROM range(6) a(r), range(6) e(c)) SELECT code FROM b WHERE lat_min <= 70 AND lat_max > -45 AND ((lon_min <= 360 AND lon_max > 250) OR (lon_min <= 60 AND lon_max > 0))")
def _overlap(spark, d):
    return metadata.overlapping_buckets(geo.BucketGrid().table(spark), SEAM).select("code")


@query("window_intersection", f"WITH {GRID}, {_BUCKETS} SELECT code, greatest(y_start, 2) AS y_start, least(y_stop, 7) AS y_stop, greatest(x_start, 1) AS x_start, least(x_stop, 8) AS x_stop FROM w WHERE y_start < 7 AND 2 < y_stop AND x_start < 8 AND 1 < x_stop")
def _windows(spark, d):
    part = spark.createDataFrame([("daily", 2, 7, 1, 8)], "grid_id string, y_start int, y_stop int, x_start int, x_stop int")
    found = spatial.intersect_windows(part, bucket_windows(spark, d).withColumn("grid_id", F.lit("daily")), "grid_id")
    return found.select("code", "y_start", "y_stop", "x_start", "x_stop")


@query("populated_extent_whole", f"WITH {SAMPLES} SELECT dataset, min(gy) AS y_start, max(gy) + 1 AS y_stop, min(gx) AS x_start, max(gx) + 1 AS x_stop FROM samples WHERE {IN_BOX} GROUP BY 1")
def _extent(spark, d):
    return spatial.extent(stats.expand(samples(spark, d)).filter((F.col("weight_sum") > 0) & stats.region_mask(BOX)), "dataset")


@query("normalize_longitude", f"WITH {GRID} SELECT gy, gx, round((((lon - 200) % 360) + 360) % 360, 6) AS lon FROM grid")
def _normalize(spark, d):
    return src.grid_daily(spark, d).select("gy", "gx", r6(geo.normalize_longitude(F.col("lon") - 200e0), "lon"))


@query("display_longitude", f"WITH {GRID} SELECT gy, gx, round(((lon + 180) % 360) - 180, 6) AS lon FROM grid")
def _display(spark, d):
    return src.grid_daily(spark, d).select("gy", "gx", r6(geo.display_longitude("lon"), "lon"))


@query("sorted_axis_index", f"WITH {GRID} SELECT gy, gx, CAST(dense_rank() OVER (ORDER BY lat) - 1 AS INT) AS lat_index, CAST(dense_rank() OVER (ORDER BY (lon + 180) % 360) - 1 AS INT) AS lon_index FROM grid")
def _axis_index(spark, d):
    cells = src.grid_daily(spark, d).withColumn("shifted", geo.normalize_longitude(F.col("lon") + 180e0))
    found = spatial.sorted_axis_index(spatial.sorted_axis_index(cells, "lat", "lat_index"), "shifted", "lon_index")
    return found.select("gy", "gx", "lat_index", "lon_index")


_LAMBERT = geo.Lambert(80.0, 80.0, 80.0, 326.0)
_N, _F, _RHO = _LAMBERT.constants
_RHO_SQL = f"({_LAMBERT.radius * _F!r}e0 / pow(tan(pi() / 4 + radians(lat) / 2), {_N!r}e0))"
_THETA_SQL = f"({_N!r}e0 * radians((((lon - 326 + 180) % 360) + 360) % 360 - 180))"


@query("lambert_forward", f"WITH {GRID} SELECT gy, gx, round({_RHO_SQL} * sin({_THETA_SQL}), 3) AS x, round({_RHO!r}e0 - {_RHO_SQL} * cos({_THETA_SQL}), 3) AS y FROM grid WHERE lat > 0")
def _lambert(spark, d):
    x, y = _LAMBERT.forward("lat", "lon")
    return src.grid_daily(spark, d).filter("lat > 0").select("gy", "gx", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("lambert_round_trip", f"WITH {GRID} SELECT gy, gx, round(lat, 6) AS lat, round(lon, 6) AS lon FROM grid WHERE lat > 0")
def _lambert_back(spark, d):
    x, y = _LAMBERT.forward("lat", "lon")
    lat, lon = _LAMBERT.inverse("x", "y")
    return src.grid_daily(spark, d).filter("lat > 0").select("gy", "gx", x.alias("x"), y.alias("y")).select("gy", "gx", r6(lat, "lat"), r6(lon, "lon"))


# --- blending -----------------------------------------------------------------------------------------------------


@query("daily_mean_with_coverage", f"WITH {HOURLY} SELECT dataset, gy, gx, CAST(date_trunc('day', ts) AS TIMESTAMP) AS ts, CASE WHEN count(value) >= 2 THEN round(avg(value), 6) END AS value, count(value) AS n_valid FROM hourly GROUP BY ALL")
def _coverage(spark, d):
    found = combine.daily_mean_with_coverage(src.hourly(spark, d), 2, "dataset", "gy", "gx")
    return found.select("dataset", "gy", "gx", "ts", r6("value"), "n_valid")


_WEIGHT = "CASE dataset WHEN 'src_a' THEN 2e0 WHEN 'src_r' THEN 0.5e0 ELSE 1e0 END"


@query("combine_weighted_mean", f"WITH {DAILY} SELECT ts, gy, gx, round(sum(value * {_WEIGHT}) / sum({_WEIGHT}), 6) AS value FROM daily GROUP BY 1, 2, 3")
def _combine(spark, d):
    weight = combine.source_weight({"src_a": 2.0, "src_r": 0.5})
    return combine.weighted_mean(src.daily(spark, d), "ts", "gy", "gx", weight=weight).select("ts", "gy", "gx", r6("value"))


@query("source_count", f"WITH {DAILY} SELECT ts, gy, gx, CAST(count(value) AS SMALLINT) AS source_count FROM daily GROUP BY 1, 2, 3")
def _sources(spark, d):
    return combine.weighted_mean(src.daily(spark, d), "ts", "gy", "gx").select("ts", "gy", "gx", "source_count")


_REGRID = f"""WITH {DAILY}, {GRID}, lat AS (SELECT DISTINCT gy AS i0, lat AS c0 FROM grid), lats AS (SELECT i0, c0, lead(i0) OVER (ORDER BY c0) AS i1, lead(c0) OVER (ORDER BY c0) AS c1 FROM lat),
    lon0 AS (SELECT DISTINCT gx AS i0, lon AS c0 FROM grid), lon AS (SELECT * FROM lon0 UNION ALL SELECT i0, c0 + 360 FROM lon0 WHERE c0 = (SELECT min(c0) FROM lon0)),
    lons AS (SELECT i0, c0, lead(i0) OVER (ORDER BY c0) AS i1, lead(c0) OVER (ORDER BY c0) AS c1 FROM lon),
    ty AS (SELECT CAST(k AS INT) AS dst_gy, -50e0 + k * 25e0 AS t FROM range(5) r(k)), tx AS (SELECT CAST(k AS INT) AS dst_gx, 10e0 + k * 50e0 AS t FROM range(7) r(k)),
    wy AS (SELECT dst_gy, i0 AS src_gy, 1 - (t - c0) / (c1 - c0) AS w FROM ty JOIN lats ON t >= c0 AND t < c1 UNION ALL SELECT dst_gy, i1, (t - c0) / (c1 - c0) FROM ty JOIN lats ON t >= c0 AND t < c1),
    p AS (SELECT dst_gx, CASE WHEN t < (SELECT min(c0) FROM lon0) THEN t + 360 ELSE t END AS t FROM tx),
    wx AS (SELECT dst_gx, i0 AS src_gx, 1 - (t - c0) / (c1 - c0) AS w FROM p JOIN lons ON t >= c0 AND t < c1 UNION ALL SELECT dst_gx, i1, (t - c0) / (c1 - c0) FROM p JOIN lons ON t >= c0 AND t < c1),
    weights AS (SELECT dst_gy, dst_gx, src_gy, src_gx, wy.w * wx.w AS w FROM wy, wx WHERE wy.w > 0 AND wx.w > 0)"""


def regrid_weights(spark: SparkSession, d: str) -> DataFrame:
    grid = src.grid_daily(spark, d)
    k = F.col("id")
    target = spark.range(35).select(F.floor(k / 7).cast("int").alias("gy"), (k % 7).cast("int").alias("gx"), (-50e0 + F.floor(k / 7) * 25e0).alias("lat"), (10e0 + (k % 7) * 50e0).alias("lon"))
    return combine.bilinear_weights(grid.select("gy", "lat").distinct(), grid.select("gx", "lon").distinct(), target, periodic=True)


@query("regrid_bilinear_weights", f"{_REGRID} SELECT dst_gy, dst_gx, src_gy, src_gx, round(w, 6) AS w FROM weights")
def _weights(spark, d):
    return regrid_weights(spark, d).select("dst_gy", "dst_gx", "src_gy", "src_gx", r6("w"))


@query("regrid_bilinear_apply", f"{_REGRID} SELECT dataset, ts, dst_gy AS gy, dst_gx AS gx, round(sum(value * w) / sum(w), 6) AS value FROM daily JOIN weights ON gy = src_gy AND gx = src_gx WHERE {WINDOW} GROUP BY ALL")
def _regrid(spark, d):
    found = combine.apply_weights(in_window(src.daily(spark, d)), regrid_weights(spark, d), "dataset", "ts")
    return found.select("dataset", "ts", "gy", "gx", r6("value"))


@query("regrid_bilinear_apply_whole", f"{_REGRID} SELECT dataset, ts, dst_gy AS gy, dst_gx AS gx, round(sum(value * w) / sum(w), 6) AS value FROM daily JOIN weights ON gy = src_gy AND gx = src_gx GROUP BY ALL")
def _regrid_whole(spark, d):
    found = combine.apply_weights(src.daily(spark, d), regrid_weights(spark, d), "dataset", "ts")
    return found.select("dataset", "ts", "gy", "gx", r6("value"))


_NY = "(SELECT ceil(count(*) / 10e0) AS ny FROM supplier)"
#: A projected source grid: the cube's columns and rows as places along x and y, in metres.
_X0, _DX, _Y0, _Y_SPAN = -3e6, 6e5, -4e6, 6e6
_PROJECTED = f"""WITH {DAILY}, {GRID},
    t AS (SELECT gy AS dst_gy, gx AS dst_gx, ny, ({_RHO_SQL} * sin({_THETA_SQL}) - ({_X0!r})) / {_DX!r} AS fx, ({_RHO!r}e0 - {_RHO_SQL} * cos({_THETA_SQL}) - ({_Y0!r})) / ({_Y_SPAN!r} / ny) AS fy
          FROM grid, {_NY} n WHERE lat > 0),
    f AS (SELECT * FROM t WHERE fx BETWEEN 0 AND 9 AND fy BETWEEN 0 AND ny - 1),
    ey AS (SELECT *, CAST(floor(fy) AS INT) AS src_gy, 1 - (fy - floor(fy)) AS wy FROM f UNION ALL SELECT *, CAST(floor(fy) + 1 AS INT), fy - floor(fy) FROM f),
    e AS (SELECT *, CAST(floor(fx) AS INT) AS src_gx, wy * (1 - (fx - floor(fx))) AS w FROM ey UNION ALL SELECT *, CAST(floor(fx) + 1 AS INT), wy * (fx - floor(fx)) FROM ey),
    weights AS (SELECT dst_gy, dst_gx, src_gy, src_gx, w FROM e WHERE w > 0)"""


def projected_weights(spark: SparkSession, d: str) -> DataFrame:
    ny = math.ceil(src.table(spark, d, "supplier").count() / 10)
    return combine.projected_weights(_LAMBERT, (_X0, _DX, 10), (_Y0, _Y_SPAN / ny, ny), src.grid_daily(spark, d).filter("lat > 0"))


@query("regrid_projected_weights", f"{_PROJECTED} SELECT dst_gy, dst_gx, src_gy, src_gx, round(w, 6) AS w FROM weights")
def _projected_weights(spark, d):
    return projected_weights(spark, d).select("dst_gy", "dst_gx", "src_gy", "src_gx", r6("w"))


@query("regrid_projected_apply", f"{_PROJECTED} SELECT dataset, ts, dst_gy AS gy, dst_gx AS gx, round(sum(value * w) / sum(w), 6) AS value FROM daily JOIN weights ON gy = src_gy AND gx = src_gx GROUP BY ALL")
def _projected_apply(spark, d):
    found = combine.apply_weights(src.daily(spark, d), projected_weights(spark, d), "dataset", "ts")
    return found.select("dataset", "ts", "gy", "gx", r6("value"))


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cube = src.daily(spark, d)
    return tuple(cube.filter(F.col("dataset") == name).drop("dataset") for name in ("src_a", "src_r"))


_PAIR = f"WITH {DAILY}, a AS (SELECT * FROM daily WHERE dataset = 'src_a'), b AS (SELECT * FROM daily WHERE dataset = 'src_r')"


@query("pair_mean_exact", f"{_PAIR} SELECT ts, gy, gx, round((a.value + b.value) / 2, 6) AS value FROM a JOIN b USING (ts, gy, gx)")
def _pair_exact(spark, d):
    return combine.pair_mean(*_pair(spark, d), "ts", "gy", "gx").select("ts", "gy", "gx", r6("value"))


@query("pair_mean_any", f"{_PAIR} SELECT ts, gy, gx, round(avg(value), 6) AS value FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2, 3")
def _pair_any(spark, d):
    return combine.pair_mean(*_pair(spark, d), "ts", "gy", "gx", exact=False).select("ts", "gy", "gx", r6("value"))


@query("pair_diff", f"{_PAIR} SELECT ts, gy, gx, round(a.value - b.value, 6) AS value FROM a JOIN b USING (ts, gy, gx)")
def _pair_diff(spark, d):
    return combine.pair_difference(*_pair(spark, d), "ts", "gy", "gx").select("ts", "gy", "gx", r6("value"))


# --- metadata -----------------------------------------------------------------------------------------------------

_INDEX = f"""{DAILY}, idx AS (SELECT dataset, CAST(date_trunc('year', ts) AS TIMESTAMP) AS period, min(ts) AS time_start, max(ts) AS time_end,
    min(gy) AS y_start, max(gy) + 1 AS y_stop, min(gx) AS x_start, max(gx) + 1 AS x_stop FROM daily GROUP BY 1, 2)"""


def index(spark: SparkSession, d: str) -> DataFrame:
    """A product index of the daily cube: a row per dataset and year."""
    return metadata.index_of(src.daily(spark, d), "1YS", "dataset")


@query("product_index", f"WITH {_INDEX} SELECT * FROM idx")
def _index(spark, d):
    return index(spark, d)


@query("product_index_prune", f"WITH {_INDEX}, c AS (SELECT 'src_a' AS dataset, 'x' AS repository UNION ALL SELECT 'src_r', 'x') SELECT idx.*, repository FROM idx JOIN c USING (dataset) WHERE time_start <= TIMESTAMP '1996-12-31' AND time_end >= TIMESTAMP '1995-01-01'")
def _prune(spark, d):
    catalog = spark.createDataFrame([("src_a", "x"), ("src_r", "x")], "dataset string, repository string")
    return metadata.prune_index(index(spark, d), catalog, START, END, "dataset")


@query("group_windows", f"WITH {_INDEX} SELECT dataset, min(y_start) AS y_start, max(y_stop) AS y_stop, min(x_start) AS x_start, max(x_stop) AS x_stop, count(*) AS n_partitions FROM idx GROUP BY 1")
def _groups(spark, d):
    return metadata.group_windows(index(spark, d), "dataset")


@query("availability_summary", f"WITH {_INDEX}, {GRID}, g AS (SELECT round(min(lon_lo), 3) AS west, round(max(lon_hi), 3) AS east, round(min(lat_lo), 3) AS south, round(max(lat_hi), 3) AS north FROM grid) SELECT dataset, west, east, south, north, min(time_start) AS time_start, max(time_end) AS time_end FROM idx, g GROUP BY ALL")
def _availability(spark, d):
    return metadata.availability(index(spark, d).withColumn("grid_id", F.lit("daily")), src.grid_daily(spark, d).withColumn("grid_id", F.lit("daily")), "dataset")


@query("available_products", "SELECT DISTINCT concat('src_', lower(l_returnflag)) AS dataset, u AS time_unit, CAST(f AS INT) AS coarseness_factor FROM lineitem, (VALUES ('Source', 1), ('Month', 1), ('Month', 2), ('Year', 1), ('Year', 2)) v(u, f)")
def _products(spark, d):
    made = F.array(*(F.struct(F.lit(u).alias("time_unit"), F.lit(f).alias("coarseness_factor")) for u, f in temporal.product_policy("1D")))
    return src.daily(spark, d).select("dataset").distinct().select("dataset", F.explode(made).alias("p")).select("dataset", "p.*")


@query("shared_value_range_whole", f"WITH {DAILY} SELECT 'K' AS units, coalesce(round(min(value), 6), 0) AS low, coalesce(round(max(value), 6), 1) AS high FROM daily")
def _range(spark, d):
    found = metadata.value_range(src.daily(spark, d).withColumn("units", F.lit("K")), "units")
    return found.select("units", r6("low"), r6("high"))


@query("axis_spacing_median", f"WITH {GRID}, a AS (SELECT DISTINCT lat AS c FROM grid), s AS (SELECT abs(c - lag(c) OVER (ORDER BY c)) AS s FROM a), p AS (SELECT s, row_number() OVER (ORDER BY s) AS k, count(*) OVER () AS n FROM s WHERE s > 0) SELECT coalesce((SELECT round(s, 6) FROM p WHERE k = n // 2 + 1), 1) AS spacing")
def _spacing(spark, d):
    return metadata.axis_spacing(src.grid_daily(spark, d), "lat").select(r6("spacing"))


_LISTED = f"""WITH {_INDEX}, {GRID}, d AS (SELECT 'src_a' AS dataset, 'lab' AS repository, '{{}}' AS additional_parameters, '1D' AS t UNION ALL SELECT 'src_r', 'lab', '{{"height":"15m"}}', NULL),
    g AS (SELECT min(lon) AS w, max(lon) AS e, round(min(lat), 3) AS south, round(max(lat), 3) AS north FROM grid)"""


@query("availability_listing", f"{_LISTED} SELECT repository, dataset, 'quantity' AS variable, additional_parameters, round(CASE WHEN e - w >= 359 THEN -180e0 WHEN w >= 180 THEN w - 360 WHEN e <= 180 THEN w ELSE -180e0 END, 3) AS west, round(CASE WHEN e - w >= 359 THEN 180e0 WHEN w >= 180 THEN e - 360 WHEN e <= 180 THEN e ELSE 180e0 END, 3) AS east, south, north, min(time_start) AS time_start, max(time_end) AS time_end, '0.5' AS spatial, coalesce(t, '') AS temporal FROM idx JOIN d USING (dataset), g GROUP BY ALL")
def _listing(spark, d):
    known = [("src_a", "quantity", "lab", "src_a", "{}", 0.5, "1D"), ("src_r", "quantity", "lab", "src_r", '{"height":"15m"}', 0.5, None), ("src_x", "quantity", "lab", "none", "{}", 1.0, "1H")]
    datasets = spark.createDataFrame(known, "dataset_variant_id string, variable string, repository string, dataset string, additional_parameters string, spatial_resolution double, temporal_resolution string")
    entries = index(spark, d).withColumnsRenamed({"dataset": "dataset_variant_id"}).withColumns({"variable": F.lit("quantity"), "grid_id": F.lit("daily")})
    found = metadata.availability_listing(entries, datasets, src.grid_daily(spark, d).withColumn("grid_id", F.lit("daily")))
    lists = {"spatial": "spatial_resolutions", "temporal": "temporal_resolutions"}
    return found.withColumns({k: F.array_join(F.col(c).cast("array<string>"), ",") for k, c in lists.items()}).drop(*lists.values())


@query("covered_cells", f"WITH {_INDEX}, b AS (SELECT DISTINCT dataset AS bucket_id, ts FROM daily), e AS (SELECT DISTINCT ts FROM daily), x AS (SELECT DISTINCT dataset AS bucket_id, ts FROM (SELECT DISTINCT dataset FROM daily), e) SELECT bucket_id, ts FROM x WHERE EXISTS (SELECT 1 FROM idx WHERE idx.dataset = bucket_id AND ts BETWEEN time_start AND time_end)")
def _covered(spark, d):
    """Expected (bucket, time) pairs that some partition holds; datasets stand for buckets, every time of the cube is expected of each."""
    times, partitions = src.daily(spark, d).select("ts").distinct(), index(spark, d).withColumnRenamed("dataset", "bucket_id")
    buckets = F.explode(F.array(*(F.lit(f"src_{x}") for x in ("a", "n", "r")))).alias("bucket_id")
    return metadata.covered_cells(partitions, times.select(buckets, "ts"))


@query("grid_periodicity", f"WITH {GRID} SELECT max(lon_hi) - min(lon_lo) >= 359 AS periodic FROM grid")
def _periodic(spark, d):
    return spatial.is_periodic(src.grid_daily(spark, d))


@query("corner_unwrap", f"WITH {GRID} SELECT gy, gx, round(lon_hi + 180 - 360 * round((lon_hi + 180 - lon) / 360), 6) AS corner FROM grid")
def _unwrap(spark, d):
    return src.grid_daily(spark, d).select("gy", "gx", r6(geo.unwrap_longitude(F.col("lon_hi") + 180e0, F.col("lon")), "corner"))


for _axis in ("lat", "lon"):

    @query(f"axis_edges_{_axis}", f"WITH {GRID}, e AS (SELECT DISTINCT round({_axis}_lo, 6) AS edge FROM grid UNION SELECT round(max({_axis}_hi), 6) FROM grid) SELECT CAST(row_number() OVER (ORDER BY edge) - 1 AS INT) AS position, edge FROM e")
    def _edges(spark, d, axis=_axis):
        return spatial.axis_edges(src.grid_daily(spark, d), axis, (f"{axis}_lo", f"{axis}_hi")).select("position", r6("edge"))


@query("clean_regridded_axes", f"WITH {GRID}, u AS (SELECT DISTINCT gy, lat, ((lon + 180) % 360) - 180 AS lon FROM grid) SELECT CAST(dense_rank() OVER (ORDER BY gy) - 1 AS INT) AS gy, CAST(dense_rank() OVER (ORDER BY lon) - 1 AS INT) AS gx, round(lat, 6) AS lat, round(lon, 6) AS lon FROM u")
def _clean(spark, d):
    """The daily grid with each column twice, once a whole turn further on, as a regridder may leave it."""
    cells = src.grid_daily(spark, d).select("gy", "gx", "lat", "lon")
    twice = cells.unionByName(cells.withColumns({"gx": F.col("gx") + 10, "lon": F.col("lon") + 360e0}))
    return spatial.clean_axes(twice).select("gy", "gx", r6("lat"), r6("lon"))


@query("estimate_cost", f"WITH {_INDEX} SELECT count(DISTINCT dataset) AS n_groups, count(*) AS n_blocks, CAST(sum((y_stop - y_start) * (x_stop - x_start)) AS BIGINT) AS n_cells FROM idx WHERE time_start <= TIMESTAMP '1996-12-31' AND time_end >= TIMESTAMP '1995-01-01'")
def _cost(spark, d):
    found = index(spark, d).filter((F.col("time_start") <= F.lit(END).cast("timestamp_ntz")) & (F.col("time_end") >= F.lit(START).cast("timestamp_ntz")))
    return metadata.cost(found, "dataset")


@query("result_metrics_whole", f"WITH {SAMPLES} SELECT dataset, count(DISTINCT ts) AS n_timestamps, count(DISTINCT (gy, gx)) AS n_cells, count(value) AS n_values FROM samples WHERE {IN_BOX} GROUP BY 1")
def _metrics(spark, d):
    return metadata.result_metrics(stats.expand(samples(spark, d)).filter(stats.region_mask(BOX)), "dataset")


# --- the store ----------------------------------------------------------------------------------------------------

#: All times of the cube, and a box whose edges cut blocks of two cells.
EVER, CUT_BOX = (datetime(1995, 1, 1), datetime(2001, 12, 31, 23)), Region(50.0, 200.0, -40.0, 70.0)


def _engine(spark: SparkSession) -> Engine:
    """An engine on a new, empty store in the folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='gridtide-store-')}"
    return Engine(ProductStore(spark, f"{base.rstrip('/')}/store-{uuid.uuid4().hex}"), Settings())


def _source(spark: SparkSession, d: str, dataset: str = "src_a") -> Source:
    data = src.daily(spark, d).filter(F.col("dataset") == dataset).drop("dataset")
    return Source("lab", dataset, "quantity", "1", data, src.grid_daily(spark, d), native="1D")


def ask(engine: Engine, unit: str, factor: int, region: Region, function: str, how: str = "mean") -> DataFrame:
    return engine.execute(Query(Selection("quantity"), EVER, region, Product(unit, factor), Operation(function, how))).data


@query("store_overlapping_writes", f"WITH {SAMPLES} SELECT ts, round({VALUE['mean']}, 6) AS value FROM samples WHERE dataset = 'src_a' AND {IN_BOX} GROUP BY 1")
def _overlapping(spark, d):
    """Half of June 1998 is written twice, as it arrives in two deliveries; the other months are told to be there already."""
    engine, source = _engine(spark), _source(spark, d)
    store = engine.store
    grid, variant = store.ensure_grid(source.grid, "rectilinear"), store.upsert_dataset(source.repository, source.dataset, {"quantity": {"units": "1"}})
    until = F.lit(datetime(1998, 6, 15)).cast("timestamp_ntz")
    for data in (source.data.filter(F.col("ts") <= until), source.data):
        store.write_product(data, variant, "quantity", grid, "Source", 1, "1D")
    return ask(engine, "Source", 1, BOX, "timeseries").select("ts", r6("value"))


_COARSE = f"""{_MONTHS}, c AS (SELECT gy // 2 AS gy, gx // 2 AS gx, sum(ws) AS ws, sum(w) AS w FROM products WHERE dataset = 'src_a' GROUP BY ALL),
    g AS (SELECT gy // 2 AS gy, gx // 2 AS gx, avg(lat) AS lat, (degrees(atan2(avg(sin(radians(lon))), avg(cos(radians(lon))))) + 360) % 360 AS lon FROM grid GROUP BY ALL)"""


@query("store_month_coarse_heatmap", f"{_COARSE} SELECT gy * 2 AS gy, gx * 2 AS gx, round(lat, 6) AS lat, round(lon, 6) AS lon, round(ws / w, 6) AS value FROM c JOIN g USING (gy, gx) WHERE lat BETWEEN -40 AND 70 AND lon BETWEEN 50 AND 200")
def _stored_heatmap(spark, d):
    engine, source = _engine(spark), _source(spark, d)
    ingest(engine.store, source, engine.settings)
    found = ask(engine, "Month", 2, CUT_BOX, "heatmap")
    if found is None:  # no month is complete
        return spark.createDataFrame([], "gy int, gx int, lat double, lon double, value double")
    return found.select("gy", "gx", r6("lat"), r6("lon"), r6("value"))


_YEARS = f"""WITH {SAMPLES}, whole AS ({_complete('year')}),
    p AS (SELECT dataset, CAST(date_trunc('year', ts) AS TIMESTAMP) AS ts, max(value) AS value FROM samples WHERE lat BETWEEN -40 AND 70 AND lon BETWEEN 50 AND 200 GROUP BY ALL)"""


@query("store_year_timeseries", f"{_YEARS} SELECT ts, round(value, 6) AS value FROM p SEMI JOIN whole USING (dataset, ts) WHERE dataset = 'src_a'")
def _stored_years(spark, d):
    engine, source = _engine(spark), _source(spark, d)
    ingest(engine.store, source, engine.settings)
    found = ask(engine, "Year", 1, CUT_BOX, "timeseries", "max")
    return found.select("ts", r6("value")) if found is not None else spark.createDataFrame([], "ts timestamp_ntz, value double")
