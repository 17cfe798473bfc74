"""Coarser grids, extents and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import circular_mean, display_longitude
from .stats import STATISTICS, reducer

BLOCK = ("gy", "gx")


def block_index(axis: str, factor: int) -> Column:
    return F.expr(f"{axis} div {factor}").cast("int")


def coarsen(samples: DataFrame, factor: int, method: str, *keys: str, value: str = "value") -> DataFrame:
    """Reduce blocks of ``factor`` x ``factor`` cells; ragged edges use what exists. ``first`` is the top-left cell."""
    if factor < 1:
        raise ValueError("the factor must be at least 1")
    if method == "first":
        picked = samples.filter((F.col("gy") % factor == 0) & (F.col("gx") % factor == 0))
        return picked.select(*keys, block_index("gy", factor).alias("gy"), block_index("gx", factor).alias("gx"), F.col(value).alias("value"))
    return samples.groupBy(*keys, *(block_index(c, factor).alias(c) for c in BLOCK)).agg(reducer(method, value).alias("value"))


def auxiliary_method(name: str, flag: bool = False, numeric: bool = True) -> str:
    """How a further column is coarsened."""
    if name == "source_count":
        return "max"
    if name == "cell_area":
        return "sum"
    return "mean" if numeric and not flag else "first"


def spatial_product(stats: DataFrame, factor: int, *keys: str, maxima: tuple[str, ...] = ()) -> DataFrame:
    """Merged statistics of coarse cells; factor 1 changes nothing."""
    if factor < 1:
        raise ValueError("the factor must be at least 1")
    if factor == 1:
        return stats
    made = [F.sum("weighted_sum").alias("weighted_sum"), F.sum("weight_sum").alias("weight_sum"), F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v")]
    return stats.groupBy(*keys, *(block_index(c, factor).alias(c) for c in BLOCK)).agg(*made, *(F.max(c).alias(c) for c in maxima))


def coarsen_grid(cells: DataFrame, factor: int, *keys: str, projected: bool = False, bounds: bool = False) -> DataFrame:
    """The geometry of a coarse grid: mean latitude, circular mean longitude, summed area."""
    made = [F.avg("lat").alias("lat"), circular_mean("lon").alias("lon"), F.sum("cell_area").alias("cell_area")]
    if projected:
        made += [F.avg("proj_x").alias("proj_x"), F.avg("proj_y").alias("proj_y")]
    if bounds:
        made += [f(c).alias(c) for c, f in (("lat_lo", F.min), ("lat_hi", F.max), ("lon_lo", F.min), ("lon_hi", F.max))]
    return cells.groupBy(*keys, *(block_index(c, factor).alias(c) for c in BLOCK)).agg(*made)


def native_index(axis: str, factor: int) -> Column:
    """Native index of a coarse cell's first cell."""
    return (F.col(axis) * factor).cast("int")


def axis_bounds(axis: DataFrame, centre: str, *keys: str) -> DataFrame:
    """Lower and upper bound of each centre of an axis: midpoints, ends mirrored, a single cell +-0.5."""
    order = Window.partitionBy(*keys).orderBy(centre) if keys else Window.orderBy(centre)
    c, before, after = F.col(centre), F.lag(centre).over(order), F.lead(centre).over(order)
    half = lambda a, b: (b - a) / 2
    low = F.coalesce(half(before, c), half(c, after), F.lit(5e-1))
    high = F.coalesce(half(c, after), half(before, c), F.lit(5e-1))
    return axis.withColumns({f"{centre}_lo": c - low, f"{centre}_hi": c + high})


def axis_edges(axis: DataFrame, centre: str, declared: tuple[str, str] | None = None) -> DataFrame:
    """The edges of an axis in order, ``position, edge``: each cell's lower bound and the last one's upper.

    Bounds that the source declares come before midpoints. The axis has one row per distinct centre.
    """
    low, high = declared or (f"{centre}_lo", f"{centre}_hi")
    cells = axis.select(centre, low, high).distinct() if declared else axis_bounds(axis.select(centre).distinct(), centre)
    order = Window.orderBy(centre)
    last = F.lead(centre).over(order).isNull()
    edges = F.when(last, F.array(low, high)).otherwise(F.array(low))
    placed = cells.select((F.row_number().over(order) - 1).alias("start"), edges.alias("edges"))
    return placed.select("start", F.posexplode("edges").alias("k", "edge")).select((F.col("start") + F.col("k")).alias("position"), "edge")


def clean_axes(cells: DataFrame, *values: str) -> DataFrame:
    """Cells of a rectilinear grid with sorted longitudes from -180 to 180 and without repeated axis values.

    Longitudes are wrapped where any is above 180. Of columns or rows with the
    same coordinate the first by index stays; ``gx`` is numbered anew, ``gy`` keeps its order.
    """
    wide = cells.agg((F.max("lon") > 180).alias("wide"))  # one row
    wrapped = cells.crossJoin(F.broadcast(wide)).withColumn("lon", F.when(F.col("wide"), display_longitude("lon")).otherwise(F.col("lon"))).drop("wide")
    lons = wrapped.groupBy("lon").agg(F.min("gx").alias("gx"))
    lats = wrapped.groupBy("lat").agg(F.min("gy").alias("gy"))
    lons = lons.withColumn("new_gx", F.row_number().over(Window.orderBy("lon")) - 1)  # one row per axis value
    lats = lats.withColumn("new_gy", F.row_number().over(Window.orderBy("gy")) - 1)
    kept = wrapped.join(lons, ["lon", "gx"]).join(lats, ["lat", "gy"])
    return kept.select(F.col("new_gy").alias("gy"), F.col("new_gx").alias("gx"), "lat", "lon", *values)


def sorted_axis_index(points: DataFrame, centre: str, name: str, descending: bool = False) -> DataFrame:
    """Position of each distinct centre on its sorted axis, from 0. The axis has one row per distinct centre."""
    axis = points.select(centre).distinct()
    order = Window.orderBy(F.desc(centre) if descending else F.asc(centre))
    return points.join(axis.withColumn(name, F.row_number().over(order) - 1), centre)


def extent(cells: DataFrame, *keys: str) -> DataFrame:
    """Smallest window [start, stop) that holds the cells."""
    made = [F.min("gy").alias("y_start"), (F.max("gy") + 1).alias("y_stop"), F.min("gx").alias("x_start"), (F.max("gx") + 1).alias("x_stop")]
    return cells.groupBy(*keys).agg(*made)


def intersect_windows(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Range join: non-empty intersections of windows of the same ``on``. ``right`` is a bucket table, of metadata size."""
    names = ("y_start", "y_stop", "x_start", "x_stop")
    other = right.select(on, *(F.col(c) for c in right.columns if c not in (*names, on)), *(F.col(c).alias(f"__{c}") for c in names))
    both = left.join(other, on).filter("y_start < __y_stop AND __y_start < y_stop AND x_start < __x_stop AND __x_start < x_stop")
    cut = {c: (F.greatest if c.endswith("start") else F.least)(c, f"__{c}") for c in names}
    return both.withColumns(cut).drop(*(f"__{c}" for c in names))


def is_periodic(cells: DataFrame) -> DataFrame:
    """One row: whether the longitudes go around the globe."""
    return cells.agg((F.max("lon_hi") - F.min("lon_lo") >= 359).alias("periodic"))


__all__ = ["STATISTICS", "auxiliary_method", "axis_bounds", "axis_edges", "clean_axes", "coarsen", "coarsen_grid", "extent", "intersect_windows", "is_periodic", "native_index", "sorted_axis_index", "spatial_product"]
