"""Blending sources: daily coverage, regridding and the weighted mean."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import bin_label
from ..functions.geo import Lambert

#: Samples of a full day.
DAILY_SAMPLES = {"1H": 24, "3H": 8, "1D": 1}


def required_samples(native: str, minimum: float) -> int:
    if not 0 < minimum <= 1:
        raise ValueError("minimum daily coverage must be in (0, 1]")
    if native not in DAILY_SAMPLES:
        raise ValueError(f"no daily coverage is defined for {native}")
    return math.ceil(DAILY_SAMPLES[native] * minimum)


def daily_mean_with_coverage(samples: DataFrame, required: int, *keys: str) -> DataFrame:
    """A cell's mean of a day, NULL where fewer than ``required`` samples are valid."""
    n = F.count("value")
    return samples.groupBy(*keys, bin_label("ts", "1D").alias("ts")).agg(F.when(n >= required, F.avg("value")).alias("value"), n.alias("n_valid"))


def weighted_mean(samples: DataFrame, *keys: str, weight: Column | float = 1.0) -> DataFrame:
    """Mean over sources by plain weights (no areas), and how many sources had a value."""
    v, w = F.col("value"), weight if isinstance(weight, Column) else F.lit(float(weight))
    total = F.sum(F.when(v.isNotNull(), w))
    return samples.groupBy(*keys).agg(F.when(total > 0, F.sum(v * w) / total).alias("value"), F.count(v).cast("smallint").alias("source_count"))


def source_weight(weights: dict[str, float], default: float = 1.0, key: str = "dataset") -> Column:
    """Weight of each row's source by name."""
    if any(not (math.isfinite(x) and x > 0) for x in (*weights.values(), default)):
        raise ValueError("weights must be finite and above 0")
    out = F.lit(float(default))
    for name, x in weights.items():
        out = F.when(F.col(key) == name, F.lit(float(x))).otherwise(out)
    return out


def pair_mean(left: DataFrame, right: DataFrame, *keys: str, exact: bool = True) -> DataFrame:
    """Mean of two datasets: where both have values (``exact``), or of whatever there is."""
    both = left.unionByName(right).filter("value IS NOT NULL").groupBy(*keys).agg(F.avg("value").alias("value"), F.count("value").alias("n"))
    return (both.filter("n = 2") if exact else both).drop("n")


def pair_difference(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """Difference of two datasets where both have values."""
    a, b = left.select(*keys, F.col("value").alias("__a")), right.select(*keys, F.col("value").alias("__b"))
    return a.join(b, list(keys)).select(*keys, (F.col("__a") - F.col("__b")).alias("value"))


def bracket(targets: DataFrame, axis: DataFrame, target: str, centre: str, index: str, period: float | None = None) -> DataFrame:
    """For each target coordinate the two source rows around it and their weights.

    Columns: ``target``, ``index`` and ``w_<index>``. An axis has as many rows as
    the grid has rows or columns, so this range join is one-dimensional and small.
    A periodic axis goes on with its first centre one period later; places
    outside the axis get no row.
    """
    if period is not None:
        first = axis.orderBy(centre).limit(1)
        axis = axis.unionByName(first.withColumn(centre, F.col(centre) + period))
    order = Window.orderBy(centre)
    spans = axis.select(F.col(index).alias("__i0"), F.col(centre).alias("__c0"), F.lead(index).over(order).alias("__i1"), F.lead(centre).over(order).alias("__c1"))
    spans = spans.filter("__c1 IS NOT NULL")
    t = F.col("__t")
    at = F.pmod(F.col(target) - axis.agg(F.min(centre)).first()[0], F.lit(period)) + axis.agg(F.min(centre)).first()[0] if period is not None else F.col(target)
    last = axis.agg(F.max(centre)).first()[0]
    inside = (t >= F.col("__c0")) & ((t < F.col("__c1")) | ((t == F.lit(last)) & (F.col("__c1") == F.lit(last))))
    found = targets.withColumn("__t", at).join(spans, inside)
    f = (t - F.col("__c0")) / (F.col("__c1") - F.col("__c0"))
    ends = F.array(F.struct(F.col("__i0").alias("i"), (1 - f).alias("w")), F.struct(F.col("__i1").alias("i"), f.alias("w")))
    return found.select(*targets.columns, F.explode(ends).alias("e")).select(*targets.columns, F.col("e.i").alias(index), F.col("e.w").alias(f"w_{index}")).filter(F.col(f"w_{index}") > 0)


def bilinear_weights(source_lat: DataFrame, source_lon: DataFrame, target_cells: DataFrame, periodic: bool = False) -> DataFrame:
    """``dst_gy, dst_gx, src_gy, src_gx, w`` for rectilinear grids: axes are bracketed one by one, cells take both.

    Axes: ``gy, lat`` and ``gx, lon``; cells: ``gy, gx, lat, lon``. At most four rows per target cell.
    """
    cells = target_cells.select(F.col("gy").alias("dst_gy"), F.col("gx").alias("dst_gx"), F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon"))
    rows = bracket(cells.select("dst_gy", "t_lat").distinct(), source_lat.select(F.col("gy").alias("src_gy"), "lat"), "t_lat", "lat", "src_gy")
    cols = bracket(cells.select("dst_gx", "t_lon").distinct(), source_lon.select(F.col("gx").alias("src_gx"), "lon"), "t_lon", "lon", "src_gx", 360e0 if periodic else None)
    placed = cells.select("dst_gy", "dst_gx").join(rows, "dst_gy").join(cols, "dst_gx")
    return placed.select("dst_gy", "dst_gx", "src_gy", "src_gx", (F.col("w_src_gy") * F.col("w_src_gx")).alias("w"))


def projected_weights(projection: Lambert, x_axis: tuple[float, float, int], y_axis: tuple[float, float, int], target_cells: DataFrame) -> DataFrame:
    """``dst_gy, dst_gx, src_gy, src_gx, w`` from a regular projected grid onto cells (``gy, gx, lat, lon``), bilinear in the plane.

    An axis is its first place, its step (which may be negative) and its number of places. The cell of the source grid that
    holds a target follows by arithmetic, so there is no join; targets outside the grid get no row.
    """
    x, y = projection.forward("lat", "lon")
    at = lambda place, axis: (place - F.lit(float(axis[0]))) / F.lit(float(axis[1]))
    cells = target_cells.select(F.col("gy").alias("dst_gy"), F.col("gx").alias("dst_gx"), at(x, x_axis).alias("fx"), at(y, y_axis).alias("fy"))
    cells = cells.filter(F.col("fx").between(0, x_axis[2] - 1) & F.col("fy").between(0, y_axis[2] - 1))
    ends = lambda f: F.array(
        F.struct(F.floor(f).cast("int").alias("i"), (1 - (F.col(f) - F.floor(f))).alias("w")), F.struct((F.floor(f) + 1).cast("int").alias("i"), (F.col(f) - F.floor(f)).alias("w"))
    )
    rows = cells.withColumn("ey", F.explode(ends("fy"))).withColumn("ex", F.explode(ends("fx"))).withColumn("w", F.col("ey.w") * F.col("ex.w"))
    return rows.filter("w > 0").select("dst_gy", "dst_gx", F.col("ey.i").alias("src_gy"), F.col("ex.i").alias("src_gx"), "w")


def apply_weights(values: DataFrame, weights: DataFrame, *keys: str) -> DataFrame:
    """Regrid: weighted mean of each target cell's valid contributors; NULL without one."""
    v, w = F.col("value"), F.col("w")
    joined = values.select(*keys, F.col("gy").alias("src_gy"), F.col("gx").alias("src_gx"), "value").join(weights, ["src_gy", "src_gx"])
    total = F.sum(F.when(v.isNotNull(), w))
    return joined.groupBy(*keys, F.col("dst_gy").alias("gy"), F.col("dst_gx").alias("gx")).agg(F.when(total > 0, F.sum(v * w) / total).alias("value"))
