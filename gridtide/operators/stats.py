"""Mergeable statistics and the five query functions.

Every sample and every product cell carries ``weighted_sum, weight_sum, min_v,
max_v``. Any grouping merges them the same way, so a query over months or
coarse cells is a partial aggregation carried on, never a mean of means.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import fallback_area
from ..model import AGGREGATIONS, PREDICATES, Region

STATISTICS = ("weighted_sum", "weight_sum", "min_v", "max_v")


def missing_to_null(value: Column | str) -> Column:
    """NaN means missing; inside DataFrames missing is NULL only."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(value), value)


def expand(samples: DataFrame, value: str = "value", area: str | None = "cell_area", lat: str = "lat") -> DataFrame:
    """Statistics of single samples; without an area the weight is cos(latitude)."""
    v = F.col(value)
    a = F.col(area) if area else fallback_area(F.col(lat))
    return samples.withColumns({"weighted_sum": F.coalesce(v * a, F.lit(0e0)), "weight_sum": F.when(v.isNull(), 0e0).otherwise(a), "min_v": v, "max_v": v})


def merge(stats: DataFrame, *keys: str | Column, where: Column | None = None) -> DataFrame:
    """Merge statistics by ``keys``; cells outside ``where`` count as missing, not as zero."""
    of = lambda c: F.when(where, F.col(c)) if where is not None else F.col(c)
    zero = lambda c: F.coalesce(F.sum(of(c)), F.lit(0e0)).alias(c)
    return stats.groupBy(*keys).agg(zero("weighted_sum"), zero("weight_sum"), F.min(of("min_v")).alias("min_v"), F.max(of("max_v")).alias("max_v"))


def finalized(aggregation: str) -> Column:
    if aggregation == "mean":
        return F.when(F.col("weight_sum") > 0, F.col("weighted_sum") / F.col("weight_sum"))
    if aggregation in AGGREGATIONS:
        return F.col(f"{aggregation}_v")
    raise ValueError(f"Unsupported aggregation {aggregation!r}")


def region_mask(region: Region, lat: str = "lat", lon: str = "lon") -> Column:
    """Cell centres inside the box, bounds included."""
    inside = F.col(lat).between(region.south, region.north)
    if region.west < region.east:
        return inside & F.col(lon).between(region.west, region.east)
    if region.west > region.east:
        return inside & ((F.col(lon) >= region.west) | (F.col(lon) <= region.east))
    return inside


def matches(predicate: str, value: float, column: str = "value") -> Column:
    """Whether a value fulfils a predicate; a missing value never does, for ``ne`` neither."""
    name, v, k = PREDICATES[predicate], F.col(column), F.lit(float(value))
    test = {"lt": v < k, "le": v <= k, "eq": v == k, "ne": v != k, "ge": v >= k, "gt": v > k}[name]
    return F.coalesce(test, F.lit(False))


def get_data(stats: DataFrame, aggregation: str, *keep: str) -> DataFrame:
    return stats.select(*keep, finalized(aggregation).alias("value"))


def timeseries(stats: DataFrame, aggregation: str, *groups: str, region: Region | None = None, dense: bool = False) -> DataFrame:
    """A value per timestamp. ``dense`` keeps timestamps that have no valid cell in the region, with a NULL value."""
    where = region_mask(region) if region else None
    if where is not None and not dense:
        stats, where = stats.filter(where), None
    return merge(stats, *groups, "ts", where=where).select(*groups, "ts", finalized(aggregation).alias("value"))


def heatmap(stats: DataFrame, aggregation: str, *groups: str, region: Region | None = None) -> DataFrame:
    """A value per cell."""
    if region:
        stats = stats.filter(region_mask(region))
    return merge(stats, *groups, "gy", "gx").select(*groups, "gy", "gx", finalized(aggregation).alias("value"))


def find(result: DataFrame, predicate: str, value: float, only_matches: bool = False) -> DataFrame:
    """``find-time`` of a time series and ``find-area`` of a heat map: everything, marked by ``matches``."""
    marked = result.withColumn("matches", matches(predicate, value))
    return marked.filter("matches") if only_matches else marked


def first_in_time(value: str, ts: str = "ts") -> Column:
    """Aggregate: the earliest value that isn't missing."""
    return F.min_by(F.when(F.col(value).isNotNull(), F.col(value)), F.when(F.col(value).isNotNull(), F.col(ts)))


def reducer(name: str, value: str = "value") -> Column:
    """Aggregate by a configured reducer name."""
    made = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "median": F.median, "std": F.stddev_pop}
    if name == "first":
        return first_in_time(value)
    if name not in made:
        raise ValueError(f"Unsupported reducer {name!r}")
    return made[name](value)
