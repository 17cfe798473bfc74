"""Calendar products: resampling with complete periods only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import CADENCES, bin_label, expected_steps
from .stats import STATISTICS, finalized, first_in_time, reducer


def resample(samples: DataFrame, cadence: str, method: str, *keys: str, value: str = "value") -> DataFrame:
    """Any reducer over calendar bins; labels are bin starts."""
    return samples.groupBy(*keys, bin_label("ts", cadence).alias("ts")).agg(reducer(method, value).alias("value"))


def complete_periods(samples: DataFrame, native: str, target: str, *groups: str) -> DataFrame:
    """Labels (per dataset in ``groups``) whose bins hold as many timestamps as they have native steps.

    This looks at a dataset's time axis, not at single cells.
    """
    label = bin_label("ts", target)
    counted = samples.groupBy(*groups, label.alias("ts")).agg(F.count_distinct("ts").alias("n_steps"))
    return counted.filter(F.col("n_steps") == expected_steps(F.col("ts"), native, target))


def temporal_product(
    stats: DataFrame, native: str, target: str, *keys: str, method: str = "mean", groups: tuple[str, ...] = (), area: str | None = "cell_area",
    maxima: tuple[str, ...] = (), firsts: tuple[str, ...] = (), complete: bool = True,
) -> DataFrame:
    """Statistics of the bins of ``target``, by ``keys``.

    Means merge; another ``method`` reduces the samples' ``value`` first and weighs the
    result by ``area``. Minimum and maximum are those of the native samples.
    ``maxima`` (source counts) and ``firsts`` (other columns) ride along. With
    ``complete`` only complete periods of ``groups`` stay.
    """
    if CADENCES.index(target) < CADENCES.index(native):
        raise ValueError(f"Cannot aggregate {native} to finer {target}")
    if target == native:
        return stats
    label = bin_label("ts", target)
    extra = [F.max(c).alias(c) for c in maxima] + [first_in_time(c).alias(c) for c in firsts]
    low_high = [F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v")]
    if method == "mean":
        out = stats.groupBy(*keys, label.alias("ts")).agg(F.sum("weighted_sum").alias("weighted_sum"), F.sum("weight_sum").alias("weight_sum"), *low_high, *extra)
    else:
        weight = [F.first(area, ignorenulls=True).alias("__area")]
        reduced = stats.groupBy(*keys, label.alias("ts")).agg(reducer(method).alias("__value"), *weight, *low_high, *extra)
        v, a = F.col("__value"), F.col("__area")
        out = reduced.withColumns({"weighted_sum": F.coalesce(v * a, F.lit(0e0)), "weight_sum": F.when(v.isNull(), 0e0).otherwise(a)}).drop("__value", "__area")
    if complete:
        out = out.join(complete_periods(stats, native, target, *groups).select(*groups, "ts"), [*groups, "ts"], "left_semi")
    return out


def drop_repeated_timestamps(samples: DataFrame, *keys: str, order: str) -> DataFrame:
    """Of rows with the same timestamp and cell, the first in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return samples.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def product_policy(native: str, combined: bool = False) -> list[tuple[str, int]]:
    """(time unit, coarseness factor) of the products that a native cadence gets."""
    wide = [("Month", 1), ("Month", 2), ("Year", 1), ("Year", 2)]
    if combined:
        return [("Day", 1), *wide]
    made = {"1H": [("Source", 1), ("Day", 1), *wide], "3H": [("Source", 1), ("Day", 1), *wide], "1D": [("Source", 1), *wide], "1MS": [("Source", 1), ("Year", 1), ("Year", 2)], "1YS": [("Source", 1)]}
    if native not in made:
        raise ValueError(f"No products are made of {native} data")
    return made[native]


__all__ = ["STATISTICS", "complete_periods", "drop_repeated_timestamps", "finalized", "product_policy", "resample", "temporal_product"]
