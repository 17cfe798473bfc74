"""What to fetch from a provider: intervals of interest, merged and split, and the request for one.

Pure planning; nothing is downloaded.
"""

from __future__ import annotations

from datetime import date
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_by_month(interests: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per month of each interest, from the month of ``start`` up to that of ``end``, which is not included."""
    first, last = F.trunc(start, "month"), F.trunc(end, "month")
    months = F.when(first < last, F.sequence(first, F.add_months(last, -1), F.expr("INTERVAL 1 MONTH")))
    split = interests.withColumn("__month", F.explode(months))
    return split.withColumns({start: F.col("__month"), end: F.add_months("__month", 1)}).drop("__month")


def merge_intervals(interests: DataFrame, *keys: str, start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping or touching intervals of the same ``keys`` as one (gaps and islands)."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = interests.withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1))
    islands = marked.withColumn("__island", F.sum("__new").over(order))
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__island")


def month_request(variable: str, start: date, end: date, box: tuple[float, float, float, float] | None = None, **more: Any) -> dict[str, Any]:
    """The years, months, days and hours that cover ``start`` to ``end``, and the area (west, east, south, north) as N, E, S, W."""
    index = range(start.year * 12 + start.month - 1, end.year * 12 + end.month)
    made = {
        "variable": variable, "year": [str(y) for y in range(start.year, end.year + 1)], "month": sorted({f"{k % 12 + 1:02d}" for k in index}),
        "day": [f"{d:02d}" for d in range(1, 32)], "time": [f"{h:02d}" for h in range(24)], "data_format": "netcdf",
    }
    if box:
        west, east, south, north = box
        made["area"] = [north, east, south, west]
    return made | more
