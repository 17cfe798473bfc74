"""Calendar bins, cadences and expected timestamps (time-zone naive, UTC by convention)."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Native cadences, coarser last, and accepted aliases.
CADENCES = ("1H", "3H", "1D", "1MS", "1YS")
ALIASES = {"H": "1H", "1H": "1H", "3H": "3H", "D": "1D", "1D": "1D", "W": "1W", "1W": "1W", "7D": "1W", "M": "1MS", "MS": "1MS", "1M": "1MS", "1MS": "1MS", "Y": "1YS", "YS": "1YS", "1Y": "1YS", "1YS": "1YS"}
SECONDS = {"1H": 3600, "3H": 10800, "1D": 86400, "1W": 604800}
UNIT_OF = {"1H": "hour", "1D": "day", "1MS": "month", "1YS": "year"}
#: Pyramid units and the cadence of their labels.
TIME_UNITS = ("Source", "Hour", "Day", "Month", "Year")
UNIT_CADENCE = {"Hour": "1H", "Day": "1D", "Month": "1MS", "Year": "1YS"}


def cadence_of(name: str) -> str:
    key = name.strip().upper()
    if key not in ALIASES:
        raise ValueError(f"Unsupported time interval {name!r}")
    return ALIASES[key]


def bin_label(ts: Column | str, cadence: str) -> Column:
    """Start of the bin that holds a timestamp, as TIMESTAMP_NTZ."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    if cadence == "3H":  # bins of a day; days are aligned to the epoch
        day = F.date_trunc("day", ts)
        return (day + F.make_dt_interval(hours=(F.hour(ts) - F.hour(ts) % 3))).cast("timestamp_ntz")
    return F.date_trunc(UNIT_OF[cadence], ts).cast("timestamp_ntz")


def next_label(label: Column, cadence: str) -> Column:
    step = {"1H": "INTERVAL 1 HOUR", "3H": "INTERVAL 3 HOUR", "1D": "INTERVAL 1 DAY", "1MS": "INTERVAL 1 MONTH", "1YS": "INTERVAL 1 YEAR"}[cadence]
    return label + F.expr(step)


def expected_steps(label: Column, native: str, target: str) -> Column:
    """How many native steps the bin of ``label`` has."""
    if native == target:
        return F.lit(1).cast("long")
    if native == "1MS" and target == "1YS":
        return F.lit(12).cast("long")
    if native not in SECONDS or CADENCES.index(native) > CADENCES.index(target):
        raise ValueError(f"Cannot aggregate {native} to finer {target}")
    span = F.timestamp_diff("SECOND", label, next_label(label, target))
    return F.floor(span / F.lit(SECONDS[native])).cast("long")


def infer_cadence(times: DataFrame, ts: str = "ts", declared: str | None = None) -> str:
    """The native cadence of a time axis (one row per timestamp), as one aggregation.

    Raises if timestamps repeat, or if steps fit no supported interval.
    """
    row = cadence_facts(times, ts).first()
    if row["n"] != row["n_distinct"]:
        raise ValueError("timestamps must be strictly increasing and unique")
    if row["n"] < 2:
        if declared is None:
            raise ValueError("Could not infer a supported uniform native time interval")
        return cadence_of(declared)
    if row["least_step"] == row["most_step"]:
        for name, seconds in SECONDS.items():
            if row["least_step"] == seconds:
                return name
    if row["all_months"]:
        return "1MS"
    if row["all_years"]:
        return "1YS"
    raise ValueError("Could not infer a supported uniform native time interval")


def cadence_facts(times: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: counts, extreme steps in seconds, and whether all steps are calendar months or years.

    The axis is one row per timestamp of a dataset, not one per sample, so the
    ordered window over it is as long as the axis.
    """
    order = Window.orderBy(ts)
    steps = times.select(F.col(ts).alias("t"), F.lag(ts).over(order).alias("p"))
    first_of_month = (F.dayofmonth("t") == 1) & (F.date_trunc("day", "t").cast("timestamp_ntz") == F.col("t"))
    month = first_of_month & (F.months_between(F.col("t"), F.col("p")) == 1)
    year = first_of_month & (F.month("t") == 1) & (F.months_between(F.col("t"), F.col("p")) == 12)
    known = F.col("p").isNotNull()
    return steps.agg(
        F.count("t").alias("n"), F.count_distinct("t").alias("n_distinct"),
        F.min(F.timestamp_diff("SECOND", F.col("p"), F.col("t"))).alias("least_step"),
        F.max(F.timestamp_diff("SECOND", F.col("p"), F.col("t"))).alias("most_step"),
        F.coalesce(F.every(F.when(known, month)), F.lit(False)).alias("all_months"),
        F.coalesce(F.every(F.when(known, year)), F.lit(False)).alias("all_years"),
    )


def expected_timestamps(start: datetime, end: datetime, cadence: str) -> list[datetime]:
    """Labels from the first one at or after ``start`` up to ``end``, inclusive."""
    out: list[datetime] = []
    if cadence in ("1H", "3H", "1D"):
        step = timedelta(seconds=SECONDS[cadence])
        epoch = datetime(1970, 1, 1)
        label = epoch + step * -((epoch - start) // step)
        while label <= end:
            out.append(label)
            label += step
        return out
    if cadence not in ("1MS", "1YS"):
        raise ValueError(f"Cannot list expected timestamps of {cadence}")
    label = datetime(start.year, start.month if cadence == "1MS" else 1, 1)
    while label <= end:
        if label >= start:
            out.append(label)
        month = label.month % 12 + 1 if cadence == "1MS" else 1
        label = datetime(label.year + (cadence == "1YS" or month == 1), month, 1)
    return out


def timestamp_table(spark, start: datetime, end: datetime, cadence: str) -> DataFrame:
    """``expected_timestamps`` as a DataFrame, made by a sequence on the executors."""
    labels = expected_timestamps(start, min(end, start + timedelta(days=800)), cadence)
    if not labels or labels[0] > end:
        return spark.createDataFrame([], "ts timestamp_ntz")
    step = {"1H": "1 HOUR", "3H": "3 HOUR", "1D": "1 DAY", "1MS": "1 MONTH", "1YS": "1 YEAR"}[cadence]
    return spark.sql(f"SELECT explode(sequence(TIMESTAMP_NTZ '{labels[0]}', TIMESTAMP_NTZ '{end}', INTERVAL {step})) AS ts")
