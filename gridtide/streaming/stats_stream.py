"""Structured Streaming: the same mergeable statistics over event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stats import expand


def windowed_statistics(samples: DataFrame, window: str = "1 day", delay: str = "2 hours", *keys: str, area: str | None = "cell_area") -> DataFrame:
    """Statistics per window and cell. In append mode a window is emitted once, when the watermark has passed it.

    ``samples``: a stream of ``ts, gy, gx, value`` and the area (or ``lat``), ``ts`` a timestamp.
    Later samples than ``delay`` are dropped, as a closed period's are.
    """
    stats = expand(samples.withWatermark("ts", delay), area=area)
    made = [F.sum("weighted_sum").alias("weighted_sum"), F.sum("weight_sum").alias("weight_sum"), F.min("min_v").alias("min_v"), F.max("max_v").alias("max_v"), F.count("value").alias("n")]
    return stats.groupBy(F.window("ts", window).alias("w"), *(keys or ("gy", "gx"))).agg(*made).select(F.col("w.start").alias("ts"), *(keys or ("gy", "gx")), "weighted_sum", "weight_sum", "min_v", "max_v", "n")


def read_samples(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def write_statistics(stats: DataFrame, path: str, checkpoint: str):
    """Append closed windows to a Parquet folder, exactly once."""
    return stats.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
