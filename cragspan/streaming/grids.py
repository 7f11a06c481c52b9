"""Grid aggregates of a point stream by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cragspan.operators.cloud import cell


def windowed_density(points: DataFrame, size: float, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Points, least and greatest z of each XY cell and time window; points later than ``late`` are left out of a stream."""
    kept = points.withWatermark("ts", late) if points.isStreaming else points
    found = kept.groupBy(F.window("ts", window).alias("w"), cell("x", size).alias("ci"), cell("y", size).alias("cj")).agg(F.count("*").alias("points"), F.min("z").alias("low"), F.max("z").alias("high"))
    return found.select(F.col("w.start").alias("start"), "ci", "cj", "points", "low", "high")
