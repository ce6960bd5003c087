"""Histograms that grow with a stream: counts and sums add up, so late and new rows only change their bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import bin_last_closed


def growing_histogram(rows: DataFrame, value: str, low: float, high: float, n: int, keys: list[str] = ()) -> DataFrame:
    """Counts and sums per bin; works on a stream (output mode update or complete) as on a table."""
    return rows.withColumn("bin", bin_last_closed(F.col(value), low, high, n)).filter("bin IS NOT NULL").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("count"), F.sum(value).alias("total"))


def hourly(rows: DataFrame, time: str, value: str, keys: list[str] = (), late: str = "1 hour") -> DataFrame:
    """Counts and means of hour windows; rows later than `late` behind the newest are left out of a stream."""
    return rows.withWatermark(time, late).groupBy(F.window(time, "1 hour"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("window.start").alias("hour"), *keys, "n", "mean")
