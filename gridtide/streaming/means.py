"""The resampling means as streams: watermarked windows on the same lattices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly(stream: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", late: str = "14 days") -> DataFrame:
    """Means by lattice week; the window's offset puts its edges on 1992-01-01 and every seventh day."""
    out = stream.withWatermark(ts, late).groupBy(*keys, F.window(ts, "7 days", "7 days", "6 days"))
    return out.agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(*keys, F.col("window.start").alias("week"), "mean", "n")


def daily(stream: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", late: str = "2 days") -> DataFrame:
    """Means by day of stamps half an hour earlier."""
    moved = stream.withColumn("_ts", F.col(ts) - F.expr("interval 30 minutes")).withWatermark("_ts", late)
    out = moved.groupBy(*keys, F.window("_ts", "1 day"))
    return out.agg(F.avg(value).alias("mean"), F.count(value).alias("n")).select(*keys, F.col("window.start").alias("day"), "mean", "n")
