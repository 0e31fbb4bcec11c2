"""Hourly to daily to weekly means, and the choice among versions of the same hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions.calendar import week_start


def daily_mean(df: DataFrame, keys: list[str], s: str = "s", value: str = "x", shift: int = -1800) -> DataFrame:
    """Means by day of stamps moved by shift seconds: an hour's stamp is its end, so half an hour earlier by default."""
    day = F.floor((F.col(s) + F.lit(shift)) / 86400).alias("day")
    return df.groupBy(*keys, day).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def weekly_mean(df: DataFrame, keys: list[str], s: str = "s", value: str = "x", shift: int = 0) -> DataFrame:
    """Means by lattice week, with the week's start and middle in seconds."""
    week = week_start(F.col(s) + F.lit(shift)).alias("week")
    out = df.groupBy(*keys, week).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
    return out.withColumn("middle", F.col("week") + 302400)


def best_version(df: DataFrame, keys: list[str], version: str, value: str = "x") -> DataFrame:
    """Rows of the version with most values for the keys; the smaller version wins ties."""
    n = df.groupBy(*keys, version).agg(F.count(value).alias("_n"))
    best = n.groupBy(*keys).agg(F.max_by(version, F.struct("_n", (-F.col(version)).alias("v"))).alias(version))
    return df.join(best, [*keys, version])


def time_window(df: DataFrame, s: str, first: int, last: int, lead: int = 0) -> DataFrame:
    """first - lead <= s < last; a filter that reaches the scan."""
    return df.where((F.col(s) >= F.lit(first - lead)) & (F.col(s) < F.lit(last)))


def monthly_removed(df: DataFrame, other: DataFrame, month: str = "m", value: str = "x") -> DataFrame:
    """value minus the month's mean of other (month, value)."""
    mean = other.groupBy(month).agg(F.avg(value).alias("mean"))
    return df.join(mean, month).withColumn("rest", F.col(value) - F.col("mean"))


def accumulated_to_rate(df: DataFrame, lead_seconds: str, value: str = "x") -> DataFrame:
    """Weekly accumulations as rates: over 7 days, or over the lead and half a week when the lead is below 7 days."""
    span = F.when(F.col(lead_seconds) < 604800, F.col(lead_seconds) + 302400).otherwise(604800)
    return df.withColumn("rate", F.col(value) / span)


def smoothed(df: DataFrame, keys: list[str], order: str, value: str = "x", before: float = 4 / 7) -> DataFrame:
    """before * previous + (1 - before) * current; the first stays as it is."""
    previous = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("smooth", F.when(previous.isNull(), F.col(value)).otherwise(before * previous + (1 - before) * F.col(value)))
