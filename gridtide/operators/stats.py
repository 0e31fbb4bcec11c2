"""Masked statistics of long-format series: means, variances, trends, variance explained."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions.nulls import not_tiny


def masked_mean(df: DataFrame, keys: list[str], value: str = "x", zero_is_missing: bool = False) -> DataFrame:
    v = F.when(F.col(value) != 0, F.col(value)) if zero_is_missing else F.col(value)
    return df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.count(v).alias("n"))


def variance(df: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    return df.groupBy(*keys).agg(F.var_pop(value).alias("variance"))


def mean_square(df: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """The variance about zero."""
    return df.groupBy(*keys).agg(F.avg(F.col(value) * F.col(value)).alias("mean_square"))


def anomaly(df: DataFrame, keys: list[str], value: str = "x", out: str = "anom") -> DataFrame:
    """value minus its mean over the rows of its keys."""
    return df.withColumn(out, F.col(value) - F.avg(value).over(Window.partitionBy(*keys)))


def trend(df: DataFrame, keys: list[str], at: str, value: str = "x", delta: float = 1.0) -> DataFrame:
    """Least-squares slope for each delta of at, the intercept, and the number of values."""
    return df.groupBy(*keys).agg((F.regr_slope(value, at) / delta).alias("slope"), F.regr_intercept(value, at).alias("intercept"), F.count(value).alias("n"))


def detrended(df: DataFrame, keys: list[str], at: str, value: str = "x", out: str = "resid", keep_mean: bool = False) -> DataFrame:
    """value minus its trend line within keys; a series of one value keeps a trend of zero."""
    w = Window.partitionBy(*keys)
    t = F.when(F.col(value).isNotNull(), F.col(at).cast("double"))
    mean_t, mean_x = F.avg(t).over(w), F.avg(value).over(w)
    parts = df.withColumns({"_dt": t - mean_t, "_dx": F.col(value) - mean_x, "_mean": mean_x})
    slope = F.coalesce(F.try_divide(F.sum(F.col("_dt") * F.col("_dx")).over(w), F.sum(F.col("_dt") * F.col("_dt")).over(w)), F.lit(0.0))
    parts = parts.withColumn("_line", slope * F.col("_dt") + (F.lit(0.0) if keep_mean else F.col("_mean")))
    return parts.withColumn(out, F.col(value) - F.col("_line")).drop("_dt", "_dx", "_mean", "_line")


def variance_explained(df: DataFrame, keys: list[str], base: str, part: str) -> DataFrame:
    """1 - var(base - part) / var(base) over rows that have both."""
    both = df.where(F.col(base).isNotNull() & F.col(part).isNotNull())
    return both.groupBy(*keys).agg((1 - F.try_divide(F.var_pop(F.col(base) - F.col(part)), F.var_pop(base))).alias("varexp"), F.count("*").alias("n"))


def pooled(df: DataFrame, keys: list[str], within: list[str], base: str, part: str) -> DataFrame:
    """Variance explained over groups ``within`` pooled: residual and base variance weighted by their numbers."""
    both = df.where(F.col(base).isNotNull() & F.col(part).isNotNull())
    each = both.groupBy(*keys, *within).agg(F.count("*").alias("n"), F.var_pop(F.col(base) - F.col(part)).alias("r"), F.var_pop(base).alias("v"))
    return each.groupBy(*keys).agg((1 - F.try_divide(F.sum(F.col("n") * F.col("r")), F.sum(F.col("n") * F.col("v")))).alias("varexp"), F.sum("n").alias("n"))


def weighted_mean(df: DataFrame, keys: list[str], weight: str, value: str = "x", over_all: bool = False) -> DataFrame:
    """Mean by weight; over_all also counts the weight of rows without a value."""
    w = F.col(weight) if over_all else F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col(weight) * F.col(value)), F.sum(w)).alias("mean"))


def relative_to(df: DataFrame, mean: DataFrame, on: list[str], value: str = "x") -> DataFrame:
    """value minus the mean of the same time."""
    return df.join(mean, on).withColumn("rel", F.col(value) - F.col("mean"))


def abs_limit(df: DataFrame, keys: list[str], share: float, value: str = "x") -> DataFrame:
    """The order statistic of |value| at rank ceil(share * n)."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.expr(f"percentile_disc({share}) within group (order by abs({value}))").alias("limit"))


def enough(df: DataFrame, keys: list[str], least: int, value: str = "x") -> DataFrame:
    """Means of groups with at least ``least`` values."""
    return masked_mean(df, keys, value).where(F.col("n") >= least)


def valid_share(df: DataFrame, keys: list[str], least: float, value: str = "x") -> DataFrame:
    """Groups whose share of values is above least."""
    share = df.groupBy(*keys).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("share"))
    return share.where(F.col("share") > least)


def tiny_masked_mean(df: DataFrame, keys: list[str], value: str = "x", relative: float = 1e-10) -> DataFrame:
    return masked_mean(df.withColumn(value, not_tiny(F.col(value), relative, keys)), keys, value)


def rebased(df: DataFrame, keys: list[str], at: str, start, end, value: str = "x") -> DataFrame:
    """value minus its mean over start <= at < end."""
    inside = F.when((F.col(at) >= start) & (F.col(at) < end), F.col(value))
    return df.withColumn("rebased", F.col(value) - F.avg(inside).over(Window.partitionBy(*keys)))


def endpoint_change(df: DataFrame, keys: list[str], at: str, start, end, value: str = "x") -> DataFrame:
    pick = lambda t: F.max(F.when(F.col(at) == t, F.col(value)))
    return df.groupBy(*keys).agg((pick(end) - pick(start)).alias("change"))


def spliced(early: DataFrame, late: DataFrame, at: str, start, end, value: str = "x") -> DataFrame:
    """early up to start, moved to the mean of late over start <= at < end, followed by late."""
    inside = (F.col(at) >= start) & (F.col(at) < end)
    means = early.where(inside).agg(F.avg(value).alias("_e")).crossJoin(late.where(inside).agg(F.avg(value).alias("_l")))  # one row
    before = early.where(F.col(at) < start).crossJoin(F.broadcast(means)).select(at, (F.col(value) - F.col("_e") + F.col("_l")).alias(value))
    return before.unionByName(late.where(F.col(at) >= start).select(at, value))
