"""Lagged convolution of sensitivities with forcing anomalies, and what is read off its result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def convolved(forcing: DataFrame, sens: DataFrame, on: list[str], time: str = "m", lag: str = "lag", value: str = "anom", weight: str = "w") -> DataFrame:
    """A row for each forcing value and lag: impact = weight * value at time + lag."""
    return forcing.join(sens, on).withColumn("impact", F.col(weight) * F.col(value)).withColumn(time, F.col(time) + F.col(lag))


def by_cell(impact: DataFrame, members: DataFrame | None, on: list[str], keys: list[str]) -> DataFrame:
    """Sums over the members of each cell; without members every point is its own cell and only sums are taken."""
    rows = impact if members is None else impact.join(members, on)
    return rows.groupBy(*keys).agg(F.sum("impact").alias("impact"))


def marginals(impact: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Totals by a, by b, and overall, within keys, in one pass."""
    sets = [[*keys, a], [*keys, b], keys]
    out = impact.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dict.fromkeys([*keys, a, b])])
    return out.agg(F.sum("impact").alias("impact"), F.grouping_id().alias("_g")).drop("_g")


def cumulative(df: DataFrame, keys: list[str], order: str, value: str = "impact", poison: bool = False) -> DataFrame:
    """Running sums along order; with poison a missing value makes all later sums missing."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(value).over(w)
    if poison:
        total = F.when(F.max(F.col(value).isNull().cast("int")).over(w) == 0, total)
    return df.withColumn("cum", total)


def before_and_after(df: DataFrame, keys: list[str], order: str, pre: str, post: str) -> DataFrame:
    """Running sum of pre up to each step plus the sum of post over the steps after it."""
    up, down = Window.partitionBy(*keys).orderBy(order), Window.partitionBy(*keys).orderBy(F.desc(order))
    ahead = F.sum(post).over(down.rowsBetween(Window.unboundedPreceding, -1))  # both frames only ever grow
    return df.withColumn("cum", F.sum(pre).over(up.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(ahead, F.lit(0.0)))


def accumulated_after(df: DataFrame, keys: list[str], order: str, start: str, value: str, within: float = 2.0) -> DataFrame:
    """df with ``after``: a step's value plus those of all later steps of the same forecast.

    Steps belong to one forecast if their starts (in days) are close: in order of starts a new forecast begins where the
    next start is ``within`` days or more later. Steps without a start have no sum; missing values count as nothing.
    """
    by = Window.partitionBy(*keys).orderBy(start)
    new = (F.col(start) - F.lag(start).over(by) >= within).cast("int")
    rows = df.withColumn("_forecast", F.when(F.col(start).isNotNull(), F.sum(F.coalesce(new, F.lit(0))).over(by.rowsBetween(Window.unboundedPreceding, 0))))
    later = Window.partitionBy(*keys, "_forecast").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("after", F.when(F.col("_forecast").isNotNull(), F.coalesce(F.sum(value).over(later), F.lit(0.0)))).drop("_forecast")


def last_filled(df: DataFrame, keys: list[str], order: str, value: str = "cum") -> DataFrame:
    """df whose last step, where it has no value, has that of the step before it."""
    w = Window.partitionBy(*keys).orderBy(order)
    last = F.lead(F.lit(1)).over(w).isNull()
    return df.withColumn(value, F.when(last, F.coalesce(F.col(value), F.lag(value).over(w))).otherwise(F.col(value)))


def blended(pre: Column, post: Column, forced: Column, init: Column) -> Column:
    """post where the forcing is after the start of the forecast, else pre."""
    return F.when(forced > init, post).otherwise(pre)


def tapered(long: DataFrame, short: DataFrame, keys: list[str], step: str, width: int, value: str = "w") -> DataFrame:
    """long blended into short over its first width steps with weights (n + 1/2) / width; short alone after that."""
    a = long.select(*keys, step, F.col(value).alias("_long"))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(step)) - 1
    w = F.least(F.lit(1.0), (n + 0.5) / width)
    return short.join(a, [*keys, step], "left").withColumn(value, w * F.col(value) + (1 - w) * F.coalesce("_long", F.col(value))).drop("_long")


def prepended(long: DataFrame, short: DataFrame, long_times: DataFrame, short_times: DataFrame, keys: list[str], step: str, at: str, width: int, value: str = "w", margin: float = 3.0) -> DataFrame:
    """The steps of long that begin earlier, then those of short, their first ``width`` ones blended with long's.

    long and short (keys, step, value) have steps from 0. Their times (keys, step, year, at in days) tell how many steps of
    long come before short: those of which the time is more than ``margin`` days before that of short's first step,
    counted year by year and averaged, half to even. Steps are numbered anew from 0; weights of short are (n + 1/2) / width.
    """
    first = short_times.where(F.col(step) == 0).select(*keys, "year", F.col(at).alias("_first"))
    early = (F.col(at) - F.col("_first") < -margin).cast("int")
    count = long_times.join(first, [*keys, "year"]).groupBy(*keys, "year").agg(F.sum(early).alias("_n")).groupBy(*keys).agg(F.rint(F.avg("_n")).cast("int").alias("_n"))
    front = long.join(count, keys).where(F.col(step) < F.col("_n")).select(*keys, step, F.col(value).alias(value))
    rows = short.select(*keys, step, F.col(value).alias("_short")).join(count, keys).withColumn("_at", F.col(step) + F.col("_n"))
    rows = rows.join(long.select(*keys, F.col(step).alias("_at"), F.col(value).alias("_long")), [*keys, "_at"], "left")
    share = (F.col(step) + 0.5) / width
    mixed = F.when(F.col(step) < width, (1 - share) * F.coalesce("_long", "_short") + share * F.col("_short")).otherwise(F.col("_short"))
    return front.unionByName(rows.select(*keys, F.col("_at").alias(step), mixed.alias(value)))


def added(df: DataFrame, more: DataFrame, on: list[str], value: str = "impact") -> DataFrame:
    """Sum of two components where either is present."""
    b = more.select(*on, F.col(value).alias("_more"))
    out = df.select(*on, value).join(b, on, "full")
    return out.withColumn(value, F.coalesce(value, F.lit(0.0)) + F.coalesce("_more", F.lit(0.0))).drop("_more")


def difference(a: DataFrame, b: DataFrame, on: list[str], value: str = "x") -> DataFrame:
    """a - b where both have a row."""
    return a.select(*on, F.col(value).alias("_a")).join(b.select(*on, F.col(value).alias("_b")), on).select(*on, (F.col("_a") - F.col("_b")).alias("diff"))


def by_lead(impact: DataFrame, leads: DataFrame, keys: list[str], lag: str = "lag") -> DataFrame:
    """For each lead the sum over lags of at least that lead, and the smallest lag in it.

    leads (lead) has as many rows as there are leads, which are no more than lags.
    """
    rows = impact.groupBy(*keys, lag).agg(F.sum("impact").alias("impact"))
    w = Window.partitionBy(*keys).orderBy(F.desc(lag)).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumn("cum", F.sum("impact").over(w)).withColumnRenamed(lag, "_at")
    first = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(lag)).alias("_lags"))  # at most as many as there are lags
    asked = leads.agg(F.collect_set(F.col("lead").cast("long")).alias("_leads"))  # one row
    picks = first.crossJoin(F.broadcast(asked)).withColumn("lead", F.explode("_leads")).drop("_leads")
    picks = picks.withColumn("_at", F.get(F.filter("_lags", lambda x: x >= F.col("lead")), F.lit(0))).where(F.col("_at").isNotNull())
    return picks.join(sums, [*keys, "_at"]).select(*keys, "lead", F.col("_at").alias("first_lag"), F.col("cum").alias("predicted"))


def overridden(base: DataFrame, more: DataFrame, on: list[str], value: str = "x", only: Column | None = None) -> DataFrame:
    """base with the values of more where it has them (and ``only`` holds)."""
    out = base.join(more.select(*on, F.col(value).alias("_more")), on, "left")
    new = F.col("_more") if only is None else F.when(only, F.col("_more"))
    return out.withColumn(value, F.coalesce(new, F.col(value))).drop("_more")
