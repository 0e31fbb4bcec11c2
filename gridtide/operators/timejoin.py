"""Joins on time: tolerance, nearest, month, leads. Ranges are equi-joins on buckets, never nested loops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, tolerance: float) -> DataFrame:
    """All pairs with |a - b| < tolerance, with their difference ``delta`` = b - a."""
    cell = lambda c: F.floor(F.col(c) / F.lit(tolerance))
    l_ = left.withColumn("_cell", F.explode(F.array(cell(a) - 1, cell(a), cell(a) + 1)))
    r_ = right.withColumn("_cell", cell(b))
    out = l_.join(r_, [*on, "_cell"]).withColumn("delta", F.col(b) - F.col(a))
    return out.where(F.abs("delta") < tolerance).drop("_cell")


def unique_within(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, tolerance: float, left_id: list[str]) -> DataFrame:
    """Pairs of rows of left that have exactly one partner within the tolerance."""
    n = F.count("*").over(Window.partitionBy(*left_id))
    return within(left, right, on, a, b, tolerance).withColumn("_n", n).where("_n = 1").drop("_n")


#: Rows in a range of time, where a width has to be found.
RANGE_ROWS = 1_000_000


def range_width(df: DataFrame, at: str) -> float:
    """Width of ranges of ``at`` with about :data:`RANGE_ROWS` rows each, were they evenly spread."""
    lo, hi, n = df.agg(F.min(F.col(at).cast("double")), F.max(F.col(at).cast("double")), F.count("*")).first()
    return max((hi - lo) / max(1, n // RANGE_ROWS), 1e-9) * (1 + 1e-9) if n else 1.0


def neighbours(df: DataFrame, keys: list[str], at: str, known: Column, carried: list[str], width: float | None = None) -> DataFrame:
    """df with ``_before`` and ``_after``: (t, carried) of the last row at or before each row's ``at`` and of the first
    at or after it for which ``known`` holds; of rows at one time that with the smallest carried values.

    Two running minima over one partitioning; their frames only ever grow. With ``width`` time is dealt to ranges, and
    the edges of each range, one row a key and range, are carried to the ranges after and before it: no task then holds
    more than a range of a key.
    """
    t = F.col(at).cast("double")
    tail = [F.col(c) for c in carried]
    known = known & t.isNotNull()
    last = F.when(known, F.struct((-t).alias("t"), *tail))  # the smallest is the latest
    first = F.when(known, F.struct(t.alias("t"), *tail))
    grow = (Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("_range", F.coalesce(F.floor(t / F.lit(width)), F.lit(0).cast("long")) if width else F.lit(0).cast("long"))
    w = Window.partitionBy(*keys, "_range")
    rows = rows.withColumns({"_when": t, "_last": last, "_first": first})
    rows = rows.withColumns({"_before": F.min("_last").over(w.orderBy("_when").rangeBetween(*grow)), "_after": F.min("_first").over(w.orderBy(F.desc("_when")).rangeBetween(*grow))})
    if width:
        edges = rows.groupBy(*keys, "_range").agg(F.min("_last").alias("_ended"), F.min("_first").alias("_begun"))
        k, gone = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0)), (Window.unboundedPreceding, -1)
        edges = edges.select(*keys, "_range", F.last("_ended", True).over(k.orderBy("_range").rowsBetween(*gone)).alias("_ended"), F.last("_begun", True).over(k.orderBy(F.desc("_range")).rowsBetween(*gone)).alias("_begun"))
        rows = rows.join(edges, [*keys, "_range"]).withColumns({"_before": F.coalesce("_before", "_ended"), "_after": F.coalesce("_after", "_begun")}).drop("_ended", "_begun")
    back = F.when(F.col("_before").isNotNull(), F.struct((-F.col("_before.t")).alias("t"), *[F.col(f"_before.{c}") for c in carried]))
    return rows.withColumn("_before", back).drop("_range", "_when", "_last", "_first")


def nearest(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str, left_id: list[str], right_id: str, tolerance: float | None = None, width: float | None = None) -> DataFrame:
    """For each row of left the right_id and b that are nearest in time; the earlier one wins ties, then the smaller id.

    The union of both sides is looked through in order of time, forward and backward; no pairs are built. ``width``
    deals the time of a hot key to ranges; without keys it is found from the rows if it is not given.
    """
    lcols = [c for c in left.columns if c not in on]
    l_ = left.select(*on, F.col(a).cast("double").alias("_at"), F.struct(*lcols).alias("_l"), F.lit(None).cast(dict(right.dtypes)[right_id]).alias("_id"))
    r_ = right.where(F.col(b).isNotNull()).select(*on, F.col(b).cast("double").alias("_at"), F.lit(None).cast(l_.schema["_l"].dataType).alias("_l"), F.col(right_id).alias("_id"))
    both = l_.unionByName(r_)
    width = width or (None if on else range_width(both, "_at"))
    both = neighbours(both, on, "_at", F.col("_l").isNull(), ["_id"], width).where("_l is not null")
    pick = F.when(F.col("_before").isNull() | (F.col("_after.t") - F.col("_at") < F.col("_at") - F.col("_before.t")), F.col("_after")).otherwise(F.col("_before"))
    out = both.withColumn("_p", pick).select(*on, "_l.*", F.col("_p._id").alias(right_id), F.col("_p.t").alias(b))
    return out if tolerance is None else out.where(F.abs(F.col(b) - F.col(a)) < tolerance)


def drop_repeats(df: DataFrame, keys: list[str], order: str, at: str, tolerance: float) -> DataFrame:
    """Rows whose next row does not match about the same time: the last of a run wins."""
    following = F.lead(at).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_next", following).where(F.col("_next").isNull() | (F.abs(F.col("_next") - F.col(at)) >= tolerance)).drop("_next")


def any_in_window(df: DataFrame, keys: list[str], inside: Column) -> DataFrame:
    """All rows of the keys that have a row inside."""
    return df.join(df.where(inside).select(*keys).distinct(), keys, "left_semi")


def lead_numbers(df: DataFrame, keys: list[str], lead: str, spacing: str) -> DataFrame:
    """lead_num = round((lead - least) / spacing) + floor(least / spacing), least being that of the keys."""
    least = F.min(lead).over(Window.partitionBy(*keys))
    return df.withColumn("lead_num", (F.rint((F.col(lead) - least) / F.col(spacing)) + F.floor(least / F.col(spacing))).cast("long"))


def spacing(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Mean distance of the distinct values of at."""
    d = df.select(*keys, at).distinct()
    return d.groupBy(*keys).agg(F.try_divide((F.max(at) - F.min(at)).cast("double"), F.count("*") - 1).alias("spacing"))


def latest_before(df: DataFrame, keys: list[str], init: str, limit: str) -> DataFrame:
    """The largest init that is not after the limit."""
    return df.groupBy(*keys).agg(F.max(F.when(F.col(init) <= F.col(limit), F.col(init))).alias("latest"))


def lattice(start: int, end: int, step: int, spark, name: str = "s") -> DataFrame:
    """Evenly spaced times start, start + step, ... up to end."""
    return spark.range(start, end + 1, step).withColumnRenamed("id", name)


def snapped(df: DataFrame, at: Column, origin: float, step: float, out: str) -> DataFrame:
    """The lattice point nearest to ``at``; halves go to the even one."""
    return df.withColumn(out, (F.rint((at - origin) / step) * step + origin))


def circular_nearest(left: DataFrame, bins: DataFrame, a: str, b: str, bin_id: str, left_id: list[str], period: float, most: int = 1000) -> DataFrame:
    """(left_id, bin_id, distance) of the bin nearest on a circle, the smaller one on ties.

    Up to ``most`` bins (a year's weeks are 52) are one array that each row looks through: no shuffle. More are put on
    the line three times, a period apart, and met in order of time.
    """
    if bins.limit(most + 1).count() <= most:
        from gridtide.functions.calendar import circular_distance

        all_bins = bins.agg(F.collect_list(F.struct(F.col(b).cast("double").alias("at"), F.col(bin_id).alias("id"))).alias("_bins"))  # one row
        each = F.transform("_bins", lambda x: F.struct(circular_distance(F.col(a), x["at"], period).alias("d"), x["id"].alias("id")))
        return left.crossJoin(F.broadcast(all_bins)).withColumn("_m", F.array_min(each)).select(*left_id, F.col("_m.id").alias(bin_id), F.col("_m.d").alias("distance"))
    rows = left.select(*left_id, F.pmod(F.col(a), F.lit(period)).alias("_a"))
    line = bins.select(F.col(bin_id), F.explode(F.array(*(F.pmod(F.col(b), F.lit(period)) + k * period for k in (-1, 0, 1)))).alias("_b"))
    out = nearest(rows, line, [], "_a", "_b", left_id, bin_id)
    return out.select(*left_id, bin_id, F.abs(F.col("_a") - F.col("_b")).alias("distance"))
