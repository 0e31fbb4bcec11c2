"""Which week of forcing goes with each step of a sensitivity, in each year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridtide.functions.calendar import LATTICE, WEEK, YEAR_DAYS, month_start_day
from gridtide.operators.timejoin import circular_nearest

BINS = 52
LEAP = 2004  # the year that the bins are laid out in
CLOSE = int(10.5 * 86400)  # a larger step from December to January is a gap


def year_start(year: Column) -> Column:
    """Seconds since 1970 of the first of January."""
    return month_start_day(year * 12 + 1).cast("long") * 86400


def bin_centres(spark) -> DataFrame:
    """(bin, centre): the middles of the weeks of one year, in seconds."""
    return spark.range(BINS).select(F.col("id").cast("int").alias("bin"), (year_start(F.lit(LEAP)) + F.col("id") * WEEK + WEEK // 2).alias("centre"))


def lattice_middle(s: Column, first_year: Column, last_year: Column) -> Column:
    """The middle of the lattice week nearest to s, the earlier of two, among those from the year before first_year on
    that lie before the end of last_year."""
    origin = F.lit(LATTICE + WEEK // 2)
    least = F.rint((year_start(first_year - 1) - LATTICE) / F.lit(WEEK))
    most = F.ceil((year_start(last_year + 1) - origin) / F.lit(WEEK)) - 1
    return (origin + F.least(F.greatest(F.ceil((s - origin) / F.lit(WEEK) - 0.5), least), most) * WEEK).cast("long")


def aligned(steps: DataFrame, years: list[int], reach: int = 5) -> DataFrame:
    """(month, step, year, bin, s): for each step (month, step: from 0, s, n: the month's steps) of a sensitivity and
    each year to predict, the middle of the forcing week of its bin.

    The bin is the nearest on the circle of a year. Its week is of the year before where the bin is not below the
    step's number, of the year after where it is below it by more than n - ``reach``, else of the year itself. Weeks of
    the year before move on by one in years where December and January would leave a gap.
    """
    spark = steps.sparkSession
    near = circular_nearest(steps, bin_centres(spark), "s", "centre", "bin", ["month", "step", "n"], YEAR_DAYS * 86400)
    rows = near.withColumn("year", F.explode(F.array(*(F.lit(y) for y in years))))
    first, last = F.lit(min(years)), F.lit(max(years))
    week = lambda k, year: lattice_middle(year_start(year) + k * WEEK + WEEK // 2, first, last)
    shift = F.when(F.col("bin") >= F.col("step"), -1).when(F.col("bin") < F.col("step") - (F.col("n") - reach), 1).otherwise(0)
    rows = rows.withColumn("_shift", shift)
    gap = week(F.lit(0), F.col("year")) - week(F.lit(BINS - 1), F.col("year") - 1) > CLOSE
    s = week(F.col("bin"), F.col("year") + F.col("_shift")) + F.when((F.col("_shift") == -1) & gap, WEEK).otherwise(0)
    return rows.select("month", "step", "year", "bin", s.cast("long").alias("s"))
