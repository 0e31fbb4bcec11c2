"""Time axes: days and seconds as integers, the weekly lattice, months as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YEAR_DAYS = 365.24
WEEK = 7 * 86400
LATTICE = 694224000  # 1992-01-01 as seconds; the weeks of the lattice begin here


def seconds(ts: str) -> Column:
    """Seconds since 1970 of a timestamp_ntz column, whatever the session's time zone."""
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def month_number(ts: str) -> Column:
    """year * 12 + month."""
    return (F.year(ts) * 12 + F.month(ts)).cast("long")


def week_start(s: Column) -> Column:
    """Seconds of the beginning of the lattice week that s lies in."""
    return s - F.pmod(s - F.lit(LATTICE), F.lit(WEEK))


def month_start_day(m: Column) -> Column:
    """Days since 1970 of the first day of month number m."""
    first = F.make_date(F.floor((m - 1) / 12).cast("int"), (F.pmod(m - 1, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.datediff(first, F.to_date(F.lit("1970-01-01")))


def month_middle(m: Column) -> Column:
    """Seconds of the middle of month number m."""
    return ((month_start_day(m) + month_start_day(m + 1)) * 43200).cast("long")


def circular_distance(a: Column, b: Column, period: float) -> Column:
    """Distance of a and b on a circle of the given length."""
    d = F.pmod(a - b, F.lit(period))
    return F.least(d, F.lit(period) - d)
