"""Missing values: NULL everywhere; NaN, infinities and sentinels become NULL when data come in."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or NULL where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def without_sentinel(x: Column, least: float | None = None, most: float | None = None) -> Column:
    """x, or NULL below ``least`` or above ``most``; apply it before any scaling."""
    ok = F.lit(True)
    if least is not None:
        ok = ok & (x >= least)
    if most is not None:
        ok = ok & (x <= most)
    return F.when(ok, x)


def not_tiny(x: Column, relative: float, keys: list[str]) -> Column:
    """x, or NULL where it is below relative times the largest absolute value of its keys (zeros count as missing)."""
    return F.when(F.abs(x) > relative * F.max(F.abs(x)).over(Window.partitionBy(*keys)), x)
