"""The series that is to be explained: one interface for gauges, gridded levels, model leads and reconstructions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.operators import filters
from gridtide.operators.geometry import nearest_cell
from gridtide.operators.resample import monthly_removed
from gridtide.operators.stats import detrended, weighted_mean
from gridtide.operators.timejoin import lead_numbers, spacing

KINDS: dict[str, Callable[..., DataFrame]] = {}


def kind(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    KINDS[f.__name__] = f
    return f


def reference(name: str, **parts) -> DataFrame:
    """(series, m, x[, lead_num]) of a kind of reference; see the functions of this module for their parts."""
    if name not in KINDS:
        raise ValueError(f"no such reference: {name}; there are {', '.join(sorted(KINDS))}")
    return KINDS[name](**parts)


@kind
def gauge(level: DataFrame, global_mean: DataFrame | None = None) -> DataFrame:
    """A corrected gauge (m, x), less the month's global mean (m, x) if given."""
    rows = level if global_mean is None else monthly_removed(level, global_mean).select("m", F.col("rest").alias("x"))
    return rows.select(F.lit("gauge").alias("series"), "m", "x")


@kind
def altimetry(field: DataFrame, weight: DataFrame, least: float = 0.9) -> DataFrame:
    """A gridded level (cell, m, x) averaged by weight (cell, w) over the cells valid in more than ``least`` of the months."""
    months = field.agg(F.count_distinct("m").alias("_n"))  # one row
    valid = field.groupBy("cell").agg(F.count("x").alias("_c")).crossJoin(F.broadcast(months)).where(F.col("_c") > least * F.col("_n"))
    rows = field.join(valid.select("cell"), "cell", "left_semi").join(weight, "cell")
    return weighted_mean(rows, ["m"], "w").select(F.lit("altimetry").alias("series"), "m", F.col("mean").alias("x"))


@kind
def at_point(field: DataFrame, cells: DataFrame, lon: float, lat: float) -> DataFrame:
    """The cell (cell, lon, lat) nearest to a point, of a field (cell, m, x)."""
    point = field.sparkSession.createDataFrame([(0, lon, lat)], "point int, lon double, lat double")
    own = nearest_cell(point, cells, "point", "cell").select("cell")
    return field.join(F.broadcast(own), "cell", "left_semi").select(F.lit("point").alias("series"), "m", "x")  # one cell


def level_from_surface(surface: DataFrame, other: DataFrame, world: DataFrame) -> DataFrame:
    """(m, x): the sea level of a model of which only its surface (m, eta) is known, by what another model's level and
    surface (m, ssh, eta) differ, less the same sum of the global means (m, eta, other_ssh, other_eta)."""
    own = surface.select("m", F.col("eta").alias("_eta")).join(other.select("m", F.col("ssh").alias("_ssh"), F.col("eta").alias("_other")), "m")
    mean = world.select("m", (F.col("eta") + F.col("other_ssh") - F.col("other_eta")).alias("_mean"))
    return own.join(mean, "m").select("m", (F.col("_eta") + F.col("_ssh") - F.col("_other") - F.col("_mean")).alias("x"))


@kind
def model(forecast: DataFrame) -> DataFrame:
    """A forecast (init, pred, x) by number of its lead."""
    rows = forecast.withColumns({"lead": F.col("pred") - F.col("init"), "_k": F.lit(1)})
    rows = lead_numbers(rows.join(F.broadcast(spacing(rows, ["_k"], "init")), "_k"), ["pred"], "lead", "spacing")
    return rows.groupBy("pred", "lead_num").agg(F.avg("x").alias("x")).select(F.lit("model").alias("series"), F.col("pred").alias("m"), "lead_num", "x")


@kind
def reconstruction(impact: DataFrame) -> DataFrame:
    """The sum of all impacts (m, impact)."""
    return impact.groupBy("m").agg(F.sum("impact").alias("x")).select(F.lit("reconstruction").alias("series"), "m", "x")


def by_month(series: DataFrame, detrend: bool = False) -> DataFrame:
    """(series, month, year, y): each month's values about their mean, or about their trend."""
    rows = series.withColumns({"month": (F.col("m") - 1) % 12 + 1, "year": F.expr("(m - 1) div 12")})
    if detrend:
        return detrended(rows, ["series", "month"], "year", out="y").select("series", "month", "year", "y")
    return rows.withColumn("y", F.col("x") - F.avg("x").over(Window.partitionBy("series", "month"))).select("series", "month", "year", "y")


def extended_back(early: DataFrame, late: DataFrame, targets: DataFrame, keys: list[str], at: str, start: float, end: float, n_harmonics: int = 4, value: str = "x") -> DataFrame:
    """A record carried back by an earlier, coarser one: (keys, at, value) at the targets, times in days.

    The early series is interpolated, its ends kept beyond them, moved by the difference of both means over start <= at <
    end, and given the late series' seasonal cycle, of which the line over the targets is taken off.
    """
    inside = (F.col(at) >= start) & (F.col(at) < end)
    mean = lambda df, name: df.where(inside).groupBy(*keys).agg(F.avg(value).alias(name))
    offset = mean(late, "_l").join(mean(early, "_e"), keys).select(*keys, (F.col("_l") - F.col("_e")).alias("_offset"))
    filled = filters.interpolated(early, targets, keys, at, value, clamped=True)
    cycle = filters.seasonal_at(filters.seasonal_coefficients(late, keys, at, n_harmonics, value), targets.select(*keys, at), keys, at, "_cycle")
    cycle = detrended(cycle, keys, at, "_cycle", "_wave").select(*keys, at, "_wave")
    rows = filled.join(offset, keys).join(cycle, [*keys, at])
    return rows.select(*keys, at, (F.col(value) + F.col("_offset") + F.col("_wave")).alias(value))
