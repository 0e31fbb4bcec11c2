"""Weekly fluxes of several sources as rows, with their signs, and which source serves before and after a start."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.operators.alignment import year_start

DAY = 86400
WATER = "s long, tile int, j int, i int, evap double, preci double"
RIVER = "s long, lat_ind int, lon_ind int, friver double"


def within_leads(df: DataFrame, years: list[int], weeks: int, s: str = "s") -> DataFrame:
    """Rows from ``weeks`` weeks before the first year to the ninth of January after the last one."""
    start = year_start(F.lit(min(years))) - weeks * 7 * DAY
    return df.where((F.col(s) >= start) & (F.col(s) < year_start(F.lit(max(years) + 1)) + 9 * DAY))


def evaporation_less_rain(spark: SparkSession, path: str, years: list[int], weeks: int) -> DataFrame:
    """(forc, s, tile, j, i, x): kilograms of water that leave the sea, 1000 (evaporation - precipitation)."""
    rows = within_leads(spark.read.schema(WATER).parquet(path), years, weeks)
    return rows.select(F.lit("emp").alias("forc"), "s", "tile", "j", "i", (1000 * (F.col("evap") - F.col("preci"))).alias("x"))


def river_discharge(spark: SparkSession, path: str, years: list[int], weeks: int) -> DataFrame:
    """(forc, s, lat_ind, lon_ind, x): river water into the sea counts as negative."""
    rows = within_leads(spark.read.schema(RIVER).parquet(path), years, weeks)
    return rows.select(F.lit("runoff").alias("forc"), "s", "lat_ind", "lon_ind", (-F.col("friver")).alias("x"))


#: Leads of the forecasts that serve after a start, and their spacing.
AFTER = {"seas5_ensmean": (8, "weekly"), "cesm_dple_ensmean": (6, "monthly"), "cesm_hrdp_ensmean": (3, "monthly")}


def after_start(source: str) -> tuple[int, str]:
    """Number of leads and spacing of the forecast named in source."""
    found = [v for k, v in AFTER.items() if k in source]
    if not found:
        raise ValueError(f"no forecast is named in {source!r}")
    return found[-1]


def before_start(source: str, forc: str, readers: dict[str, Callable[[str], DataFrame]]) -> DataFrame:
    """The forcing by the reader of the source named in ``source``; readers: by "ecco", "ecco_emp", "era5", "jra55do"."""
    names = [k for k in ("ecco", "era5", "jra55do") if k in source]
    if not names:
        raise ValueError(f"no forcing is named in {source!r}")
    name = names[-1]
    return readers["ecco_emp" if name == "ecco" and forc == "emp" else name](forc)
