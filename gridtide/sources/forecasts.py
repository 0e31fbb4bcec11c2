"""Forecast and model files as rows: starts and times from file names, ensembles, accumulated fluxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.functions.calendar import YEAR_DAYS, month_middle
from gridtide.operators.resample import accumulated_to_rate
from gridtide.operators.timejoin import any_in_window


def with_path(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet files under path with the name of each row's file."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path).withColumn("path", F.col("_metadata.file_path"))


def init_month(path: Column) -> Column:
    """Month number of the yyyymm that begins the last but one dotted part of a file name."""
    part = F.substring(F.element_at(F.split(path, r"\."), -2), 1, 6)
    year, month = F.substring(part, 1, 4).try_cast("long"), F.substring(part, 5, 2).try_cast("long")
    return year * 12 + month


def no_leap_middle(days: Column, first_day: float = 721605.0, first_year_day: int = 2557) -> Column:
    """Month number whose middle is nearest to an end-of-month stamp in days of a calendar without leap years.

    ``first_day`` is the stamp of 1977-01-01, ``first_year_day`` that date in days since 1970. Stamps more than three
    days away from every month's middle are an error.
    """
    s = (F.lit(first_year_day) + (days - first_day) / 365 * YEAR_DAYS - 15) * 86400
    guess = F.floor(s / (YEAR_DAYS / 12 * 86400)).cast("long") + 1970 * 12 + 1
    near = F.array_min(F.transform(F.array(guess - 1, guess, guess + 1), lambda m: F.struct(F.abs(month_middle(m) - s).alias("d"), m.alias("m"))))
    return F.when(near["d"] <= 3 * 86400, near["m"]).otherwise(F.raise_error(F.lit("a stamp is no end of month")))


def ensemble_mean(df: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """Mean over members; keys name everything but the member."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def weekly_fluxes(df: DataFrame, lead_seconds: str, first: int, last: int, keys: list[str], s: str = "s") -> DataFrame:
    """Accumulated (e, tp, ro, ...) forecasts of the starts that reach into first <= s < last, as rates.

    A missing runoff counts as none; water fluxes become downward negative in kg: empmr = -1000 (e + tp + ro).
    """
    rows = any_in_window(df, keys, (F.col(s) >= first) & (F.col(s) < last))
    rows = rows.withColumn("empmr", -1000 * (F.col("e") + F.col("tp") + F.coalesce("ro", F.lit(0.0))))
    return accumulated_to_rate(rows, lead_seconds, "empmr").withColumn("empmr", F.col("rate")).drop("rate")


def step_middle(path: Column, origin: int = 694224000) -> Column:
    """Seconds of the middle of the month that ends at the hour step in a file name (``name.0000000732.data``)."""
    end = F.lit(origin) + F.regexp_extract(path, r"\.([0-9]{10})\.", 1).cast("long") * 3600
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor((end - 1) / 86400).cast("int"))
    return month_middle((F.year(day) * 12 + F.month(day)).cast("long"))
