"""Text series: tide gauges and global means; and the parsers on columns of lines that they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridtide.functions.nulls import without_sentinel


def gauge(lines: DataFrame, line: str = "value") -> DataFrame:
    """(year, month, x) of lines ``decimal year; millimetres; ...``: metres, NULL below -50000."""
    part = F.split(line, ";")
    when = F.trim(part[0]).try_cast("double")
    year = F.floor(when)
    month = F.greatest(F.lit(1), F.ceil((when - year) * 12 - 1e-6)).cast("int")
    x = without_sentinel(F.trim(F.get(part, F.lit(1))).try_cast("double"), least=-50000.0) / 1000
    return lines.select("*", year.cast("int").alias("year"), month.alias("month"), x.alias("x")).where("year is not null")


def global_mean(lines: DataFrame, order: str, line: str = "value", end: str = "Header_End") -> DataFrame:
    """(s, x) of the lines after the header: decimal year in column 3 and millimetres in column 6 as metres.

    Values above 90000 are missing; they are sorted out before scaling. The year's own length sets the time.
    """
    seen = F.max(F.col(line).contains(end).cast("int")).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))  # one small file
    rows = lines.withColumn("_on", seen).where("_on = 1").withColumn("_p", F.split(F.trim(line), r"\s+")).where(F.size("_p") >= 11)
    when = F.col("_p")[2].try_cast("double")
    year = F.floor(when).cast("int")
    start = lambda y: F.datediff(F.make_date(y, F.lit(1), F.lit(1)), F.lit("1970-01-01")) * 86400
    s = (start(year) + (when - year) * (start(year + 1) - start(year))).cast("long")
    x = without_sentinel(F.col("_p")[5].try_cast("double"), most=90000.0) / 1000
    return rows.select(s.alias("s"), x.alias("x"))


def gauge_file(spark: SparkSession, path: str) -> DataFrame:
    return gauge(spark.read.text(path)).drop("value")


def global_mean_file(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), "value")
    return global_mean(rows, "n")


def pressure_corrected(level: DataFrame, local: DataFrame, ocean: DataFrame, tolerance: float = 2 * 86400) -> DataFrame:
    """level (s, x) plus (local - ocean mean pressure) / (1030 * 9.81), pressures (s, p) matched within two days, once."""
    from gridtide.operators.timejoin import unique_within

    pressure = local.select("s", F.col("p").alias("pl")).join(ocean.select("s", F.col("p").alias("po")), "s").withColumnRenamed("s", "at")
    one = F.lit(1).alias("_k")
    both = unique_within(level.select("*", one), pressure.select("*", one), ["_k"], "s", "at", tolerance, ["s"])
    return both.select("s", (F.col("x") + (F.col("pl") - F.col("po")) / (1030 * 9.81)).alias("x"))
