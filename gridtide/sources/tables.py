"""Parquet tables with fixed schemas, and the sinks for results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "grid": "tile int, j int, i int, xc double, yc double, xg double, yg double, area double, wet_frac double",
    "grid_corner": "tile int, j int, i int, corner int, lon double, lat double",
    "altimetry": "ts timestamp_ntz, lat double, lon double, ssh double",
    "pressure": "tval double, lat double, lon double, msl double, ocean_mean double, land_sea double",
    "global_mean": "ts timestamp_ntz, value double",
    "model_surface": "ts timestamp_ntz, tile int, j int, i int, ssh double, eta double",
    "forcing": "forc string, ts timestamp_ntz, tile int, j int, i int, value double",
    "forecast_forcing": "forc string, init_ts timestamp_ntz, step int, pred_ts timestamp_ntz, ens_mem int, tile int, j int, i int, value double",
    "sens": "forc string, pred_month int, step int, sens_ts timestamp_ntz, tile int, j int, i int, value double",
    "cell_member": "cell int, tile int, j int, i int, ord int",
    "align": "pred_month int, step int, year int, forc_ts timestamp_ntz",
    "reference": "series string, ts timestamp_ntz, value double",
    "regrid_weight": "tile int, j int, i int, src_lat_ind int, src_lon_ind int, n int, weight double",
    "impact": "forc string, pred_month int, step int, year int, cell int, value double",
    "stats": "forc string, pred_month int, step int, cell int, resid_var double, frac_varexp double, cum_frac_varexp double",
}


def mapping(spark: SparkSession, path: str) -> DataFrame:
    """(t: tile, j, i; lat_ind, lon_ind, weight) of a table of weights, as :func:`gridtide.operators.regrid.applied` takes them."""
    rows = read(spark, path, "regrid_weight")
    return rows.select(F.struct("tile", "j", "i").alias("t"), F.col("src_lat_ind").alias("lat_ind"), F.col("src_lon_ind").alias("lon_ind"), "weight")


def merged(rows: DataFrame, keys: list[str], file: str = "path", how: str = "override") -> DataFrame:
    """Rows of many files with one row for equal keys: that of the first file by name.

    ``how``: override takes it as it is; equal is an error where files differ in any other column; filled takes each
    column from the first file that has a value there. Rows that one file repeats count as one for each value they have.
    """
    values = [c for c in rows.columns if c not in (*keys, file)]
    if how == "filled":
        return rows.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col(file))).alias(c) for c in values))
    if how not in ("override", "equal"):
        raise ValueError(f"no such merge: {how!r}")
    out = rows.groupBy(*keys).agg(F.min(F.struct(file, *values)).alias("_v"), F.min(F.struct(*values)).alias("_a"), F.max(F.struct(*values)).alias("_z"))
    if how == "equal":
        same = F.when(F.col("_a").eqNullSafe(F.col("_z")), F.col("_v")).otherwise(F.raise_error(F.lit("files differ in a row")))
        out = out.withColumn("_v", same)
    return out.select(*keys, *(F.col(f"_v.{c}").alias(c) for c in values))


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def write(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "error") -> None:
    """Parquet, in folders by the values of ``by``; rows of a folder are brought together first."""
    out = df.repartition(*by).write.partitionBy(*by) if by else df.write
    out.mode(mode).parquet(path)
