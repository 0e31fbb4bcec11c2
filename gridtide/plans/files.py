"""Readers and writers of files, over files that are made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.functions import calendar as C
from gridtide.functions.shared import new_path
from gridtide.plans.base import arrays, query, r6, table, total
from gridtide.sources import fluxes, forecasts, grids, series

SIDE = 4
LAYER = 13 * SIDE * SIDE

#: All values of the vectors one after another, in layers of 13 tiles of 4 by 4 points; what is left over is no layer.
_LAYERS = """ly AS (SELECT (vec_id * 64 + p) // 208 AS layer, (vec_id * 64 + p) % 208 AS pos, CAST(x AS FLOAT)::DOUBLE AS x FROM ar WHERE vec_id * 64 + p < (SELECT count(*) * 64 // 208 * 208 FROM embeddings)),
gl AS (SELECT layer, x, CAST(CASE WHEN pos < 112 THEN pos // 16 WHEN pos < 160 THEN 7 + ((pos - 112) % 12) // 4 ELSE 10 + ((pos - 160) % 12) // 4 END AS INTEGER) AS tile, CAST(CASE WHEN pos < 112 THEN (pos % 16) // 4 WHEN pos < 160 THEN (pos - 112) // 12 ELSE (pos - 160) // 12 END AS INTEGER) AS j, CAST(CASE WHEN pos < 112 THEN pos % 4 ELSE (pos - CASE WHEN pos < 160 THEN 112 ELSE 160 END) % 4 END AS INTEGER) AS i FROM ly)"""


def layers(spark, d):
    """(layer, tile, j, i, x)."""
    n = table(spark, d, "embeddings").count() * 64 // LAYER * LAYER
    at = F.col("vec_id") * 64 + F.col("p")
    tile, j, i = grids.llc_positions(at % LAYER, SIDE)
    return arrays(spark, d).where(at < n).select(F.floor(at / F.lit(LAYER)).alias("layer"), tile.alias("tile"), j.alias("j"), i.alias("i"), "x")


@query("read_weekly_forcing", f"WITH {_LAYERS} SELECT 'empmr' AS forc, 694224000 + layer // 2 * 604800 AS s, tile, j, i, round(x, 6) AS x FROM gl WHERE layer % 2 = 0 AND layer // 2 >= 10")
def read_weekly_forcing(spark, d):
    """A file a week and forcing, of which only one forcing's are read, from the tenth week on."""
    path = new_path(spark)
    name = F.concat(F.when(F.col("layer") % 2 == 0, "empmr").otherwise("qnet"), F.format_string(".%010d.data", (84 + F.expr("layer div 2") * 168).cast("long")))
    grids.write_floats(layers(spark, d).select(name.alias("name"), F.lit(0).alias("record"), "tile", "j", "i", "x"), path, SIDE)
    out = grids.weekly_forcing(spark, path, SIDE, ["empmr"], first=C.LATTICE + 10 * C.WEEK)
    return out.select("forc", "s", "tile", "j", "i", r6("x"))


_SMOOTH = (
    "sm AS (SELECT CASE WHEN layer % 2 = 0 THEN 'empmr' ELSE 'qnet' END AS forc, layer // 2 AS step, tile, j, i, x FROM gl), "
    "so AS (SELECT forc, step, tile, j, i, coalesce(4.0 / 7 * lag(x) OVER w + 3.0 / 7 * x, x) AS x, max(step) OVER (PARTITION BY forc, tile, j, i) AS last FROM sm WINDOW w AS (PARTITION BY forc, tile, j, i ORDER BY step)) "
    "SELECT forc, CAST(step AS BIGINT) AS step, {day} * 86400 - 302400 - (last - step) * 604800 AS s, tile, j, i, round(x, 6) AS x FROM so"
)


def _records(spark, d, name: str):
    """Two files of many records: (forc by name, path)."""
    path = new_path(spark)
    forc = F.when(F.col("layer") % 2 == 0, "empmr").otherwise("qnet")
    grids.write_floats(layers(spark, d).select(F.format_string(name, forc).alias("name"), F.expr("layer div 2").alias("record"), "tile", "j", "i", "x"), path, SIDE)
    return path


@query("read_sensitivities", f"WITH {_LAYERS}, " + _SMOOTH.format(day=11000))
def read_sensitivities(spark, d):
    """Files of many records, smoothed, a week apart up to a day."""
    out = grids.sensitivities(spark, _records(spark, d, "adxx_%s.0000000012.data"), 11000, SIDE)
    return out.select("forc", "step", "s", "tile", "j", "i", r6("x"))


@query("read_sensitivities_multiyear", f"WITH {_LAYERS}, " + _SMOOTH.format(day=16806))
def read_sensitivities_multiyear(spark, d):
    out = grids.sensitivities_of_many_years(spark, _records(spark, d, "adxx_%s.0000000059_dim.data"), SIDE)
    return out.select("forc", "step", "s", "tile", "j", "i", r6("x"))


@query("read_mask", f"WITH {_LAYERS}, m AS (SELECT tile, j, i, CASE WHEN avg(x) > 0 THEN avg(x) ELSE 0 END AS share FROM gl GROUP BY 1, 2, 3) SELECT tile, j, i, round(CAST(share AS FLOAT)::DOUBLE, 5) AS share FROM m WHERE CAST(share AS FLOAT) <> 0")
def read_mask(spark, d):
    """The points of a mask that are not zero: means of all layers where they are positive."""
    path = new_path(spark)
    mean = F.avg("x")
    rows = layers(spark, d).groupBy("tile", "j", "i").agg(F.when(mean > 0, mean).otherwise(0.0).alias("x"))
    grids.write_floats(rows.select(F.lit("mask.data").alias("name"), F.lit(0).alias("record"), "tile", "j", "i", "x"), path, SIDE)
    return grids.mask(spark, path, side=SIDE).select("tile", "j", "i", r6("share", 5))


_WATER = "wa AS (SELECT CAST(floor(epoch(l_shipdate)) AS BIGINT) AS s, l_linenumber AS tile, CAST(l_suppkey % 10 AS INTEGER) AS j, CAST(l_partkey % 10 AS INTEGER) AS i, sum(l_quantity) / 1e3 AS evap, sum(l_tax) AS preci FROM lineitem GROUP BY 1, 2, 3, 4)"
_YEARS, _WEEKS = [1997, 1998], 4
_WITHIN = f"s >= CAST(epoch(DATE '{_YEARS[0]}-01-01') AS BIGINT) - {_WEEKS} * 604800 AND s < CAST(epoch(DATE '{_YEARS[-1] + 1}-01-01') AS BIGINT) + 9 * 86400"


def _shipped(spark, d):
    keys = [C.seconds("l_shipdate").cast("long").alias("s"), F.col("l_linenumber").cast("int").alias("tile"), (F.col("l_suppkey") % 10).cast("int").alias("j"), (F.col("l_partkey") % 10).cast("int").alias("i")]
    return table(spark, d, "lineitem").groupBy(*keys).agg((F.sum("l_quantity") / 1e3).alias("evap"), F.sum("l_tax").alias("preci"))


@query("read_water_flux", f"WITH {_WATER} SELECT 'emp' AS forc, s, tile, j, i, round(1000 * (evap - preci), 5) AS x FROM wa WHERE {_WITHIN}")
def read_water_flux(spark, d):
    """Evaporation less rain of some years and the weeks before them, from a table of files."""
    path = new_path(spark)
    _shipped(spark, d).write.parquet(path)
    return fluxes.evaporation_less_rain(spark, path, _YEARS, _WEEKS).select("forc", "s", "tile", "j", "i", r6("x", 5))


@query("read_river", f"WITH {_WATER} SELECT 'runoff' AS forc, s, j AS lat_ind, i AS lon_ind, round(-sum(evap), 6) AS x FROM wa WHERE {_WITHIN} GROUP BY s, j, i")
def read_river(spark, d):
    """River water counts as negative."""
    path = new_path(spark)
    _shipped(spark, d).groupBy("s", F.col("j").alias("lat_ind"), F.col("i").alias("lon_ind")).agg(F.sum("evap").alias("friver")).write.parquet(path)
    return fluxes.river_discharge(spark, path, _YEARS, _WEEKS).select("forc", "s", "lat_ind", "lon_ind", r6("x"))


@query(
    "global_mean_parse",
    "WITH k AS (SELECT m, (m - 1) // 12 AS y, ((m - 1) % 12 + 0.5) / 12 AS f, CASE WHEN m % 11 = 0 THEN 99900 ELSE floor(x * 100) / 100 END AS v FROM d2t) SELECT CAST(floor(CAST(epoch(make_date(y, 1, 1)) AS BIGINT) + round(f, 6) * (CAST(epoch(make_date(y + 1, 1, 1)) AS BIGINT) - CAST(epoch(make_date(y, 1, 1)) AS BIGINT)) + 1e-3) AS BIGINT) // 600 AS tenth, round(CASE WHEN v < 90000 THEN v / 1000 END, 6) AS x FROM k",
)
def global_mean_parse(spark, d):
    """Lines as global means come, after a header; times to ten minutes."""
    year, part = F.expr("(m - 1) div 12"), ((F.col("m") - 1) % 12 + 0.5) / 12
    mm = F.when(F.col("m") % 11 == 0, 99900.0).otherwise(F.floor(F.col("x") * 100) / 100)
    lines = total(spark, d).select((F.col("m") + 10).alias("n"), F.format_string("999 0 %.6f 1 2 %.2f 7 8 9 10 11", year + part, mm).alias("value"))
    head = spark.createDataFrame([(1, "HDR some 1 2 3 4 5 6 7 8 9 10 11"), (2, "HDR Header_End---")], "n long, value string")
    out = series.global_mean(head.unionByName(lines), "n")
    return out.select(F.floor((F.col("s") + 1e-3) / 600).alias("tenth"), r6("x"))


@query(
    "forecast_stamps",
    "SELECT DISTINCT init, pred, init AS from_name, pred AS from_days, CAST((epoch(make_date((pred - 1) // 12, (pred - 1) % 12 + 1, 1)) + epoch(make_date(pred // 12, pred % 12 + 1, 1))) // 2 AS BIGINT) AS from_step FROM fc",
)
def forecast_stamps(spark, d):
    """Starts from names of files, months from end-of-month stamps of a calendar without leap years, middles from hour steps."""
    from gridtide.plans.base import forecast

    rows = forecast(spark, d).select("init", "pred").distinct()
    month = lambda c: F.expr(f"lpad(cast(({c} - 1) div 12 * 100 + ({c} - 1) % 12 + 1 as string), 6, '0')")
    name = F.concat(F.lit("/x/run.SSH."), month("init"), F.lit("-"), month("(init + 9)"), F.lit(".nc"))
    day = F.element_at(F.array(*(F.lit(x) for x in (31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334, 365))), ((F.col("pred") - 1) % 12 + 1).cast("int"))
    days = 721605.0 + (F.expr("(pred - 1) div 12") - 1977) * 365 + day
    hours = (C.month_start_day(F.col("pred") + 1).cast("long") * 86400 - C.LATTICE) / 3600
    step = F.format_string("state.%010d.data", hours.cast("long"))
    return rows.select("init", "pred", forecasts.init_month(name).alias("from_name"), forecasts.no_leap_middle(days).alias("from_days"), forecasts.step_middle(step).alias("from_step"))


@query("forecast_members", "SELECT s_nationkey AS cell, m, round(avg(x), 6) AS x FROM (SELECT s_nationkey, l_linenumber, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS m, sum(l_extendedprice) / 1e6 AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3) GROUP BY 1, 2")
def forecast_members(spark, d):
    """The mean over the members of a forecast: one for each line of an order."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.groupBy(F.col("s_nationkey").alias("cell"), "l_linenumber", C.month_number("l_shipdate").alias("m")).agg((F.sum("l_extendedprice") / 1e6).alias("x"))
    return forecasts.ensemble_mean(rows, ["cell", "m"]).select("cell", "m", r6("x"))
