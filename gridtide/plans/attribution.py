"""The attribution core: impacts, their sums, and what they explain."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide.functions.calendar import month_start_day
from gridtide.operators import attribution as A
from gridtide.operators import resample as R
from gridtide.operators import stats as S
from gridtide.sources.fluxes import before_start
from gridtide.plans.base import arrays, forcing, forecast, query, r6, rnd, region_of, sensitivity, table, total


_MONTH = "date_diff('day', DATE '1970-01-01', make_date(({m} - 1) // 12, ({m} - 1) % 12 + 1, 1))"


def impacts(spark, d):
    """(cell, forc, m, lag, impact)."""
    anomalies = S.anomaly(forcing(spark, d), ["cell", "forc", F.col("m") % 12])
    return A.convolved(anomalies, sensitivity(spark, d), ["cell"])


@query("conv_impact", "SELECT forc, region, lag, m, round(sum(impact), 6) AS impact FROM imp JOIN reg USING (cell) GROUP BY 1, 2, 3, 4")
def conv_impact(spark, d):
    return A.by_cell(impacts(spark, d), region_of(spark, d), ["cell"], ["forc", "region", "lag", "m"]).select("forc", "region", "lag", "m", r6("impact"))


@query("cell_aggregate", "SELECT region, forc, m, round(sum(x), 6) AS x FROM d1 JOIN reg USING (cell) GROUP BY 1, 2, 3")
def cell_aggregate(spark, d):
    rows = A.by_cell(forcing(spark, d).withColumnRenamed("x", "impact"), region_of(spark, d), ["cell"], ["region", "forc", "m"])
    return rows.select("region", "forc", "m", rnd("impact", 6).alias("x"))


@query("cell_scatter", "WITH k AS (SELECT region, m, sum(x) AS y FROM d1 JOIN reg USING (cell) GROUP BY 1, 2) SELECT cell, m, round(y, 6) AS y FROM k JOIN reg USING (region)")
def cell_scatter(spark, d):
    reg = region_of(spark, d)
    rows = forcing(spark, d).join(reg, "cell").groupBy("region", "m").agg(F.sum("x").alias("y"))
    return rows.join(reg, "region").select("cell", "m", r6("y"))


@query("reconstr_total", "SELECT m, round(sum(impact), 6) AS total FROM imp GROUP BY 1")
def reconstr_total(spark, d):
    return A.by_cell(impacts(spark, d), None, [], ["m"]).select("m", rnd("impact", 6).alias("total"))


@query("impact_cube", "SELECT m, forc, lag, round(sum(impact), 6) AS impact FROM imp GROUP BY GROUPING SETS ((m, forc), (m, lag), (m))")
def impact_cube(spark, d):
    return A.marginals(impacts(spark, d), "forc", "lag", ["m"]).select("m", "forc", "lag", r6("impact"))


@query("cum_impact", "WITH k AS (SELECT forc, m, lag, sum(impact) AS impact FROM imp GROUP BY 1, 2, 3), n AS (SELECT *, CASE WHEN m % 7 = 0 AND lag = 2 THEN NULL ELSE impact END AS y FROM k) SELECT forc, m, lag, round(sum(y) OVER w, 6) AS skipped, round(CASE WHEN max(CASE WHEN y IS NULL THEN 1 ELSE 0 END) OVER w = 0 THEN sum(y) OVER w END, 6) AS poisoned FROM n WINDOW w AS (PARTITION BY forc, m ORDER BY lag)")
def cum_impact(spark, d):
    rows = A.by_cell(impacts(spark, d), None, [], ["forc", "m", "lag"])
    rows = rows.withColumn("impact", F.when(~((F.col("m") % 7 == 0) & (F.col("lag") == 2)), F.col("impact")))
    rows = A.cumulative(rows, ["forc", "m"], "lag").withColumnRenamed("cum", "skipped")
    rows = A.cumulative(rows, ["forc", "m"], "lag", poison=True)
    return rows.select("forc", "m", "lag", r6("skipped"), rnd("cum", 6).alias("poisoned"))


_K = "WITH k AS (SELECT forc, m, lag, sum(impact) AS pre, sum(CASE WHEN lag > 2 THEN impact * 0.5 END) AS post FROM imp GROUP BY 1, 2, 3)"


def _pre_post(spark, d):
    return impacts(spark, d).groupBy("forc", "m", "lag").agg(F.sum("impact").alias("pre"), F.sum(F.when(F.col("lag") > 2, F.col("impact") * 0.5)).alias("post"))


@query("cum_pre_post", f"{_K} SELECT forc, m, lag, round(sum(pre) OVER (PARTITION BY forc, m ORDER BY lag) + coalesce(sum(post) OVER (PARTITION BY forc, m ORDER BY lag ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0), 6) AS cum FROM k")
def cum_pre_post(spark, d):
    return A.before_and_after(_pre_post(spark, d), ["forc", "m"], "lag", "pre", "post").select("forc", "m", "lag", r6("cum"))


@query("blend_pre_post", f"{_K} SELECT forc, m, lag, round(CASE WHEN lag > 2 THEN post ELSE pre END, 6) AS blend FROM k")
def blend_pre_post(spark, d):
    rows = _pre_post(spark, d)
    return rows.select("forc", "m", "lag", rnd(A.blended(F.col("pre"), F.col("post"), F.col("lag"), F.lit(2)), 6).alias("blend"))


@query("lag_smooth", "SELECT vec_id, p, round(coalesce(4.0 / 7 * lag(x) OVER w + 3.0 / 7 * x, x), 6) AS smooth FROM ar WINDOW w AS (PARTITION BY vec_id ORDER BY p)")
def lag_smooth(spark, d):
    return R.smoothed(arrays(spark, d), ["vec_id"], "p").select("vec_id", "p", r6("smooth"))


@query("taper_blend", "SELECT cell, lag, round(CASE WHEN lag < 3 THEN (lag + 0.5) / 3 * w + (1 - (lag + 0.5) / 3) * 0.5 ELSE w END, 6) AS w FROM sens")
def taper_blend(spark, d):
    s = sensitivity(spark, d)
    return A.tapered(s.withColumn("w", F.lit(0.5)), s, ["cell"], "lag", 3).select("cell", "lag", r6("w"))


_STARTS = "k AS (SELECT cell, forc, m, lag, impact, (m - lag) // 2 AS pair, " + _MONTH.format(m="(m - lag) // 2 * 2") + " + (m - lag) % 2 AS start FROM imp)"


@query(
    "accum_after_start",
    f"WITH {_STARTS}, a AS (SELECT *, sum(impact) OVER (PARTITION BY cell, forc, m, pair ORDER BY lag ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS y FROM k) SELECT cell, forc, m, lag, round(y, 6) AS y FROM a",
)
def accum_after_start(spark, d):
    """Steps of one target month that were forced by forecasts whose starts are a day apart are summed up back to each step."""
    start = month_start_day(F.expr("(m - lag) div 2 * 2")) + (F.col("m") - F.col("lag")) % 2
    rows = impacts(spark, d).withColumn("start", start)
    return A.accumulated_after(rows, ["cell", "forc", "m"], "lag", "start", "impact").select("cell", "forc", "m", "lag", rnd("after", 6).alias("y"))


@query(
    "cum_last_filled",
    "WITH k AS (SELECT forc, m, lag, sum(impact) AS impact FROM imp GROUP BY 1, 2, 3), e AS (SELECT *, row_number() OVER (PARTITION BY forc, m ORDER BY lag DESC) AS back FROM k), n AS (SELECT *, CASE WHEN back = 1 AND m % 3 = 0 THEN NULL ELSE impact END AS y FROM e), "
    "c AS (SELECT forc, m, lag, back, CASE WHEN count(*) OVER w = count(y) OVER w THEN sum(y) OVER w END AS cum FROM n WINDOW w AS (PARTITION BY forc, m ORDER BY lag)) SELECT a.forc, a.m, a.lag, round(coalesce(a.cum, b.cum), 6) AS cum FROM c a LEFT JOIN c b ON a.back = 1 AND b.back = 2 AND a.forc = b.forc AND a.m = b.m",
)
def cum_last_filled(spark, d):
    """Running sums whose last step, where it is missing, takes that before it."""
    rows = A.by_cell(impacts(spark, d), None, [], ["forc", "m", "lag"])
    last = F.row_number().over(Window.partitionBy("forc", "m").orderBy(F.desc("lag"))) == 1
    rows = rows.withColumn("_last", last).withColumn("impact", F.when(~(F.col("_last") & (F.col("m") % 3 == 0)), F.col("impact")))
    rows = A.cumulative(rows, ["forc", "m"], "lag", poison=True)
    return A.last_filled(rows, ["forc", "m"], "lag").select("forc", "m", "lag", r6("cum"))


_LONG, _SHORT, _FROM = 12, 6, 5
_TWO_STEPS = (
    "yr AS (SELECT DISTINCT cell, (m - 1) // 12 AS year FROM d1), "
    f"lg AS (SELECT cell, CAST((m - 1) % 12 AS INTEGER) AS step, avg(x) AS w FROM d1 WHERE forc = 'R' GROUP BY 1, 2), sh AS (SELECT cell, CAST((m - 1) % 12 AS INTEGER) AS step, avg(x) AS w FROM d1 WHERE forc = 'A' AND (m - 1) % 12 < {_SHORT} GROUP BY 1, 2), "
    "lt AS (SELECT cell, step, year, " + _MONTH.format(m="year * 12 + step + 1") + " AS day FROM yr JOIN lg USING (cell)), "
    "s0 AS (SELECT cell, year, " + _MONTH.format(m=f"year * 12 + 1 + {_FROM} + cell % 3") + " + year % 7 AS begins FROM yr JOIN sh USING (cell) WHERE step = 0), "
    "nb AS (SELECT cell, CAST(round_even(avg(n), 0) AS INTEGER) AS n FROM (SELECT cell, year, sum(CASE WHEN day - begins < -3 THEN 1 ELSE 0 END) AS n FROM lt JOIN s0 USING (cell, year) GROUP BY 1, 2) GROUP BY 1)"
)


@query(
    "prepend_multiyear",
    f"WITH {_TWO_STEPS} SELECT cell, step, round(w, 6) AS w FROM lg JOIN nb USING (cell) WHERE step < n UNION ALL SELECT sh.cell, sh.step + n, round(CASE WHEN sh.step < 3 THEN (1 - (sh.step + 0.5) / 3) * coalesce(lg.w, sh.w) + (sh.step + 0.5) / 3 * sh.w ELSE sh.w END, 6) FROM sh JOIN nb USING (cell) LEFT JOIN lg ON lg.cell = sh.cell AND lg.step = sh.step + n",
)
def prepend_multiyear(spark, d):
    """A sequence of twelve steps goes before one of six that begins later, by a number of steps that differs by cell."""
    rows = forcing(spark, d).withColumn("step", ((F.col("m") - 1) % 12).cast("int"))
    pick = lambda forc, n: rows.where((F.col("forc") == forc) & (F.col("step") < n)).groupBy("cell", "step").agg(F.avg("x").alias("w"))
    long, short = pick("R", _LONG), pick("A", _SHORT)
    years = rows.select("cell", F.expr("(m - 1) div 12").alias("year")).distinct()
    times = lambda steps, at: years.join(steps.select("cell", "step"), "cell").withColumn("at", at)
    long_times = times(long, month_start_day(F.col("year") * 12 + F.col("step") + 1))
    short_times = times(short, month_start_day(F.col("year") * 12 + 1 + _FROM + F.col("cell") % 3 + F.col("step")) + F.col("year") % 7)
    return A.prepended(long, short, long_times, short_times, ["cell"], "step", "at", 3).select("cell", "step", r6("w"))


@query("add_component", "WITH a AS (SELECT cell, m, x FROM d1 WHERE forc = 'A'), b AS (SELECT cell, m, x FROM d1 WHERE forc = 'N') SELECT cell, m, round(coalesce(a.x, 0) + coalesce(b.x, 0), 6) AS x FROM a FULL JOIN b USING (cell, m)")
def add_component(spark, d):
    f = forcing(spark, d)
    return A.added(f.where("forc = 'A'"), f.where("forc = 'N'"), ["cell", "m"], "x").select("cell", "m", r6("x"))


@query("sensadj_scale", "WITH r AS (SELECT forc, CASE forc WHEN 'A' THEN 0.5 WHEN 'N' THEN 1.5 ELSE 1.0 END AS ratio FROM (SELECT DISTINCT forc FROM d1)) SELECT forc, lag, round(var_pop(impact * ratio), 6) AS variance FROM imp JOIN r USING (forc) GROUP BY 1, 2")
def sensadj_scale(spark, d):
    ratio = spark.createDataFrame([("A", 0.5), ("N", 1.5), ("R", 1.0)], "forc string, ratio double")
    rows = impacts(spark, d).join(F.broadcast(ratio), "forc").withColumn("impact", F.col("impact") * F.col("ratio"))
    return S.variance(rows, ["forc", "lag"], "impact").select("forc", "lag", r6("variance"))


@query("sensadj_resid", "WITH k AS (SELECT forc, m, sum(impact * CASE forc WHEN 'A' THEN 0.5 WHEN 'N' THEN 1.5 ELSE 1.0 END) AS y FROM imp GROUP BY 1, 2) SELECT forc, round(var_pop(x - y), 6) AS variance, round(1 - var_pop(x - y) / var_pop(x), 6) AS varexp, count(*) AS n FROM k JOIN d2t USING (m) GROUP BY 1")
def sensadj_resid(spark, d):
    """What is left of the reference without each forcing's impact, the sensitivities scaled by forcing."""
    ratio = spark.createDataFrame([("A", 0.5), ("N", 1.5), ("R", 1.0)], "forc string, ratio double")
    rows = impacts(spark, d).join(F.broadcast(ratio), "forc").groupBy("forc", "m").agg(F.sum(F.col("impact") * F.col("ratio")).alias("y"))
    rows = rows.join(total(spark, d), "m")
    out = S.variance_explained(rows, ["forc"], "x", "y").join(S.variance(rows.withColumn("rest", F.col("x") - F.col("y")), ["forc"], "rest"), "forc")
    return out.select("forc", r6("variance"), r6("varexp"), "n")


@query("source_dispatch", "SELECT 'emp' AS forc, cell, m, round(1000 * x, 6) AS x FROM d1 WHERE forc = 'A' UNION ALL SELECT 'tauu', cell, m, round(x, 6) FROM d1 WHERE forc = 'N' UNION ALL SELECT 'runoff', cell, m, round(-x, 6) FROM d1 WHERE forc = 'R'")
def source_dispatch(spark, d):
    """Each forcing from the source that is named for the time before the start."""
    f = forcing(spark, d)
    of = lambda code, scale: lambda forc: f.where(F.col("forc") == code).select(F.lit(forc).alias("forc"), "cell", "m", (scale * F.col("x")).alias("x"))
    readers = {"ecco": of("A", 1.0), "ecco_emp": of("A", 1000.0), "era5": of("N", 1.0), "jra55do": of("R", -1.0)}
    named = (("ecco_v4r4", "emp"), ("era5_weekly", "tauu"), ("jra55do_rivers", "runoff"))
    parts = [before_start(source, forc, readers) for source, forc in named]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("forc", "cell", "m", r6("x"))


@query("dataset_diff", "SELECT a.cell, a.m, round(a.x - b.x, 6) AS diff FROM d1 a JOIN d1 b ON a.cell = b.cell AND a.m = b.m AND a.forc = 'A' AND b.forc = 'R'")
def dataset_diff(spark, d):
    f = forcing(spark, d)
    return A.difference(f.where("forc = 'A'"), f.where("forc = 'R'"), ["cell", "m"]).select("cell", "m", r6("diff"))


@query("lead_threshold_cum", "SELECT forc, m, t.lead, round(sum(impact), 6) AS predicted FROM imp JOIN (VALUES (CAST(0 AS BIGINT)), (2), (4)) t(lead) ON lag >= t.lead GROUP BY 1, 2, 3")
def lead_threshold_cum(spark, d):
    leads = spark.createDataFrame([(0,), (2,), (4,)], "lead long")
    return A.by_lead(impacts(spark, d), leads, ["forc", "m"]).select("forc", "m", "lead", r6("predicted"))


@query("predict_by_lead", "SELECT region, m, t.lead, min(lag) AS first_lag, round(sum(impact), 6) AS predicted FROM imp JOIN reg USING (cell) JOIN (VALUES (CAST(1 AS BIGINT)), (3), (5)) t(lead) ON lag >= t.lead GROUP BY 1, 2, 3")
def predict_by_lead(spark, d):
    rows = impacts(spark, d).join(region_of(spark, d), "cell")
    leads = spark.createDataFrame([(1,), (3,), (5,)], "lead long")
    return A.by_lead(rows, leads, ["region", "m"]).select("region", "m", "lead", "first_lag", r6("predicted"))


@query("varexp_by_lead", "WITH k AS (SELECT m, t.lead, sum(impact) AS p FROM imp JOIN (VALUES (CAST(0 AS BIGINT)), (1), (2), (3), (4), (5)) t(lead) ON lag >= t.lead GROUP BY 1, 2) SELECT lead, round(1 - var_pop(x - p) / nullif(var_pop(x), 0), 6) AS varexp, count(*) AS n FROM k JOIN d2t USING (m) GROUP BY 1")
def varexp_by_lead(spark, d):
    leads = spark.createDataFrame([(k,) for k in range(6)], "lead long")
    rows = A.by_lead(impacts(spark, d), leads, ["m"]).join(total(spark, d), "m")
    return S.variance_explained(rows, ["lead"], "x", "predicted").select("lead", r6("varexp"), "n")


@query("varexp_cum_cell", "WITH k AS (SELECT cell, forc, lag, m, impact, sum(impact) OVER (PARTITION BY cell, forc, m ORDER BY lag) AS cum FROM imp) SELECT cell, forc, lag, round(var_pop(x - impact), 6) AS resid_var, round(var_pop(x - cum), 6) AS cum_resid_var FROM k JOIN d2t USING (m) GROUP BY 1, 2, 3")
def varexp_cum_cell(spark, d):
    """What each lag alone, and all lags up to it, leave of the variance of the whole."""
    rows = A.cumulative(impacts(spark, d), ["cell", "forc", "m"], "lag").drop("x").join(total(spark, d), "m")
    out = rows.groupBy("cell", "forc", "lag").agg(F.var_pop(F.col("x") - F.col("impact")).alias("resid_var"), F.var_pop(F.col("x") - F.col("cum")).alias("cum_resid_var"))
    return out.select("cell", "forc", "lag", r6("resid_var"), r6("cum_resid_var"))


@query("varexp_by_region_forc", "WITH k AS (SELECT region, forc, m, sum(impact) AS p FROM imp JOIN reg USING (cell) GROUP BY 1, 2, 3), a AS (SELECT region, forc, m, p FROM k UNION ALL SELECT -1, forc, m, sum(p) FROM k GROUP BY forc, m) SELECT region, forc, round(1 - var_pop(x - p) / nullif(var_pop(x), 0), 6) AS varexp, count(*) AS n FROM a JOIN d2t USING (m) GROUP BY 1, 2")
def varexp_by_region_forc(spark, d):
    rows = A.by_cell(impacts(spark, d), region_of(spark, d), ["cell"], ["region", "forc", "m"])
    whole = rows.groupBy("forc", "m").agg(F.sum("impact").alias("impact")).withColumn("region", F.lit(-1))
    return S.variance_explained(rows.unionByName(whole).join(total(spark, d), "m"), ["region", "forc"], "x", "impact").select("region", "forc", r6("varexp"), "n")


@query("override_coalesce", "WITH b AS (SELECT cell, m, x FROM d1 WHERE forc = 'A'), s AS (SELECT cell, m, x AS y FROM d1 WHERE forc = 'N' AND m % 2 = 0), k AS (SELECT cell, count(*) AS n FROM b GROUP BY 1) SELECT cell, m, round(CASE WHEN cell % 2 = 0 THEN coalesce(y, x) ELSE x END, 6) AS x FROM b LEFT JOIN s USING (cell, m)")
def override_coalesce(spark, d):
    f = forcing(spark, d)
    out = A.overridden(f.where("forc = 'A'").select("cell", "m", "x"), f.where("forc = 'N' and m % 2 = 0"), ["cell", "m"], only=F.col("cell") % 2 == 0)
    return out.select("cell", "m", r6("x"))


@query("flux_derive", "SELECT l_orderkey, l_linenumber, round(-l_quantity - l_discount, 6) AS emp, round(-l_quantity - l_discount - coalesce(nullif(l_tax, 0), 0), 6) AS empmr, round(-(l_quantity + l_extendedprice + l_discount + l_tax), 4) AS qnet, round(-(l_discount + l_tax) * 0.1, 6) AS tauu FROM lineitem")
def flux_derive(spark, d):
    c = F.col
    runoff = F.coalesce(F.when(c("l_tax") != 0, c("l_tax")), F.lit(0.0))
    rows = table(spark, d, "lineitem")
    emp = -c("l_quantity") - c("l_discount")
    return rows.select("l_orderkey", "l_linenumber", rnd(emp, 6).alias("emp"), rnd(emp - runoff, 6).alias("empmr"), rnd(-(c("l_quantity") + c("l_extendedprice") + c("l_discount") + c("l_tax")), 4).alias("qnet"), rnd(-(c("l_discount") + c("l_tax")) * 0.1, 6).alias("tauu"))


@query("forecast_impact", "WITH a AS (SELECT *, x - avg(x) OVER (PARTITION BY cell, pred % 12, pred - init) AS anom FROM fc) SELECT cell, pred + lag AS m, init, lag, round(w * anom, 6) AS impact FROM a JOIN sens USING (cell)")
def forecast_impact(spark, d):
    rows = S.anomaly(forecast(spark, d), ["cell", F.col("pred") % 12, F.col("pred") - F.col("init")]).withColumnRenamed("pred", "m")
    return A.convolved(rows, sensitivity(spark, d), ["cell"]).select("cell", "m", "init", "lag", r6("impact"))
