"""Masked statistics, trends and variance explained."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridtide.operators import attribution as A
from gridtide.operators import references
from gridtide.operators import stats as S
from gridtide.plans.base import arrays, cells, forcing, query, r6, rnd, reference, region_of, total

FIRST = 1996 * 12 + 1
LAST = 2000 * 12 + 1


@query("masked_mean", "SELECT cell, forc, round(avg(CASE WHEN x <> 0 THEN x END), 6) AS mean, count(CASE WHEN x <> 0 THEN x END) AS n FROM d1 GROUP BY 1, 2")
def masked_mean(spark, d):
    return S.masked_mean(forcing(spark, d), ["cell", "forc"], zero_is_missing=True).select("cell", "forc", r6("mean"), "n")


@query("tiny_masked_mean", "WITH k AS (SELECT *, CASE WHEN abs(x) > 0.02 * max(abs(x)) OVER (PARTITION BY vec_id) THEN x END AS y FROM ar) SELECT vec_id, round(avg(y), 6) AS mean, count(y) AS n FROM k GROUP BY 1")
def tiny_masked_mean(spark, d):
    return S.tiny_masked_mean(arrays(spark, d), ["vec_id"], relative=0.02).select("vec_id", r6("mean"), "n")


@query("var_compute", "SELECT cell, forc, round(var_pop(x), 6) AS variance FROM d1 GROUP BY 1, 2")
def var_compute(spark, d):
    return S.variance(forcing(spark, d), ["cell", "forc"]).select("cell", "forc", r6("variance"))


@query("reconstr_var", "SELECT cell, round(avg(anom * anom), 6) AS mean_square FROM an GROUP BY 1")
def reconstr_var(spark, d):
    return S.mean_square(S.anomaly(forcing(spark, d), ["cell", "forc", F.col("m") % 12]), ["cell"], "anom").select("cell", r6("mean_square"))


@query("clim_anomaly", "SELECT cell, forc, m, round(anom, 6) AS anom FROM an")
def clim_anomaly(spark, d):
    return S.anomaly(forcing(spark, d), ["cell", "forc", F.col("m") % 12]).select("cell", "forc", "m", r6("anom"))


@query("impact_var", "SELECT cell, forc, lag, round(var_pop(impact), 6) AS variance FROM imp GROUP BY 1, 2, 3")
def impact_var(spark, d):
    from gridtide.plans.attribution import impacts

    return S.variance(impacts(spark, d), ["cell", "forc", "lag"], "impact").select("cell", "forc", "lag", r6("variance"))


@query("abs_quantile", "SELECT label, round(quantile_disc(abs(x), 0.998), 6) AS limit FROM ar GROUP BY 1".replace(" AS limit", ' AS "limit"'))
def abs_quantile(spark, d):
    return S.abs_limit(arrays(spark, d), ["label"], 0.998).select("label", r6("limit"))


@query("valid_fraction_mask", "WITH k AS (SELECT cell, forc, CASE WHEN x > 0.3 * avg(x) OVER (PARTITION BY cell) THEN x END AS y FROM d1) SELECT cell, forc, round(avg(CASE WHEN y IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS share FROM k GROUP BY 1, 2 HAVING avg(CASE WHEN y IS NOT NULL THEN 1.0 ELSE 0.0 END) > 0.9")
def valid_fraction_mask(spark, d):
    from pyspark.sql import Window

    rows = forcing(spark, d).withColumn("x", F.when(F.col("x") > 0.3 * F.avg("x").over(Window.partitionBy("cell")), F.col("x")))
    return S.valid_share(rows, ["cell", "forc"], 0.9).select("cell", "forc", r6("share"))


@query("annual_mean_min_count", "SELECT series, (m - 1) // 12 AS year, round(avg(x), 6) AS mean, count(x) AS n FROM d2 GROUP BY 1, 2 HAVING count(x) > 8")
def annual_mean_min_count(spark, d):
    rows = reference(spark, d).withColumn("year", F.expr("(m - 1) div 12"))
    return S.enough(rows, ["series", "year"], 9).select("series", "year", r6("mean"), "n")


@query("trend_slope", "SELECT cell, forc, round(regr_slope(x, m) / 0.5, 6) AS slope, count(x) AS n FROM d1 GROUP BY 1, 2")
def trend_slope(spark, d):
    return S.trend(forcing(spark, d), ["cell", "forc"], "m", delta=0.5).select("cell", "forc", r6("slope"), "n")


@query("trend_dimvec", "SELECT series, round(regr_slope(x, m - 23940), 6) AS slope, round(regr_intercept(x, m - 23940), 6) AS intercept FROM d2 GROUP BY 1")
def trend_dimvec(spark, d):
    return S.trend(reference(spark, d).withColumn("t", F.col("m") - 23940), ["series"], "t").select("series", r6("slope"), r6("intercept"))


@query("detrend", "WITH k AS (SELECT series, regr_slope(x, m) AS b, avg(m) AS tm, avg(x) AS xm FROM d2 GROUP BY 1) SELECT series, m, round(x - xm - b * (m - tm), 6) AS resid FROM d2 JOIN k USING (series)")
def detrend(spark, d):
    return S.detrended(reference(spark, d), ["series"], "m").select("series", "m", r6("resid"))


@query("trend_window", f"SELECT series, round(regr_slope(x, m), 6) AS slope, count(x) AS n FROM d2 WHERE m >= {FIRST} AND m < {LAST} GROUP BY 1")
def trend_window(spark, d):
    rows = reference(spark, d).where((F.col("m") >= FIRST) & (F.col("m") < LAST))
    return S.trend(rows, ["series"], "m").select("series", r6("slope"), "n")


WINDOWS = [(1995, 2001), (1995, 1998), (1998, 2001)]


@query("trend_windows", "WITH w(y0, y1) AS (VALUES (1995, 2001), (1995, 1998), (1998, 2001)) SELECT series, y0, y1, round(regr_slope(x, m) * 12, 6) AS per_year FROM d2 JOIN w ON m > y0 * 12 AND m <= y1 * 12 GROUP BY 1, 2, 3")
def trend_windows(spark, d):
    rows = reference(spark, d).withColumn("w", F.explode(F.array(*[F.struct(F.lit(a).alias("y0"), F.lit(b).alias("y1")) for a, b in WINDOWS])))
    rows = rows.select("series", "m", "x", "w.y0", "w.y1").where("m > y0 * 12 and m <= y1 * 12")
    return S.trend(rows, ["series", "y0", "y1"], "m", delta=1 / 12).select("series", "y0", "y1", rnd("slope", 6).alias("per_year"))


@query("trend_per_cell", "WITH k AS (SELECT cell, forc, m, sum(impact) AS y FROM imp GROUP BY 1, 2, 3) SELECT cell, forc, round(regr_slope(y, m) * 12, 6) AS per_year FROM k GROUP BY 1, 2")
def trend_per_cell(spark, d):
    from gridtide.plans.attribution import impacts

    rows = A.by_cell(impacts(spark, d), None, [], ["cell", "forc", "m"])
    return S.trend(rows, ["cell", "forc"], "m", "impact", 1 / 12).select("cell", "forc", rnd("slope", 6).alias("per_year"))


@query("trend_by_region_forc", "WITH k AS (SELECT region, forc, m, sum(x) AS y FROM d1 JOIN reg USING (cell) GROUP BY 1, 2, 3), a AS (SELECT region, forc, m, y FROM k UNION ALL SELECT -1, forc, m, sum(y) FROM k GROUP BY forc, m) SELECT region, forc, round(regr_slope(y, m) * 12, 6) AS per_year FROM a GROUP BY 1, 2")
def trend_by_region_forc(spark, d):
    rows = forcing(spark, d).join(region_of(spark, d), "cell").groupBy("region", "forc", "m").agg(F.sum("x").alias("x"))
    whole = rows.groupBy("forc", "m").agg(F.sum("x").alias("x")).withColumn("region", F.lit(-1))
    return S.trend(rows.unionByName(whole), ["region", "forc"], "m", delta=1 / 12).select("region", "forc", rnd("slope", 6).alias("per_year"))


@query("varexp_cell", "WITH k AS (SELECT cell, forc, d2t.x AS b, d1.x AS p FROM d1 JOIN d2t USING (m)) SELECT cell, forc, round(var_pop(b - p), 6) AS resid_var, round(1 - var_pop(b - p) / nullif(var_pop(b), 0), 6) AS frac FROM k GROUP BY 1, 2")
def varexp_cell(spark, d):
    rows = forcing(spark, d).join(total(spark, d).withColumnRenamed("x", "b"), "m").withColumn("r", F.col("b") - F.col("x"))
    out = rows.groupBy("cell", "forc").agg(F.var_pop("r").alias("resid_var"), (1 - F.try_divide(F.var_pop("r"), F.var_pop("b"))).alias("frac"))
    return out.select("cell", "forc", r6("resid_var"), r6("frac"))


@query("varexp_joint", "WITH k AS (SELECT cell, a.x AS b, r.x AS p FROM (SELECT * FROM d1 WHERE forc = 'A') a JOIN (SELECT * FROM d1 WHERE forc = 'R') r USING (cell, m)) SELECT cell, round(1 - var_pop(b - p) / nullif(var_pop(b), 0), 6) AS varexp, count(*) AS n FROM k GROUP BY 1")
def varexp_joint(spark, d):
    f = forcing(spark, d)
    rows = f.where("forc = 'A'").select("cell", "m", F.col("x").alias("b")).join(f.where("forc = 'R'").select("cell", "m", F.col("x").alias("p")), ["cell", "m"], "full")
    return S.variance_explained(rows, ["cell"], "b", "p").select("cell", r6("varexp"), "n")


@query("varexp_allforc", "WITH k AS (SELECT m, sum(anom) AS y FROM an GROUP BY 1), t AS (SELECT m, x - avg(x) OVER (PARTITION BY m % 12) AS b FROM d2t) SELECT m % 12 AS month, round(avg((b - y) * (b - y)), 6) AS resid, round(1 - avg((b - y) * (b - y)) / nullif(avg(b * b), 0), 6) AS frac FROM t JOIN k USING (m) GROUP BY 1")
def varexp_allforc(spark, d):
    y = S.anomaly(forcing(spark, d), ["cell", "forc", F.col("m") % 12]).groupBy("m").agg(F.sum("anom").alias("y"))
    rows = S.anomaly(total(spark, d), [F.col("m") % 12], out="b").join(y, "m").withColumn("r", F.col("b") - F.col("y"))
    out = rows.groupBy((F.col("m") % 12).alias("month")).agg(F.avg(F.col("r") * F.col("r")).alias("resid"), F.avg(F.col("b") * F.col("b")).alias("v"))
    return out.select("month", r6("resid"), rnd(1 - F.try_divide(F.col("resid"), F.col("v")), 6).alias("frac"))


@query("varexp_pooled", "WITH k AS (SELECT forc, m % 12 AS month, d2t.x AS b, s.x AS p FROM (SELECT forc, m, sum(x) AS x FROM d1 GROUP BY 1, 2) s JOIN d2t USING (m)), g AS (SELECT forc, month, count(*) AS n, var_pop(b - p) AS r, var_pop(b) AS v FROM k GROUP BY 1, 2) SELECT forc, round(1 - sum(n * r) / nullif(sum(n * v), 0), 6) AS varexp, CAST(sum(n) AS BIGINT) AS n FROM g GROUP BY 1")
def varexp_pooled(spark, d):
    rows = forcing(spark, d).groupBy("forc", "m").agg(F.sum("x").alias("p")).join(total(spark, d).withColumnRenamed("x", "b"), "m")
    return S.pooled(rows.withColumn("month", F.col("m") % 12), ["forc"], ["month"], "b", "p").select("forc", r6("varexp"), "n")


@query("varexp_by_month", "WITH k AS (SELECT region, m, sum(x) AS p FROM d1 JOIN reg USING (cell) GROUP BY 1, 2) SELECT region, m % 12 AS month, round(1 - var_pop(d2t.x - p) / nullif(var_pop(d2t.x), 0), 6) AS varexp, count(*) AS n FROM k JOIN d2t USING (m) GROUP BY 1, 2")
def varexp_by_month(spark, d):
    rows = forcing(spark, d).join(region_of(spark, d), "cell").groupBy("region", "m").agg(F.sum("x").alias("p")).join(total(spark, d), "m")
    return S.variance_explained(rows.withColumn("month", F.col("m") % 12), ["region", "month"], "x", "p").select("region", "month", r6("varexp"), "n")


@query("varexp_per_area", "WITH k AS (SELECT cell, d2t.x AS b, s.x AS p FROM (SELECT cell, m, sum(x) AS x FROM d1 GROUP BY 1, 2) s JOIN d2t USING (m)), a AS (SELECT nation AS cell, sum(area) AS area FROM ce GROUP BY 1) SELECT cell, round((1 - var_pop(b - p) / nullif(var_pop(b), 0)) / max(area), 6) AS per_area FROM k JOIN a USING (cell) GROUP BY 1")
def varexp_per_area(spark, d):
    rows = forcing(spark, d).groupBy("cell", "m").agg(F.sum("x").alias("p")).join(total(spark, d), "m")
    area = cells(spark, d).groupBy(F.col("nation").alias("cell")).agg(F.sum("area").alias("area"))
    out = S.variance_explained(rows, ["cell"], "x", "p").join(area, "cell")
    return out.select("cell", rnd(F.col("varexp") / F.col("area"), 6).alias("per_area"))


@query("area_weighted_mean", "WITH k AS (SELECT nation, area, CASE WHEN wet = 1 THEN lat END AS x FROM ce) SELECT nation, round(sum(area * x) / nullif(sum(CASE WHEN x IS NOT NULL THEN area END), 0), 6) AS valid_mean, round(sum(area * x) / nullif(sum(area), 0), 6) AS whole_mean FROM k GROUP BY 1")
def area_weighted_mean(spark, d):
    rows = cells(spark, d).withColumn("x", F.when(F.col("wet") == 1, F.col("lat")))
    a = S.weighted_mean(rows, ["nation"], "area").select("nation", rnd("mean", 6).alias("valid_mean"))
    return a.join(S.weighted_mean(rows, ["nation"], "area", over_all=True).select("nation", rnd("mean", 6).alias("whole_mean")), "nation")


@query("rel_to_global_mean", "WITH k AS (SELECT m, sum(x * (cell + 1)) / sum(cell + 1) AS g FROM d1 GROUP BY 1) SELECT cell, forc, m, round(x - g, 6) AS rel FROM d1 JOIN k USING (m)")
def rel_to_global_mean(spark, d):
    rows = forcing(spark, d).withColumn("area", F.col("cell") + 1)
    return S.relative_to(rows, S.weighted_mean(rows, ["m"], "area"), ["m"]).select("cell", "forc", "m", rnd("rel", 6).alias("rel"))


@query("rebase_mean", f"SELECT series, m, round(x - avg(CASE WHEN m >= {FIRST} AND m < {LAST} THEN x END) OVER (PARTITION BY series), 6) AS rebased FROM d2")
def rebase_mean(spark, d):
    return S.rebased(reference(spark, d), ["series"], "m", FIRST, LAST).select("series", "m", r6("rebased"))


@query("level_from_surface", "WITH k AS (SELECT m, sum(CASE WHEN forc = 'A' THEN x END) AS a, sum(CASE WHEN forc = 'N' THEN x END) AS n, sum(CASE WHEN forc = 'R' THEN x END) AS r, avg(CASE WHEN forc = 'A' THEN x END) AS ga, avg(CASE WHEN forc = 'N' THEN x END) AS gn, avg(CASE WHEN forc = 'R' THEN x END) AS gr FROM d1 GROUP BY 1) SELECT m, round(a + n - r - (ga + gn - gr), 6) AS x FROM k")
def level_from_surface(spark, d):
    """A model's level from its surface, another model's level and surface, and the global means of all three."""
    f = forcing(spark, d)
    of = lambda how, code, name: how(F.when(F.col("forc") == code, F.col("x"))).alias(name)
    surface, other = f.groupBy("m").agg(of(F.sum, "A", "eta")), f.groupBy("m").agg(of(F.sum, "N", "ssh"), of(F.sum, "R", "eta"))
    world = f.groupBy("m").agg(of(F.avg, "A", "eta"), of(F.avg, "N", "other_ssh"), of(F.avg, "R", "other_eta"))
    return references.level_from_surface(surface, other, world).select("m", r6("x"))


@query("ensemble_mean", "SELECT label, p, round(avg(x), 6) AS mean, count(x) AS n FROM ar GROUP BY 1, 2")
def ensemble_mean(spark, d):
    return S.masked_mean(arrays(spark, d), ["label", "p"]).select("label", "p", r6("mean"), "n")
