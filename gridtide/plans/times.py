"""Resampling, lattices, time joins and leads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide.functions import calendar as C
from gridtide.operators import alignment as L
from gridtide.operators import resample as R
from gridtide.operators import timejoin as J
from gridtide.plans.base import events, forcing, forecast, query, r6, rnd, reference, table, total
from gridtide.sources import tables


@query("daily_mean", "SELECT type, CAST(floor((s - 1800) / 86400.0) AS BIGINT) AS day, round(avg(value), 6) AS mean, count(value) AS n FROM ev GROUP BY 1, 2")
def daily_mean(spark, d):
    return R.daily_mean(events(spark, d), ["type"], value="value").select("type", "day", r6("mean"), "n")


@query("weekly_mean", "SELECT type, s - (s - 694224000) % 604800 AS week, round(avg(value), 6) AS mean, count(value) AS n, s - (s - 694224000) % 604800 + 302400 AS middle FROM ev GROUP BY 1, 2, 5")
def weekly_mean(spark, d):
    return R.weekly_mean(events(spark, d), ["type"], value="value").select("type", "week", r6("mean"), "n", "middle")


@query("version_select", "WITH k AS (SELECT s // 3600 AS hour, type, count(value) AS n FROM ev GROUP BY 1, 2), b AS (SELECT hour, type FROM k QUALIFY row_number() OVER (PARTITION BY hour ORDER BY n DESC, type) = 1) SELECT hour, type, round(avg(value), 6) AS mean, count(*) AS n FROM (SELECT *, s // 3600 AS hour FROM ev) JOIN b USING (hour, type) GROUP BY 1, 2")
def version_select(spark, d):
    rows = events(spark, d).withColumn("hour", F.expr("s div 3600"))
    order = rows.select("type").distinct().withColumn("ver", F.row_number().over(Window.orderBy("type")))  # a handful of types
    best = R.best_version(rows.join(F.broadcast(order), "type"), ["hour"], "ver", "value")
    return best.groupBy("hour", "type").agg(rnd(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))


@query("union_versions", "SELECT src, type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT 'even' AS src, type, value FROM ev WHERE event_id % 2 = 0 UNION ALL SELECT 'odd', type, NULL FROM ev WHERE event_id % 2 = 1) GROUP BY 1, 2")
def union_versions(spark, d):
    e = events(spark, d)
    even = e.where("event_id % 2 = 0").select(F.lit("even").alias("src"), "type", "value")
    odd = e.where("event_id % 2 = 1").select(F.lit("odd").alias("src"), "type")
    return even.unionByName(odd, allowMissingColumns=True).groupBy("src", "type").agg(F.count("*").alias("n"), rnd(F.sum("value"), 4).alias("total"))


@query("time_window_pad", "SELECT event_id, s FROM ev WHERE s >= 1705276800 - 2 * 86400 AND s < 1705708800")
def time_window_pad(spark, d):
    return R.time_window(events(spark, d), "s", 1705276800, 1705708800, 2 * 86400).select("event_id", "s")


@query("snap_midmonth", "WITH k AS (SELECT DISTINCT m FROM d2), b AS (SELECT m, CAST(epoch(make_date(((m - 1) // 12), ((m - 1) % 12 + 1), 1)) AS BIGINT) AS a, CAST(epoch(make_date((m // 12), (m % 12 + 1), 1)) AS BIGINT) AS z FROM k) SELECT m, (a + z) // 2 AS middle FROM b")
def snap_midmonth(spark, d):
    months = reference(spark, d).select("m").distinct()
    middle = months.select("m", C.month_middle(F.col("m")).alias("middle"))
    # stamps half a day off are put on the nearest middle again
    off = middle.select("m", (F.col("middle") + 43200).alias("s"))
    return J.nearest(off, middle.select(F.col("m").alias("at"), F.col("middle").alias("t")), [], "s", "t", ["m"], "at", 3 * 86400).select("m", F.col("t").cast("long").alias("middle"))


@query("week_lattice", "WITH o AS (SELECT CAST(floor(epoch(o_orderdate)) AS BIGINT) AS s, year(o_orderdate) AS yr FROM orders), sp AS (SELECT (min(s) - 694224000) // 604800 - 1 AS a, (max(s) - 694224000) // 604800 + 1 AS z FROM o), w AS (SELECT 694224000 + unnest(range(a, z + 1)) * 604800 AS s FROM sp), b AS (SELECT yr, k, CAST(epoch(make_date(yr, 1, 1)) AS BIGINT) + k * 604800 + 302400 AS c FROM (SELECT DISTINCT yr FROM o), unnest(range(0, 52)) AS u(k)) SELECT CAST(yr AS BIGINT) AS yr, CAST(k AS BIGINT) AS k, s FROM b, w QUALIFY row_number() OVER (PARTITION BY yr, k ORDER BY abs(s - c), s) = 1")
def week_lattice(spark, d):
    """The lattice's weeks over the time of the orders, and the one nearest to each week of the years that have orders."""
    o = table(spark, d, "orders").select(C.seconds("o_orderdate").alias("s"), F.year("o_orderdate").cast("long").alias("yr"))
    week = lambda x: C.LATTICE + (x - C.LATTICE) // C.WEEK * C.WEEK
    first, last = o.agg(F.min("s"), F.max("s")).first()
    weeks = J.lattice(week(first) - C.WEEK, week(last) + C.WEEK, C.WEEK, spark)
    bins = o.select("yr").distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(51).cast("long"))))
    bins = bins.withColumn("c", C.month_start_day(F.col("yr") * 12 + 1) * 86400 + F.col("k") * C.WEEK + 302400)
    return J.nearest(bins, weeks.withColumn("t", F.col("s")), [], "c", "t", ["yr", "k"], "s").select("yr", "k", "s")


_N = 55  # steps of a month's sensitivity
_YEARS = [1999, 2000, 2001]
_JAN = "CAST(epoch(make_date({y}, 1, 1)) AS BIGINT)"


@query(
    "align_steps",
    f"WITH st AS (SELECT CAST(month(l_shipdate) AS INTEGER) AS month, CAST(l_suppkey % {_N} AS INTEGER) AS step, {_JAN.format(y=2008)} + month(l_shipdate) * 2629728 - ({_N - 1} - l_suppkey % {_N}) * 604800 + min(l_orderkey) % 86400 AS s FROM lineitem GROUP BY month(l_shipdate), l_suppkey % {_N}), "
    f"bi AS (SELECT k, {_JAN.format(y=2004)} + k * 604800 + 302400 AS c FROM range(0, 52) t(k)), "
    "nb AS (SELECT month, step, k AS bin FROM (SELECT *, (s - c) - 31556736.0 * floor((s - c) / 31556736.0) AS g FROM st, bi) QUALIFY row_number() OVER (PARTITION BY month, step ORDER BY least(g, 31556736.0 - g), k) = 1), "
    f"la AS (SELECT unnest(range(694224000 + 302400 + CAST(round_even(({_JAN.format(y=_YEARS[0] - 1)} - 694224000) / 604800.0, 0) AS BIGINT) * 604800, {_JAN.format(y=_YEARS[-1] + 1)}, 604800)) AS t), "
    f"ce_ AS (SELECT y, k, {_JAN.format(y='CAST(y AS BIGINT)')} + k * 604800 + 302400 AS c FROM range({_YEARS[0] - 1}, {_YEARS[-1] + 2}) v(y), range(0, 52) u(k)), "
    "ne AS (SELECT y, k, t FROM ce_, la QUALIFY row_number() OVER (PARTITION BY y, k ORDER BY abs(t - c), t) = 1), "
    f"gp AS (SELECT a.y, a.t - b.t > 907200 AS gap FROM ne a JOIN ne b ON a.k = 0 AND b.k = 51 AND b.y = a.y - 1) "
    f"SELECT month, step, CAST(gp.y AS INTEGER) AS year, CAST(bin AS INTEGER) AS bin, ne.t + CASE WHEN bin >= step AND gap THEN 604800 ELSE 0 END AS s FROM nb JOIN gp ON gp.y BETWEEN {_YEARS[0]} AND {_YEARS[-1]} JOIN ne ON ne.k = bin AND ne.y = gp.y + CASE WHEN bin >= step THEN -1 WHEN bin < step - {_N - 5} THEN 1 ELSE 0 END",
)
def align_steps(spark, d):
    """The forcing week of each step of each month's sensitivity, in three years; times within a week from the shipments."""
    jan = F.lit(1199145600).cast("long")  # 2008-01-01
    month, step = F.month("l_shipdate").cast("int"), (F.col("l_suppkey") % _N).cast("int")
    rows = table(spark, d, "lineitem").groupBy(month.alias("month"), step.alias("step")).agg((F.min("l_orderkey") % 86400).alias("off"))
    rows = rows.select("month", "step", (jan + F.col("month") * 2629728 - (_N - 1 - F.col("step")) * C.WEEK + F.col("off")).alias("s"), F.lit(_N).alias("n"))
    return L.aligned(rows, _YEARS)


_PARTS = "a AS (SELECT event_id, type, value FROM ev WHERE event_id % 3 <> 0), b AS (SELECT event_id, type, value + 0.5 AS value FROM ev WHERE event_id % 3 <> 1)"


@query("multi_file_merge", f"WITH {_PARTS} SELECT event_id, type, round(value, 6) AS value FROM a UNION ALL SELECT event_id, type, round(value, 6) FROM b WHERE event_id NOT IN (SELECT event_id FROM a)")
def multi_file_merge(spark, d):
    """Two files that overlap in a third of the events: the first one's rows override the other's."""
    e = events(spark, d).select("event_id", "type", "value")
    parts = [e.where("event_id % 3 <> 0").withColumn("path", F.lit("2024a")), e.where("event_id % 3 <> 1").select("event_id", "type", (F.col("value") + 0.5).alias("value"), F.lit("2024b").alias("path"))]
    return tables.merged(parts[0].unionByName(parts[1]), ["event_id"]).select("event_id", "type", r6("value"))


@query("circular_nearest", "WITH b AS (SELECT CAST(k AS BIGINT) AS k, (k + 0.5) * 365.24 / 52 AS c FROM unnest(range(0, 52)) AS u(k)), e AS (SELECT event_id, s / 86400.0 AS day FROM ev), p AS (SELECT event_id, k, least(fmod(day - c, 365.24), 365.24 - fmod(day - c, 365.24)) AS g FROM e, b) SELECT event_id, k, round(g, 4) AS distance FROM p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY g, k) = 1")
def circular_nearest(spark, d):
    bins = spark.range(52).select(F.col("id").alias("k"), ((F.col("id") + 0.5) * C.YEAR_DAYS / 52).alias("c"))
    rows = events(spark, d).select("event_id", (F.col("s") / 86400.0).alias("day"))
    return J.circular_nearest(rows, bins, "day", "c", "k", ["event_id"], C.YEAR_DAYS).select("event_id", "k", r6("distance", 4))


@query("lead_snap", "SELECT event_id, round_even((s - 3600.0 * (event_id % 50) - 60 - 694224000 - 302400) / 604800, 0) * 604800 + 694224000 + 302400 AS snapped FROM ev")
def lead_snap(spark, d):
    at = F.col("s") - 3600.0 * (F.col("event_id") % 50) - 60
    return J.snapped(events(spark, d), at, C.LATTICE + 302400, C.WEEK, "snapped").select("event_id", "snapped")


_PAIRS = "WITH p AS (SELECT event_id, user_id, s FROM ev WHERE type = 'purchase'), c AS (SELECT event_id AS click, user_id, s AS cs FROM ev WHERE type = 'click')"


def _sides(spark, d):
    e = events(spark, d)
    return e.where("type = 'purchase'").select("event_id", "user_id", "s"), e.where("type = 'click'").select(F.col("event_id").alias("click"), "user_id", F.col("s").alias("cs"))


@query("tolerance_join_unique", f"{_PAIRS}, k AS (SELECT event_id, click, cs - s AS delta, count(*) OVER (PARTITION BY event_id) AS n FROM p JOIN c USING (user_id) WHERE abs(cs - s) < 10800) SELECT event_id, click, delta FROM k WHERE n = 1")
def tolerance_join_unique(spark, d):
    p, c = _sides(spark, d)
    return J.unique_within(p, c, ["user_id"], "s", "cs", 10800, ["event_id"]).select("event_id", "click", "delta")


@query("nearest_join", f"{_PAIRS} SELECT event_id, click, cs - s AS delta FROM p JOIN c USING (user_id) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(cs - s), cs, click) = 1")
def nearest_join(spark, d):
    p, c = _sides(spark, d)
    out = J.nearest(p, c, ["user_id"], "s", "cs", ["event_id"], "click").where("click is not null")
    return out.select("event_id", "click", (F.col("cs") - F.col("s")).cast("long").alias("delta"))


@query("month_join", "SELECT cell, forc, series, m, round(d1.x * d2.x, 6) AS product FROM d1 JOIN d2 USING (m)")
def month_join(spark, d):
    return forcing(spark, d).join(reference(spark, d).withColumnRenamed("x", "y"), "m").select("cell", "forc", "series", "m", rnd(F.col("x") * F.col("y"), 6).alias("product"))


@query("align_dedupe", "WITH k AS (SELECT *, lead(s) OVER (PARTITION BY user_id ORDER BY s, event_id) AS nxt FROM ev) SELECT event_id FROM k WHERE nxt IS NULL OR abs(nxt - s) >= 3600")
def align_dedupe(spark, d):
    rows = events(spark, d).withColumn("o", F.struct("s", "event_id"))
    return J.drop_repeats(rows, ["user_id"], "o", "s", 3600).select("event_id")


@query("ref_sort_month", "WITH k AS (SELECT series, (m - 1) % 12 + 1 AS month, (m - 1) // 12 AS year, x - avg(x) OVER (PARTITION BY series, m % 12) AS y FROM d2) SELECT series, month, year, round(y, 6) AS y FROM k")
def ref_sort_month(spark, d):
    from gridtide.operators.stats import anomaly

    target = reference(spark, d).select("series", "m").withColumn("t", C.month_middle(F.col("m")))
    found = reference(spark, d).withColumn("at", C.month_start_day(F.col("m")) * 86400 + 14 * 86400)
    near = J.nearest(target, found.select("series", "x", "at"), ["series"], "t", "at", ["m"], "x", 10 * 86400)
    out = near.withColumns({"month": (F.col("m") - 1) % 12 + 1, "year": F.expr("(m - 1) div 12")})
    return anomaly(out, ["series", "month"], out="y").select("series", "month", "year", r6("y"))


@query("remove_global_monthly", "WITH g AS (SELECT m, avg(x) AS mean FROM d1 GROUP BY 1) SELECT series, m, round(x - mean, 6) AS rest FROM d2 JOIN g USING (m)")
def remove_global_monthly(spark, d):
    return R.monthly_removed(reference(spark, d), forcing(spark, d)).select("series", "m", r6("rest"))


@query("lead_number", "WITH k AS (SELECT DISTINCT cell, pred, init, pred - init AS lead FROM fc), s AS (SELECT cell, (max(init) - min(init)) / (count(DISTINCT init) - 1) AS spacing FROM k GROUP BY 1), l AS (SELECT *, min(lead) OVER (PARTITION BY cell, pred) AS least FROM k JOIN s USING (cell)) SELECT cell, pred, init, CAST(round_even((lead - least) / spacing, 0) + floor(least / spacing) AS BIGINT) AS lead_num FROM l")
def lead_number(spark, d):
    rows = forecast(spark, d).withColumn("lead", F.col("pred") - F.col("init"))
    rows = rows.join(J.spacing(rows, ["cell"], "init"), "cell")
    return J.lead_numbers(rows, ["cell", "pred"], "lead", "spacing").select("cell", "pred", "init", "lead_num")


@query("latest_init", "SELECT cell, pred, max(CASE WHEN init <= pred - 2 THEN init END) AS latest FROM fc GROUP BY 1, 2")
def latest_init(spark, d):
    rows = forecast(spark, d).withColumn("most", F.col("pred") - 2)
    return J.latest_before(rows, ["cell", "pred"], "init", "most")


@query("init_any_in_window", "SELECT cell, init, pred, round(x, 6) AS x FROM fc WHERE (cell, init) IN (SELECT (cell, init) FROM fc WHERE pred >= 23953 AND pred < 23955)")
def init_any_in_window(spark, d):
    rows = forecast(spark, d)
    return J.any_in_window(rows, ["cell", "init"], (F.col("pred") >= 23953) & (F.col("pred") < 23955)).select("cell", "init", "pred", r6("x"))


@query("lead_range_mean", "SELECT cell, pred, round(avg(CASE WHEN pred - init >= 1 AND pred - init < 4 THEN x END), 6) AS mean FROM fc GROUP BY 1, 2")
def lead_range_mean(spark, d):
    lead = F.col("pred") - F.col("init")
    return forecast(spark, d).groupBy("cell", "pred").agg(rnd(F.avg(F.when((lead >= 1) & (lead < 4), F.col("x"))), 6).alias("mean"))


@query("accum_to_rate", "SELECT event_id, round(1000 * value / CASE WHEN (event_id % 20) * 86400 < 604800 THEN (event_id % 20) * 86400 + 302400 ELSE 604800 END, 9) AS rate FROM ev")
def accum_to_rate(spark, d):
    rows = events(spark, d).withColumns({"lead": (F.col("event_id") % 20) * 86400, "x": 1000 * F.col("value")})
    return R.accumulated_to_rate(rows, "lead").select("event_id", rnd("rate", 9).alias("rate"))


@query("filename_parse", "SELECT m, lpad(CAST((m - 1) % 12 + 1 AS VARCHAR), 2, '0') AS mm, CAST(substr(name, 10, 6) AS INTEGER) AS yyyymm FROM (SELECT DISTINCT m, 'run.SSH.' || '.' || CAST(((m - 1) // 12) * 100 + (m - 1) % 12 + 1 AS VARCHAR) || '01.nc' AS name FROM d2)")
def filename_parse(spark, d):
    rows = total(spark, d).select("m", F.concat(F.lit("run.SSH.."), F.expr("cast((m - 1) div 12 * 100 + (m - 1) % 12 + 1 as string)"), F.lit("01.nc")).alias("name"))
    part = F.substring(F.element_at(F.split("name", r"\."), -2), 1, 6)
    return rows.select("m", F.lpad(F.expr("cast((m - 1) % 12 + 1 as string)"), 2, "0").alias("mm"), part.cast("int").alias("yyyymm"))
