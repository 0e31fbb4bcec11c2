"""Filters, interpolation, harmonics and correlations of single series."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import functions as F

from gridtide.functions.calendar import month_middle, month_start_day
from gridtide.functions.special import band_kernel, erfinv
from gridtide.operators import attribution as A
from gridtide.operators import filters as X
from gridtide.operators import references as B
from gridtide.operators import resample as R
from gridtide.operators import stats as S
from gridtide.plans.attribution import impacts
from gridtide.plans.base import arrays, cells, events, forcing, query, r6, reference, region_of, rnd, table, total
from gridtide.sources import series as P

N = 64
BAND = {"delta": 1.0, "low": 1 / 24, "high": 1 / 6, "steep": 5.0}
LOW12 = {"delta": 1.0, "low": 0.0, "high": 1 / 12, "steep": 2.0, "keep_trend": True}
LOW30 = {"delta": 1.0, "low": 0.0, "high": 1 / 30, "steep": 2.0, "keep_trend": True}


def kernel(band: dict) -> str:
    """The kernel as rows (k, h) of a VALUES list."""
    own = {k: v for k, v in band.items() if k != "keep_trend"}
    return "VALUES " + ", ".join(f"({k}, {h:.17e})" for k, h in enumerate(band_kernel(2 * N, **own)))


def _erf(z: str) -> str:
    """The error function of a column z >= 0, by its series of positive terms from the last one inwards."""
    t, inner = f"(2 * least({z}, 6) * least({z}, 6))", "1"
    for k in range(110, 0, -1):
        inner = f"(1 + {t} / {2 * k + 1} * {inner})"
    return f"(CASE WHEN {z} > 6 THEN 1 ELSE 2 / sqrt(pi()) * exp(-{z} * {z}) * {z} * {inner} END)"


def _filter(name: str, band: dict, source: str = "ar", keys: str = "vec_id", p: str = "p", x: str = "x", places: str | None = None) -> str:
    """The steps of filters.filter_bank for series without gaps, of N values or as many as the expression ``places`` says."""
    if places is None:
        size, near = f"nn_{name} AS (SELECT {N} AS n, {X.averaged_points(N, band['delta'], band['low'], band['high'])} AS near)", None
        h = f"h_{name}(k, h) AS ({kernel(band)})"
    else:
        d, low, high = band["delta"], band["low"], band["high"]
        size = f"nn_{name} AS (SELECT n, round_even(0.125 / sqrt(greatest({low!r}, 1 / (n * {d})) * least({high!r}, 1 / (2 * {d}))) / {d}, 0) AS near FROM ({places}))"
        a = math.exp(erfinv(math.sqrt(2) - 1) / band["steep"])
        lower = f"({band['steep']} * (ln(f) - {math.log(low / a):.17e}))" if low else None
        upper = f"({band['steep']} * (ln(f) - {math.log(high * a):.17e}))"
        zs = f"abs({upper}) AS zu, sign({upper}) AS su" + (f", abs({lower}) AS zl, sign({lower}) AS sl" if lower else "")
        h = (
            f"w_{name} AS MATERIALIZED (SELECT i, n, 0.5 * ({'sl * ' + _erf('zl') if lower else '1'} - su * {_erf('zu')}) AS w FROM (SELECT i, n, {zs} FROM (SELECT i, n, least(i, 2 * n - i) / (2.0 * n * {d}) AS f FROM nn_{name}, unnest(range(1, CAST(2 * n AS BIGINT))) AS u(i)))), "
            f"h_{name} AS MATERIALIZED (SELECT k, sum(w * cos(2 * pi() * i * k / (2 * n))) / (2 * any_value(n)) AS h FROM w_{name}, (SELECT unnest(range(0, CAST(2 * n AS BIGINT))) AS k FROM nn_{name}) GROUP BY 1)"
        )
    back = "line + mean" if band.get("keep_trend") else "0"
    on = f"({keys})"
    return (
        f"{size}, {h}, "
        f"{name}_y AS MATERIALIZED (SELECT {keys}, {p} AS p, avg({x}) OVER w + regr_slope({x}, {p}) OVER w * ({p} - avg({p}) OVER w) AS line, {x} - (avg({x}) OVER w + regr_slope({x}, {p}) OVER w * ({p} - avg({p}) OVER w)) AS y FROM {source} WINDOW w AS (PARTITION BY {keys})), "
        f"{name}_a AS (SELECT {keys}, avg(y) FILTER (p < near) AS a1, avg(y) FILTER (p >= near AND p < 2 * near) AS a2, avg(y) FILTER (p > n - 1 - near) AS b1, avg(y) FILTER (p > n - 1 - 2 * near AND p <= n - 1 - near) AS b2, any_value(n) AS n, any_value(near) AS near FROM {name}_y, nn_{name} GROUP BY {keys}), "
        f"{name}_s AS (SELECT {keys}, n, n // 2 AS half, (a2 - a1) / near AS sa, a1 - (near - 1) / 2 * (a2 - a1) / near AS va, (b2 - b1) / near AS sb, b1 - (near - 1) / 2 * (b2 - b1) / near AS vb FROM {name}_a), "
        f"{name}_z AS MATERIALIZED (SELECT {keys}, q, va AS v, sqrt(pi()) / 2 * abs(sa / va) * (half - q) AS z FROM (SELECT *, unnest(range(0, CAST(half AS BIGINT))) AS q FROM {name}_s) UNION ALL SELECT {keys}, q, vb, sqrt(pi()) / 2 * abs(sb / vb) * (q - half - n + 1) FROM (SELECT *, unnest(range(CAST(half + n AS BIGINT), CAST(2 * n AS BIGINT))) AS q FROM {name}_s)), "
        f"{name}_v AS MATERIALIZED (SELECT {keys}, n // 2 + p AS q, y AS v FROM {name}_y, nn_{name} UNION ALL SELECT {keys}, q, v * (1 - {_erf('z')}) FROM {name}_z), "
        f"{name}_c AS (SELECT {keys}, (q + k) % (2 * n) - n // 2 AS p, sum(v * h) AS c FROM {name}_v, h_{name}, nn_{name} WHERE (q + k) % (2 * n) >= n // 2 AND (q + k) % (2 * n) < n // 2 + n GROUP BY ALL), "
        f"{name}_m AS (SELECT {keys}, avg(v) AS mean FROM {name}_v GROUP BY ALL), "
        f"{name} AS (SELECT {keys}, CAST(p AS INTEGER) AS p, c + {back} AS band FROM {name}_c JOIN {name}_y USING ({keys}, p) JOIN {name}_m USING {on})"
    )


def _bands(spark, d, **bands):
    """The vectors through one or more bands: they are arrays already, nothing is shuffled."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.sequence(F.lit(0), F.size("embedding") - 1).alias("p"), F.col("embedding").alias("x"))
    return X.filter_bank(rows, ["vec_id", "label"], "p", 1.0, {k: {c: v for c, v in b.items() if c != "delta"} for k, b in bands.items()})


@query("bandpass", f"WITH {_filter('b', BAND)} SELECT vec_id, p, round(band, 6) AS band FROM b")
def bandpass(spark, d):
    return _bands(spark, d, band=BAND).select("vec_id", "p", r6("band"))


@query("lowpass_12mo", f"WITH {_filter('b', LOW12)} SELECT vec_id, p, round(band, 6) AS low FROM b")
def lowpass_12mo(spark, d):
    return _bands(spark, d, low=LOW12).select("vec_id", "p", r6("low"))


@query("band_split", f"WITH {_filter('b', LOW12)}, {_filter('c', LOW30)} SELECT vec_id, p, round(x - b.band, 6) AS fast, round(b.band - c.band, 6) AS slow FROM ar JOIN b USING (vec_id, p) JOIN c USING (vec_id, p)")
def band_split(spark, d):
    """Both low-passes in one pass over the vectors."""
    low = _bands(spark, d, b=LOW12, c=LOW30)
    rows = low.join(arrays(spark, d).select("vec_id", "p", "x"), ["vec_id", "p"])
    return rows.select("vec_id", "p", rnd(F.col("x") - F.col("b")).alias("fast"), rnd(F.col("b") - F.col("c")).alias("slow"))


@query("band_stddev", f"WITH {_filter('b', BAND)} SELECT vec_id, round(stddev_pop(band), 6) AS sd FROM b GROUP BY 1")
def band_stddev(spark, d):
    return _bands(spark, d, band=BAND).groupBy("vec_id").agg(rnd(F.stddev_pop("band")).alias("sd"))


#: Names of the bands of the tables, in the order of their columns.
TABLE_BANDS = {"mid": BAND, "low": LOW12}
_SPAN = "sp AS (SELECT min(m) AS m0, max(m) AS m1 FROM d2t), mm AS (SELECT unnest(range(m0, m1 + 1)) AS m, m0 FROM sp)"
_PLACES = "SELECT m1 - m0 + 1 AS n FROM sp"


def _full(name: str, keys: str, source: str) -> str:
    """CTE name (keys, p, x): source (keys, m, x) with a row for each month of the reference, 0 where there is none."""
    return f"{name} AS MATERIALIZED (SELECT {keys}, m - m0 AS p, coalesce(x, 0) AS x FROM (SELECT DISTINCT {keys} FROM {source}) JOIN mm ON true LEFT JOIN {source} USING ({keys}, m))"


def _table_sql(source: str, keys: str, out: str = "") -> str:
    """Variance of the reference (d2t) that source (keys, m, x) explains, by band; t (keys, part, varexp, n)."""
    own = f"{source}, {_SPAN}, {_full('fu', keys, 'so')}, rf AS (SELECT 1 AS one, m - m0 AS p, x FROM d2t JOIN mm USING (m)), "
    parts, rows = [], []
    for name, band in TABLE_BANDS.items():
        parts += [_filter(f"{name}p", band, "fu", keys, places=_PLACES), _filter(f"{name}r", band, "rf", "one", places=_PLACES)]
        rows.append(f"SELECT '{name}' AS part, {keys}, 1 - var_pop(r.band - s.band) / nullif(var_pop(r.band), 0) AS varexp, count(*) AS n FROM {name}p s JOIN {name}r r ON r.p = s.p GROUP BY ALL")
    return f"WITH {own}{', '.join(parts)}, t AS ({' UNION ALL '.join(rows)}) "


def _explained(spark, d, rows, keys: list[str]):
    """(keys, part, varexp, n): the variance of the reference that series (keys, m, x) explain in each band.

    All series run over the months of the reference, a month without an impact has one of zero; all bands are taken in
    one pass over each.
    """
    ref = total(spark, d)
    span = ref.agg(F.min("m").cast("long").alias("first"), F.max("m").cast("long").alias("last"))
    bands = {k: {c: v for c, v in b.items() if c != "delta"} for k, b in TABLE_BANDS.items()}
    passed = lambda df, k: X.filter_bank(X.dense(df, k, "m", fill=0.0, span=span), k, "m", 1.0, bands, least=0.0)
    base = passed(ref.withColumn("k", F.lit(1)), ["k"]).select("m", *(F.col(b).alias(f"r_{b}") for b in bands))
    both = passed(rows, keys).join(F.broadcast(base), "m")  # a row a month of the reference
    both = both.select(*keys, F.explode(F.array(*(F.struct(F.lit(b).alias("part"), F.col(b).alias("_own"), F.col(f"r_{b}").alias("_ref")) for b in bands))).alias("_b")).select(*keys, "_b.*")
    return S.variance_explained(both, [*keys, "part"], "_ref", "_own")


_LEADS = "so AS MATERIALIZED (SELECT t.lead AS lead, m, sum(impact) AS x FROM imp JOIN (VALUES (CAST(0 AS BIGINT)), (1), (2), (3), (4), (5)) t(lead) ON lag >= t.lead GROUP BY 1, 2)"


def _leads(spark):
    return spark.createDataFrame([(k,) for k in range(6)], "lead long")


@query("varexp_by_lead_band", _table_sql(_LEADS, "lead") + "SELECT part, lead, round(varexp, 5) AS varexp, n FROM t")
def varexp_by_lead_band(spark, d):
    """Variance explained by lead and band."""
    rows = A.by_lead(impacts(spark, d), _leads(spark), ["m"]).select("m", "lead", F.col("predicted").alias("x"))
    return _explained(spark, d, rows, ["lead"]).select("part", "lead", r6("varexp", 5), "n")


@query("varexp_by_lead_forc_band", _table_sql("so AS MATERIALIZED (SELECT t.lead AS lead, coalesce(forc, 'all') AS forc, m, sum(impact) AS x FROM imp JOIN (VALUES (CAST(0 AS BIGINT)), (1), (2), (3), (4), (5)) t(lead) ON lag >= t.lead GROUP BY GROUPING SETS ((t.lead, forc, m), (t.lead, m)))", "lead, forc") + "SELECT part, lead, forc, round(varexp, 5) AS varexp, n FROM t")
def varexp_by_lead_forc_band(spark, d):
    """Variance explained by least lead, forcing and band, with all forcings together as a row of its own."""
    rows = A.by_lead(impacts(spark, d), _leads(spark), ["forc", "m"]).select("m", "lead", "forc", F.col("predicted").alias("x"))
    rows = rows.groupingSets([[F.col("lead"), F.col("forc"), F.col("m")], [F.col("lead"), F.col("m")]], "lead", "forc", "m").agg(F.sum("x").alias("x"))
    return _explained(spark, d, rows.withColumn("forc", F.coalesce("forc", F.lit("all"))), ["lead", "forc"]).select("part", "lead", "forc", r6("varexp", 5), "n")


@query("varexp_by_region_forc_band", _table_sql("so AS MATERIALIZED (SELECT coalesce(region, -1) AS region, coalesce(forc, 'all') AS forc, m, sum(impact) AS x FROM imp JOIN reg USING (cell) GROUP BY GROUPING SETS ((region, forc, m), (region, m), (forc, m), (m)))", "region, forc") + "SELECT part, region, forc, round(varexp, 5) AS varexp, n FROM t")
def varexp_by_region_forc_band(spark, d):
    """Variance explained by region, forcing and band; -1 is the full ocean, all stands for all forcings."""
    sets = [["region", "forc", "m"], ["region", "m"], ["forc", "m"], ["m"]]
    rows = impacts(spark, d).join(region_of(spark, d), "cell")
    rows = rows.groupingSets([[F.col(c) for c in s] for s in sets], "region", "forc", "m").agg(F.sum("impact").alias("x"))
    rows = rows.withColumns({"region": F.coalesce("region", F.lit(-1)), "forc": F.coalesce("forc", F.lit("all"))})
    return _explained(spark, d, rows, ["region", "forc"]).select("part", "region", "forc", r6("varexp", 5), "n")


@query(
    "varexp_cell_band",
    _table_sql("so AS MATERIALIZED (SELECT own, coalesce(cell, -1) AS cell, m, sum(x) AS x FROM (SELECT 'base' AS own, cell, m, sum(impact) AS x FROM imp GROUP BY ALL UNION ALL SELECT 'more', cell, m, sum(impact) FROM imp WHERE forc <> 'N' GROUP BY ALL) GROUP BY GROUPING SETS ((own, cell, m), (own, m)))", "own, cell")
    + ", ca AS (SELECT nation AS cell, sum(area) AS area FROM ce GROUP BY 1), v AS (SELECT b.part, b.cell, CASE WHEN b.cell >= 0 AND reg.region = 0 THEN coalesce(o.varexp, b.varexp) ELSE b.varexp END AS varexp FROM t b LEFT JOIN t o ON o.own = 'more' AND o.cell = b.cell AND o.part = b.part LEFT JOIN reg ON reg.cell = b.cell WHERE b.own = 'base') SELECT part, cell, round(varexp, 5) AS varexp, round(varexp / area, 6) AS per_area FROM v LEFT JOIN ca USING (cell)",
)
def varexp_cell_band(spark, d):
    """Variance explained by cell and band, with that of a supplementary run for the cells of one region, for each unit of
    area, and -1 for all cells together."""
    imp = impacts(spark, d)
    own = [imp.withColumn("own", F.lit("base")), imp.where("forc <> 'N'").withColumn("own", F.lit("more"))]
    rows = own[0].unionByName(own[1]).groupingSets([[F.col("own"), F.col("cell"), F.col("m")], [F.col("own"), F.col("m")]], "own", "cell", "m").agg(F.sum("impact").alias("x"))
    t = _explained(spark, d, rows.withColumn("cell", F.coalesce("cell", F.lit(-1))), ["own", "cell"])
    base = t.where("own = 'base'").join(region_of(spark, d), "cell", "left")
    out = A.overridden(base, t.where("own = 'more'"), ["cell", "part"], "varexp", only=F.col("region") == 0)
    area = cells(spark, d).groupBy(F.col("nation").alias("cell")).agg(F.sum("area").alias("area"))
    return out.join(area, "cell", "left").select("part", "cell", r6("varexp", 5), rnd(F.col("varexp") / F.col("area")).alias("per_area"))


_LABEL = "lm AS (SELECT label, p, avg(x) AS x FROM ar GROUP BY 1, 2)"


def _by_label(spark, d):
    return arrays(spark, d).groupBy("label", "p").agg(F.avg("x").alias("x"))


@query("varexp_by_region_band", f"WITH {_LABEL}, {_filter('b', BAND, 'lm', 'label')}, {_filter('c', LOW12, 'lm', 'label')}, u AS (SELECT 'mid' AS part, * FROM b UNION ALL SELECT 'low', * FROM c), t AS (SELECT part, p, avg(band) AS base FROM u GROUP BY 1, 2), v AS (SELECT part, label, p, band FROM u UNION ALL SELECT part, -1, p, sum(band) FROM u GROUP BY ALL) SELECT part, label, round(1 - var_pop(base - band) / nullif(var_pop(base), 0), 5) AS varexp, count(*) AS n FROM v JOIN t USING (part, p) GROUP BY 1, 2")
def varexp_by_region_band(spark, d):
    """Both bands, and -1 for the sum over all regions."""
    both = X.filter_bank(X.series_arrays(_by_label(spark, d), ["label"], "p"), ["label"], "p", 1.0, {k: {c: v for c, v in b.items() if c != "delta"} for k, b in TABLE_BANDS.items()})
    rows = both.select("label", "p", F.explode(F.array(*(F.struct(F.lit(b).alias("part"), F.col(b).alias("band")) for b in TABLE_BANDS))).alias("_b")).select("label", "p", "_b.*")
    means = rows.groupBy("part", "p").agg(F.avg("band").alias("base"), F.sum("band").alias("sum"))
    each = rows.join(means, ["part", "p"]).select("part", "label", "p", "band", "base").unionByName(means.select("part", F.lit(-1).alias("label"), "p", F.col("sum").alias("band"), "base"))
    return S.variance_explained(each, ["part", "label"], "base", "band").select("part", "label", r6("varexp", 5), "n")


@query("corr_pairs_band", f"WITH {_LABEL}, {_filter('b', BAND, 'lm', 'label')}, {_filter('c', LOW12, 'lm', 'label')}, u AS (SELECT 'mid' AS part, * FROM b UNION ALL SELECT 'low', * FROM c) SELECT a.part, a.label AS la, c.label AS lb, round(corr(a.band, c.band), 5) AS r, count(*) AS n FROM u a JOIN u c ON a.part = c.part AND a.p = c.p AND a.label < c.label GROUP BY 1, 2, 3")
def corr_pairs_band(spark, d):
    """Correlations between all pairs of series in both bands."""
    both = X.filter_bank(X.series_arrays(_by_label(spark, d), ["label"], "p"), ["label"], "p", 1.0, {k: {c: v for c, v in b.items() if c != "delta"} for k, b in TABLE_BANDS.items()})
    rows = both.select("label", "p", F.explode(F.array(*(F.struct(F.lit(b).alias("part"), F.col(b).alias("band")) for b in TABLE_BANDS))).alias("_b")).select("label", "p", "_b.*")
    pairs = rows.select("part", F.col("label").alias("la"), "p", F.col("band").alias("a")).join(rows.select("part", F.col("label").alias("lb"), "p", F.col("band").alias("b")), ["part", "p"]).where("la < lb")
    return pairs.groupBy("part", "la", "lb").agg(rnd(F.corr("a", "b"), 5).alias("r"), F.count("*").alias("n"))


def _scale_sql(source: str, value: str) -> str:
    """sc (vec_id, scale): the steps of filters.time_scale."""
    lags = X.lag_list(N)
    weights = X.lag_weights(lags)
    rows = ", ".join(f"({k}, {lag}, {weights[k][k]:.17e}, {weights[min(k + 1, len(lags) - 1)][k]:.17e})" for k, lag in enumerate(lags))
    return (
        f"l(k, lag, at_end, inside) AS (VALUES {rows}), "
        f"r AS (SELECT a.vec_id, k, any_value(at_end) AS at_end, any_value(inside) AS inside, corr(a.{value}, c.{value}) AS r FROM {source} a JOIN l ON true JOIN {source} c ON c.vec_id = a.vec_id AND c.p = a.p + lag GROUP BY 1, 2), "
        f"e AS (SELECT vec_id, coalesce(min(CASE WHEN r < 0 THEN k END), {len(lags) - 1}) AS stop FROM r GROUP BY 1), "
        "sc AS (SELECT vec_id, CASE WHEN any_value(stop) = 0 THEN 1 ELSE 1 + 2 * sum(r * CASE WHEN k = stop THEN at_end ELSE inside END) END AS scale FROM r JOIN e USING (vec_id) WHERE k <= stop GROUP BY 1)"
    )


def _edge_sql() -> str:
    low, high, delta = BAND["low"], BAND["high"], BAND["delta"]
    width = delta * high * (1 - math.sqrt(low / high)) ** 1.25
    q, mid = "(1 / (2 * scale))", f"({delta} * sqrt(1 / (2 * scale) * {low:.17e}))"
    margin = f"round_even(greatest(least((0.9 * {low:.17e} / {q} - 3.0 / 40) / {mid} + (0.45 - 1.8 * {low:.17e} / {q}) / {width:.17e}, 0.15 / {mid}), {0.3 / width:.17e}), 0)"
    return f"WITH {_filter('b', BAND)}, {_scale_sql('b_y', 'y')}, g AS (SELECT vec_id, {margin} AS edge FROM sc) SELECT vec_id, p, round(band, 6) AS band FROM b JOIN g USING (vec_id) WHERE p >= edge AND p <= {N - 1} - edge"


@query("bandpass_edge", _edge_sql())
def bandpass_edge(spark, d):
    return _bands(spark, d, band=BAND | {"mask_edges": True}).where("band is not null").select("vec_id", "p", r6("band"))


@query("valid_span", "WITH k AS (SELECT vec_id, p, CASE WHEN x > -0.1 THEN x END AS x FROM ar) SELECT vec_id, min(CASE WHEN x IS NOT NULL THEN p END) AS first, max(CASE WHEN x IS NOT NULL THEN p END) AS last, count(x) AS n FROM k GROUP BY 1".replace(" AS first", ' AS "first"').replace(" AS last", ' AS "last"'))
def valid_span(spark, d):
    return X.valid_span(arrays(spark, d).withColumn("x", F.when(F.col("x") > -0.1, F.col("x"))), ["vec_id"], "p")


@query("gap_interp", "WITH k AS (SELECT vec_id, p, CASE WHEN x > -0.05 THEN x END AS x FROM ar), g AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN p END IGNORE NULLS) OVER b AS pi, last_value(x IGNORE NULLS) OVER b AS pv, first_value(CASE WHEN x IS NOT NULL THEN p END IGNORE NULLS) OVER f AS ni, first_value(x IGNORE NULLS) OVER f AS nv FROM k WINDOW b AS (PARTITION BY vec_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY vec_id ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT vec_id, p, round(coalesce(x, pv + (p - pi) / nullif(ni - pi, 0) * (nv - pv)), 6) AS filled FROM g")
def gap_interp(spark, d):
    rows = arrays(spark, d).withColumn("x", F.when(F.col("x") > -0.05, F.col("x")))
    return X.gaps_filled(rows, ["vec_id"], "p").select("vec_id", "p", r6("filled"))


@query("linear_interp", "WITH e AS (SELECT type, s, avg(value) AS v FROM ev GROUP BY 1, 2), t AS (SELECT type, unnest(generate_series(1704067200 + 43200, 1706745600, 86400)) AS s FROM (SELECT DISTINCT type FROM ev)), a AS (SELECT t.type, t.s, e.s AS s0, e.v AS v0 FROM t ASOF LEFT JOIN e ON t.type = e.type AND t.s >= e.s), z AS (SELECT t.type, t.s, e.s AS s1, e.v AS v1 FROM t ASOF LEFT JOIN e ON t.type = e.type AND t.s <= e.s) SELECT type, s, round(CASE WHEN s1 = s0 THEN v0 ELSE v0 + (s - s0) / nullif(s1 - s0, 0) * (v1 - v0) END, 5) AS x FROM a JOIN z USING (type, s)")
def linear_interp(spark, d):
    e = events(spark, d)
    targets = e.select("type").distinct().withColumn("s", F.explode(F.sequence(F.lit(1704110400).cast("long"), F.lit(1706745600).cast("long"), F.lit(86400).cast("long"))))
    return X.interpolated(e.select("type", "s", F.col("value").alias("x")), targets, ["type"], "s", width=4 * 86400.0).select("type", "s", r6("x", 5))


@query("splice_offset", "WITH e AS (SELECT m, x FROM d2 WHERE series = '1-URGENT'), l AS (SELECT m, x FROM d2 WHERE series = '2-HIGH'), o AS (SELECT (SELECT avg(x) FROM l WHERE m >= 23988 AND m < 24000) - (SELECT avg(x) FROM e WHERE m >= 23988 AND m < 24000) AS off) SELECT m, round(x + off, 6) AS x FROM e, o WHERE m < 23988 UNION ALL SELECT m, round(x, 6) FROM l WHERE m >= 23988")
def splice_offset(spark, d):
    r = reference(spark, d)
    return S.spliced(r.where("series = '1-URGENT'"), r.where("series = '2-HIGH'"), "m", 23988, 24000).select("m", r6("x"))


def _harmonic_sql(n: int) -> str:
    names = [f"{c}{k}" for k in range(1, n + 1) for c in ("c", "s")]
    angle = "{f}(" + repr(2 * math.pi / 365.24) + "::DOUBLE * {k} * day)"
    cols = ", ".join(angle.format(f="cos" if c[0] == "c" else "sin", k=int(c[1:])) + f" AS {c}" for c in names)
    day = "date_diff('day', DATE '1970-01-01', make_date((m - 1) // 12, (m - 1) % 12 + 1, 1))"
    steps = [f"k0 AS (SELECT series, m, x, x AS r, {cols} FROM (SELECT *, {day} AS day FROM d2))"]
    todo = [*names, "r"]
    w = "OVER (PARTITION BY series)"
    steps.append(f"k1 AS (SELECT series, m, x, {', '.join(f'{c} - avg({c}) {w} AS {c}' for c in todo)} FROM k0)")
    for j, q in enumerate(names):
        new = ", ".join(f"{c} - coalesce(sum({c} * {q}) {w} / CASE WHEN sum({q} * {q}) {w} > 1e-9 THEN sum({q} * {q}) {w} END, 0) * {q} AS {c}" for c in todo[j + 1 :])
        steps.append(f"k{j + 2} AS (SELECT series, m, x, {new} FROM k{j + 1})")
    return f"WITH {', '.join(steps)} SELECT series, m, round(r, 5) AS anom, round(x - avg(x) {w} - r, 5) AS cycle FROM k{len(names) + 1}"


@query("seasonal_harmonics", _harmonic_sql(3).replace(" AS cycle", ' AS "cycle"'))
def seasonal_harmonics(spark, d):
    rows = reference(spark, d).withColumn("day", month_start_day(F.col("m")))
    return X.harmonics(rows, ["series"], "day", 3).select("series", "m", r6("anom", 5), r6("cycle", 5))


_ENDS = "(SELECT min(m) AS m0, max(m) AS m1 FROM d1)"
_FIRST, _LAST = 1996 * 12 + 1, 2000 * 12 + 1


@query(
    "endpoint_change",
    f"WITH sp AS {_ENDS}, mm AS (SELECT unnest(range(m0, m1 + 1)) AS m, m0 FROM sp), so AS MATERIALIZED (SELECT region, forc, m, sum(x) AS x FROM d1 JOIN reg USING (cell) GROUP BY 1, 2, 3), {_full('fu', 'region, forc', 'so')}, {_filter('b', LOW12, 'fu', 'region, forc', places=_PLACES)} SELECT region, forc, round(max(CASE WHEN p + m0 = {_LAST} THEN band END) - max(CASE WHEN p + m0 = {_FIRST} THEN band END), 6) AS change FROM b, sp GROUP BY 1, 2",
)
def endpoint_change(spark, d):
    """Change between two months of low-passed series, by region and forcing."""
    rows = forcing(spark, d).join(region_of(spark, d), "cell").groupBy("region", "forc", "m").agg(F.sum("x").alias("x"))
    low = X.filter_bank(X.dense(rows, ["region", "forc"], "m", fill=0.0), ["region", "forc"], "m", 1.0, {"low": {k: v for k, v in LOW12.items() if k != "delta"}}, least=0.0)
    return S.endpoint_change(low, ["region", "forc"], "m", _FIRST, _LAST, "low").select("region", "forc", r6("change"))


@query("linear_interp_clamped", "WITH e AS (SELECT type, s, avg(value) AS v FROM ev GROUP BY 1, 2), t AS (SELECT type, unnest(generate_series(1703980800, 1707000000, 43200)) AS s FROM (SELECT DISTINCT type FROM ev)), a AS (SELECT t.type, t.s, e.s AS s0, e.v AS v0 FROM t ASOF LEFT JOIN e ON t.type = e.type AND t.s >= e.s), z AS (SELECT t.type, t.s, e.s AS s1, e.v AS v1 FROM t ASOF LEFT JOIN e ON t.type = e.type AND t.s <= e.s) SELECT type, s, round(CASE WHEN s0 IS NULL THEN v1 WHEN s1 IS NULL OR s1 = s0 THEN v0 ELSE v0 + (s - s0) / (s1 - s0) * (v1 - v0) END, 5) AS x FROM a JOIN z USING (type, s)")
def linear_interp_clamped(spark, d):
    """Beyond their ends series keep their first and last values."""
    e = events(spark, d)
    targets = e.select("type").distinct().withColumn("s", F.explode(F.sequence(F.lit(1703980800).cast("long"), F.lit(1707000000).cast("long"), F.lit(43200).cast("long"))))
    return X.interpolated(e.select("type", "s", F.col("value").alias("x")), targets, ["type"], "s", clamped=True, width=4 * 86400.0).select("type", "s", r6("x", 5))


_PLACED = [0.5, 10.25, 31.75, 62.5]


@query(
    "fourier_interp",
    f"WITH f AS (SELECT vec_id, regr_slope(x, p) AS slope, regr_intercept(x, p) AS level FROM ar GROUP BY 1), t AS (SELECT unnest([{', '.join(map(str, _PLACED))}])::DOUBLE AS t), w AS (SELECT t, p, sum(cos(2 * pi() * k / {N} * (t - p))) / {N} AS w FROM t, range(0, {N}) a(p), range(-{N // 2}, {N // 2}) b(k) WHERE abs(k) / {N}.0 <= 0.2 GROUP BY 1, 2) SELECT vec_id, t, round(sum(w * (x - slope * p - level)) + any_value(slope) * t + any_value(level), 6) AS x FROM ar JOIN f USING (vec_id) JOIN w USING (p) GROUP BY vec_id, t",
)
def fourier_interp(spark, d):
    """Series at places between theirs, without what is faster than a fifth of a step."""
    rows = arrays(spark, d).select("vec_id", F.col("p").cast("double").alias("t"), "x")
    return X.interpolated_fourier(rows, ["vec_id"], "t", 1.0, _PLACED, most=0.2).select("vec_id", "t", r6("x"))


def _chain_sql(keys: str, train: str, ask: str, n: int) -> str:
    """fit (keys, day, cycle): the mean and cycle of train (keys, day, x) at the days of ask (keys, day); the asked rows go
    through the same steps as those that are learned from, without counting in any sum."""
    names = [f"{c}{k}" for k in range(1, n + 1) for c in ("c", "s")]
    cols = ", ".join(f"{'cos' if c[0] == 'c' else 'sin'}({2 * math.pi / 365.24!r}::DOUBLE * {c[1:]} * day) AS {c}" for c in names)
    w, t = f"OVER (PARTITION BY {keys})", "FILTER (tr)"
    steps = [f"g0 AS (SELECT {keys}, day, tr, x AS r, avg(x) {t} {w} AS fit, {cols} FROM (SELECT {keys}, day, x, true AS tr FROM {train} UNION ALL SELECT {keys}, day, NULL, false FROM {ask}))"]
    steps.append(f"g1 AS (SELECT {keys}, day, tr, fit, r - avg(r) {t} {w} AS r, {', '.join(f'{c} - avg({c}) {t} {w} AS {c}' for c in names)} FROM g0)")
    for j, q in enumerate(names):
        norm = f"CASE WHEN sum({q} * {q}) {t} {w} > 1e-9 THEN sum({q} * {q}) {t} {w} END"
        share = lambda c: f"coalesce(sum({c} * {q}) {t} {w} / {norm}, 0)"  # noqa: B023, E731
        new = ", ".join([f"{c} - {share(c)} * {q} AS {c}" for c in names[j + 1 :]] + [f"r - {share('r')} * {q} AS r", f"fit + {share('r')} * {q} AS fit"])
        steps.append(f"g{j + 2} AS (SELECT {keys}, day, tr, {new} FROM g{j + 1})")
    return ", ".join(steps) + f", fitted AS (SELECT {keys}, day, fit AS cycle FROM g{len(names) + 1} WHERE NOT tr)"


_DAY = "date_diff('day', DATE '1970-01-01', make_date(({m} - 1) // 12, ({m} - 1) % 12 + 1, 1))"
_ASK = f"tn AS (SELECT series, {_DAY.format(m='m')} AS day, x FROM d2), ak AS (SELECT series, unnest(range(min(m), max(m) + 13)) AS m FROM d2 GROUP BY 1), aq AS (SELECT series, m, {_DAY.format(m='m')} + 14.5 AS day FROM ak)"


@query("seasonal_at", f"WITH {_ASK}, {_chain_sql('series', 'tn', 'aq', 3)} SELECT series, m, round(f.cycle, 5) AS \"cycle\" FROM aq JOIN fitted f USING (series, day)")
def seasonal_at(spark, d):
    """The cycle of each series in the middle of its months, and a year beyond."""
    rows = reference(spark, d).withColumn("day", month_start_day(F.col("m")))
    found = X.seasonal_coefficients(rows, ["series"], "day", 3)
    asked = rows.groupBy("series").agg(F.min("m").alias("a"), F.max("m").alias("z")).select("series", F.explode(F.sequence("a", F.col("z") + 12)).alias("m"))
    asked = asked.withColumn("day", month_start_day(F.col("m")) + 14.5)
    return X.seasonal_at(found, asked, ["series"], "day").select("series", "m", r6("cycle", 5))


SPLIT = 23988  # the month from which the late record is there
_DAYS = f"date_diff('day', DATE '1970-01-01', make_date({(SPLIT - 1) // 12}, {(SPLIT - 1) % 12 + 1}, 1))"
_PRESAT = (
    f"se AS (SELECT cell, {_DAY.format(m='m')} AS day, m, x FROM d1 WHERE forc = 'N' AND m % 2 = 0), sl AS (SELECT cell, {_DAY.format(m='m')} AS day, m, x FROM d1 WHERE forc = 'R'), "
    f"st AS (SELECT cell, m, {_DAY.format(m='m')} + 14.5 AS day FROM (SELECT cell, unnest(range(23930, {SPLIT})) AS m FROM (SELECT DISTINCT cell FROM d1))), "
    f"so AS (SELECT cell, avg(CASE WHEN forc = 'R' THEN x END) - avg(CASE WHEN forc = 'N' AND m % 2 = 0 THEN x END) AS off FROM d1 WHERE m >= {SPLIT} AND m < {SPLIT + 24} GROUP BY 1), "
    "s0 AS (SELECT t.cell, t.m, t.day, e.day AS d0, e.x AS x0 FROM st t ASOF LEFT JOIN se e ON e.cell = t.cell AND e.day <= t.day), s1 AS (SELECT t.cell, t.m, e.day AS d1_, e.x AS x1 FROM st t ASOF LEFT JOIN se e ON e.cell = t.cell AND e.day >= t.day), "
    "si AS (SELECT cell, m, day, CASE WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL THEN x0 WHEN d1_ = d0 THEN x0 ELSE x0 + (day - d0) / (d1_ - d0) * (x1 - x0) END AS x FROM s0 JOIN s1 USING (cell, m))"
)


@query("presat_splice", f"WITH {_PRESAT}, {_chain_sql('cell', 'sl', 'st', 4)}, sw AS (SELECT cell, day, cycle - avg(cycle) OVER w - regr_slope(cycle, day) OVER w * (day - avg(day) OVER w) AS wave FROM fitted WINDOW w AS (PARTITION BY cell)) SELECT cell, m, round(x + off + wave, 5) AS x FROM si JOIN so USING (cell) JOIN sw USING (cell, day) WHERE x + off + wave IS NOT NULL")
def presat_splice(spark, d):
    """A record of every other month carries each cell's later one back: interpolated, moved, with the later one's cycle."""
    rows = forcing(spark, d).withColumn("day", month_start_day(F.col("m")).cast("double"))
    early, late = rows.where("forc = 'N' and m % 2 = 0"), rows.where("forc = 'R'")
    targets = rows.select("cell").distinct().withColumn("m", F.explode(F.sequence(F.lit(23930).cast("long"), F.lit(SPLIT - 1).cast("long")))).withColumn("day", month_start_day(F.col("m")) + 14.5)
    start, end = (float((dt.date((m - 1) // 12, (m - 1) % 12 + 1, 1) - dt.date(1970, 1, 1)).days) for m in (SPLIT, SPLIT + 24))
    out = B.extended_back(early.select("cell", "day", "x"), late.select("cell", "day", "x"), targets.select("cell", "day"), ["cell"], "day", start, end)
    return out.join(targets, ["cell", "day"]).select("cell", "m", r6("x", 5)).where("x is not null")


_TWO = "w AS (SELECT m, max(CASE WHEN series = '1-URGENT' THEN x END) AS a, max(CASE WHEN series = '5-LOW' THEN x END) AS b FROM d2 GROUP BY 1)"


def _two(spark, d):
    pick = lambda s: F.max(F.when(F.col("series") == s, F.col("x")))
    return reference(spark, d).groupBy("m").agg(pick("1-URGENT").alias("a"), pick("5-LOW").alias("b")).withColumn("k", F.lit(1))


@query("lag_corr", f"WITH {_TWO} SELECT l.lag, round(corr(p.a, q.b), 5) AS r, count(*) AS n FROM w p, (VALUES (-2), (-1), (0), (1), (2), (3)) l(lag), w q WHERE q.m = p.m + l.lag AND p.a IS NOT NULL AND q.b IS NOT NULL GROUP BY 1")
def lag_corr(spark, d):
    return X.lag_correlation(_two(spark, d), ["k"], "m", "a", "b", [-2, -1, 0, 1, 2, 3]).select("lag", r6("r", 5), "n")


@query("integral_scale", f"WITH {_scale_sql('ar', 'x')} SELECT vec_id, round(scale, 5) AS scale FROM sc")
def integral_scale(spark, d):
    return X.time_scale(arrays(spark, d), ["vec_id"], "p", "x", N).select("vec_id", r6("scale", 5))


LAGS = list(range(-3, 7))
_GAPPY = "gp AS (SELECT vec_id, p, CASE WHEN abs(x) > 0.02 THEN x END AS x FROM ar)"


def _bounds_sql() -> str:
    half = erfinv(0.95) * math.sqrt(2)
    most = max(map(abs, LAGS))
    return (
        f"WITH {_GAPPY}, gv AS (SELECT * FROM gp WHERE x IS NOT NULL), dt AS (SELECT vec_id, p, x - avg(x) OVER w - regr_slope(x, p) OVER w * (p - avg(p) OVER w) AS y FROM gv WINDOW w AS (PARTITION BY vec_id)), "
        f"au AS (SELECT a.vec_id, k.lag, corr(a.y, b.y) AS r FROM dt a, range(1, {most + 1}) k(lag), dt b WHERE b.vec_id = a.vec_id AND b.p = a.p + k.lag GROUP BY 1, 2), "
        f"st AS (SELECT vec_id, coalesce(min(CASE WHEN r < 0 THEN lag END), {most}) AS stop FROM au GROUP BY 1), "
        "sc AS (SELECT vec_id, 1 + greatest(0, 2 * sum(r)) AS scale FROM au JOIN st USING (vec_id) WHERE lag <= stop GROUP BY 1), "
        f"c AS (SELECT a.vec_id, k.lag, corr(a.y, b.y) AS r, count(*) AS n FROM dt a, range({LAGS[0]}, {LAGS[-1] + 1}) k(lag), dt b WHERE b.vec_id = a.vec_id + 1 AND b.p = a.p + k.lag GROUP BY 1, 2), "
        "j AS (SELECT c.*, s1.scale AS scale_a, s2.scale AS scale_b, n / least(s1.scale, s2.scale) AS dof, max(CASE WHEN lag = 0 THEN n END) OVER (PARTITION BY c.vec_id) / least(s1.scale, s2.scale) AS dof_zero FROM c JOIN sc s1 ON s1.vec_id = c.vec_id JOIN sc s2 ON s2.vec_id = c.vec_id + 1), "
        "f AS (SELECT *, 0.5 * (ln(1 + abs(r)) - ln(1 - abs(r))) AS z, CASE WHEN dof > 3 THEN " + f"{half:.17e}" + " / sqrt(dof - 3) END AS e FROM j), "
        "z AS (SELECT *, sign(r) * CASE WHEN e IS NULL THEN -1 ELSE 1 - 2 / (exp(2 * (z - e)) + 1) END AS lo, sign(r) * CASE WHEN e IS NULL THEN 1 ELSE 1 - 2 / (exp(2 * (z + e)) + 1) END AS hi FROM f) "
    )


def _bounds(spark, d):
    a = arrays(spark, d).withColumn("x", F.when(F.abs("x") > 0.02, F.col("x")))
    pairs = a.select("vec_id", "p", F.col("x").alias("a")).join(a.select((F.col("vec_id") - 1).alias("vec_id"), "p", F.col("x").alias("b")), ["vec_id", "p"])
    return X.correlated(pairs, ["vec_id"], "p", "a", "b", LAGS).withColumn("lag", F.col("lag").cast("long"))


@query("corr_uncert", _bounds_sql() + "SELECT vec_id, lag, round(r, 5) AS r, n, round(dof, 4) AS dof, round(dof_zero, 4) AS dof_zero, round(scale_a, 5) AS scale_a, round(scale_b, 5) AS scale_b, round(lo, 5) AS low, round(hi, 5) AS high FROM z")
def corr_uncert(spark, d):
    """All seven results of a lagged correlation, for neighbouring vectors with gaps."""
    return _bounds(spark, d).select("vec_id", "lag", r6("r", 5), "n", r6("dof", 4), r6("dof_zero", 4), r6("scale_a", 5), r6("scale_b", 5), r6("low", 5), r6("high", 5))


@query("corr_significant", _bounds_sql() + "SELECT vec_id, lag, round(CASE WHEN lo * r > 0 THEN r END, 5) AS r FROM z")
def corr_significant(spark, d):
    return _bounds(spark, d).select("vec_id", "lag", rnd(F.when(F.col("significant"), F.col("r")), 5).alias("r"))


@query("corr_varexp_pair", f"WITH {_TWO}, v AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL), t AS (SELECT a - regr_slope(a, m) OVER () * m AS a, b - regr_slope(b, m) OVER () * m AS b FROM v) SELECT round(corr(a, b), 5) AS r, round(1 - var_pop(a - b) / var_pop(a), 5) AS varexp, count(*) AS n FROM t")
def corr_varexp_pair(spark, d):
    rows = _two(spark, d).where("a is not null and b is not null")
    slopes = rows.agg(F.regr_slope("a", "m").alias("sa"), F.regr_slope("b", "m").alias("sb"))  # one row
    rows = rows.crossJoin(F.broadcast(slopes)).select((F.col("a") - F.col("sa") * F.col("m")).alias("da"), (F.col("b") - F.col("sb") * F.col("m")).alias("db"))
    return rows.agg(rnd(F.corr("da", "db"), 5).alias("r"), rnd(1 - F.try_divide(F.var_pop(F.col("da") - F.col("db")), F.var_pop("da")), 5).alias("varexp"), F.count("*").alias("n"))


def _lines(spark, d):
    """Text lines as tide gauges come, every 17th month with the missing value."""
    year = F.expr("(m - 1) div 12") + ((F.col("m") - 1) % 12 + 0.5) / 12
    mm = F.when(F.col("m") % 17 == 0, -99999).otherwise(F.floor(F.col("x") * 1000)).cast("long")
    return total(spark, d).select("m", F.format_string("%.4f; %d; 0; 000", year, mm).alias("value"))


@query("gauge_parse", "SELECT CAST((m - 1) // 12 AS INTEGER) AS year, CAST((m - 1) % 12 + 1 AS INTEGER) AS month, round(CASE WHEN m % 17 <> 0 THEN floor(x * 1000) / 1000 END, 6) AS x FROM d2t")
def gauge_parse(spark, d):
    return P.gauge(_lines(spark, d)).select("year", "month", r6("x"))


_PRESSURE = "pr AS (SELECT m, avg(CASE WHEN cell % 2 = 0 THEN x END) * 1000 AS pl, avg(x) * 1000 AS po FROM d1 GROUP BY 1)"


def _corrected(spark, d, level):
    """level (m, x) as (m, x): the pressures are those of the even cells and of all."""
    p = forcing(spark, d).groupBy("m").agg((F.avg(F.when(F.col("cell") % 2 == 0, F.col("x"))) * 1000).alias("pl"), (F.avg("x") * 1000).alias("po")).withColumn("s", month_middle(F.col("m")) + 3600)
    rows = level.withColumn("s", month_middle(F.col("m")))
    out = P.pressure_corrected(rows.select("s", "x"), p.select("s", F.col("pl").alias("p")), p.select("s", F.col("po").alias("p")))
    return out.join(rows.select("s", "m"), "s")


@query("ib_correct", f"WITH {_PRESSURE} SELECT m, round(x + (pl - po) / (1030 * 9.81), 6) AS x FROM d2t JOIN pr USING (m)")
def ib_correct(spark, d):
    return _corrected(spark, d, total(spark, d)).select("m", r6("x"))


@query("gauge_pipeline", f"WITH {_PRESSURE}, g AS (SELECT m, avg(x) AS mean FROM d1 GROUP BY 1) SELECT m, round(floor(x * 1000) / 1000 + (pl - po) / (1030 * 9.81) - mean, 6) AS rest FROM d2t JOIN pr USING (m) JOIN g USING (m) WHERE m % 17 <> 0 AND m > 1995 * 12 AND m <= 2000 * 12")
def gauge_pipeline(spark, d):
    level = P.gauge(_lines(spark, d)).where("x is not null and year >= 1995 and year < 2000")
    return R.monthly_removed(_corrected(spark, d, level.select("m", "x")), forcing(spark, d)).select("m", r6("rest"))
