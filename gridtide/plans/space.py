"""Geometry and regridding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridtide.functions.nulls import finite
from gridtide.operators import geometry as G
from gridtide.operators import regrid as W
from gridtide.plans.base import arrays, cells, points, query, r6, rnd
from gridtide.sources.grids import llc_positions

_DIST = "sqrt(power(cos(radians(p.lat)) * (fmod(c.lon - p.lon + 180, 360) - 180), 2) + power(c.lat - p.lat, 2))"


@query("lon_wrap", "SELECT point, round(fmod(lon - 20, 360) + 20, 6) AS east, round(fmod(lon * 3 + 180, 360) - 180, 6) AS west FROM pt")
def lon_wrap(spark, d):
    return points(spark, d).select("point", rnd(G.wrapped(F.col("lon"), 20.0)).alias("east"), rnd(G.wrapped(F.col("lon") * 3, -180.0)).alias("west"))


@query("nearest_cell", f"WITH k AS (SELECT point, cell, {_DIST} AS g FROM pt p JOIN ce c ON wet = 1) SELECT point, cell, round(g, 6) AS distance FROM k QUALIFY row_number() OVER (PARTITION BY point ORDER BY g, cell) = 1")
def nearest_cell(spark, d):
    return G.nearest_cell(points(spark, d), cells(spark, d).where("wet = 1"), "point", "cell").select("point", "cell", r6("distance"))


_REGION = """CASE WHEN fmod(lon + 90, 360) < 1 AND lat BETWEEN 28 AND 29.7 THEN 0 WHEN fmod(lon + 89, 360) < 7 AND lat BETWEEN 22 AND 31 THEN 1
WHEN fmod(lon + 98, 360) < 9 AND lat BETWEEN 18 AND 30 THEN 2
WHEN fmod(lon + 89, 360) < 28 AND lat >= 9 AND lat < 22 AND 2.0 / 3 * (lon + 83) + (lat - 10) >= 0 AND 0.25 * (lon + 72) + (lat - 20) <= 0 THEN 3
WHEN fmod(lon + 3.0 / 23 * lat + 76, 360) < 79 AND lat BETWEEN 5 AND 25 THEN 4 WHEN fmod(lon + 82, 360) < 3 AND lat BETWEEN 22 AND 27 THEN 5
WHEN fmod(lon + 80, 360) < 80 AND lat BETWEEN 25 AND 35 THEN 7 WHEN fmod(lon + 80, 360) < 80 AND lat > 35 AND lat <= 45 AND -1.4 * (lon + 5.5) + (lat - 36) >= 0 THEN 8
WHEN fmod(lon + 75, 360) - (75 - 0.8 * (lat - 53.125)) < 0 AND lat > 45 AND lat <= 55 THEN 9 WHEN fmod(lon + 73, 360) < 93 AND lat > 55 AND lat <= 70 THEN 10 END"""


@query("region_assign", f"SELECT point, {_REGION} AS region FROM pt")
def region_assign(spark, d):
    return points(spark, d).select("point", G.regions(F.col("lon"), F.col("lat")).alias("region"))


LINE = [(1, -81.0, 27.0), (2, -79.0, 31.0), (3, -76.0, 35.0), (4, -73.0, 40.0), (5, -66.0, 44.0)]


def _strip(km: int) -> str:
    """CTEs up to q (point, dot, size, cr, r), and the condition on it."""
    return (
        f"l(ord, lon, lat) AS (VALUES {', '.join(f'({o}, {x}::DOUBLE, {y}::DOUBLE)' for o, x, y in LINE)}), s AS (SELECT ord, lon AS lon1, lat AS lat1, lead(lon) OVER (ORDER BY ord) AS lon2, lead(lat) OVER (ORDER BY ord) AS lat2 FROM l), "
        "k AS (SELECT point, (lon2 - lon1) * cos(radians((lat1 + lat2) / 2)) AS dx, lat2 - lat1 AS dy, (lon - lon1) * cos(radians((lat1 + lat2) / 2)) AS px, lat - lat1 AS py FROM pt, s WHERE lon2 IS NOT NULL), "
        "q AS (SELECT point, sqrt(dx * dx + dy * dy) AS size, px * dx + py * dy AS dot, px * dy - py * dx AS cr, sqrt(px * px + py * py) AS r FROM k), "
        f"cs AS (SELECT DISTINCT point FROM q WHERE cr / size >= 0 AND ((dot >= 0 AND dot / size <= size AND cr / size <= {km} / 111.1) OR r <= {km} / 111.1))"
    )


@query("regions_with_coast", f"WITH {_strip(300)}, rg AS (SELECT point, {_REGION} AS region FROM pt) SELECT point, CASE WHEN region <= 5 THEN region WHEN cs.point IS NOT NULL THEN 6 ELSE region END AS region FROM rg LEFT JOIN cs USING (point)")
def regions_with_coast(spark, d):
    """All eleven regions: the strip along a coast line comes after the first six and before the others."""
    line = spark.createDataFrame(LINE, "ord int, lon double, lat double")
    return G.regions_with_coast(points(spark, d).withColumnRenamed("point", "cell"), line).select(F.col("cell").alias("point"), "region")


@query("cell_centroid", "WITH f AS (SELECT nation, arg_min(lon, cell) AS lon0 FROM ce GROUP BY 1) SELECT nation, round(fmod(any_value(lon0) + avg(fmod(lon - lon0 + 180, 360) - 180) + 180, 360) - 180, 6) AS lon, round(avg(lat), 6) AS lat, round(sum(area), 6) AS area FROM ce JOIN f USING (nation) GROUP BY 1")
def cell_centroid(spark, d):
    return G.centroids(cells(spark, d), ["nation"], "cell").select("nation", r6("lon"), r6("lat"), r6("area"))


_GRID = "g AS (SELECT CAST(vec_id // 160 * 4 + vec_id % 4 AS INTEGER) AS tile, CAST(vec_id % 160 // 4 AS INTEGER) AS j, p AS i, p * 1.5 AS lon, vec_id % 160 * 0.25 AS lat, CASE WHEN x > -0.05 THEN 1 ELSE 0 END AS wet FROM ar)"


def grid(spark, d):
    """(tile, j, i, lon, lat, wet): all vectors, four tiles of 40 by 64 points for each 160; wet where the value is not low."""
    rows = arrays(spark, d)
    return rows.select(F.expr("cast(vec_id div 160 * 4 + vec_id % 4 as int)").alias("tile"), F.expr("cast(vec_id % 160 div 4 as int)").alias("j"), F.col("p").alias("i"), (F.col("p") * 1.5).alias("lon"), (F.col("vec_id") % 160 * 0.25).alias("lat"), F.when(F.col("x") > -0.05, 1).otherwise(0).alias("wet"))


#: priority, n_merge, tile within its four, j_lo, j_hi, i_lo, i_hi
SCHEMES = [(1, 2, 0, 0, 11, 4, 20), (2, 3, 0, 5, 30, 0, 40), (2, 3, 1, 0, 40, 0, 64), (3, 5, 0, 0, 40, 0, 64), (3, 5, 1, 0, 40, 0, 64), (3, 5, 2, 10, 35, 8, 50)]


@query(
    "nested_geom",
    f"WITH {_GRID}, s(priority, n_merge, tile, j_lo, j_hi, i_lo, i_hi) AS (VALUES {', '.join(map(str, SCHEMES))}), h AS (SELECT g.tile, j, i, priority, (j - j_lo) // n_merge AS bj, (i - i_lo) // n_merge AS bi FROM g JOIN s ON g.tile % 4 = s.tile AND j >= j_lo AND j < j_hi AND i >= i_lo AND i < i_hi QUALIFY row_number() OVER (PARTITION BY g.tile, j, i ORDER BY priority) = 1) "
    "SELECT CAST(dense_rank() OVER (ORDER BY priority, tile, bj, bi) - 1 AS BIGINT) AS cell, tile, j, i, CAST(row_number() OVER (PARTITION BY priority, tile, bj, bi ORDER BY j, i) - 1 AS INTEGER) AS ord, count(*) OVER (PARTITION BY priority, tile, bj, bi) AS size FROM h",
)
def nested_geom(spark, d):
    schemes = spark.createDataFrame(SCHEMES, "priority int, n_merge int, of4 int, j_lo int, j_hi int, i_lo int, i_hi int")
    tiles = grid(spark, d).select("tile").distinct().withColumn("of4", F.col("tile") % 4)
    return G.nested_cells(grid(spark, d), tiles.join(F.broadcast(schemes), "of4").drop("of4"))


_SPECIAL = "sp AS (SELECT CAST(tile // 4 * 6 + j // 3 * 3 + i // 3 AS BIGINT) AS cell, tile, j, i, CAST(j % 3 * 3 + i % 3 AS INTEGER) AS ord FROM g WHERE tile % 4 = 0 AND j < 6 AND i < 9), sz AS (SELECT *, count(*) OVER (PARTITION BY cell) AS size FROM sp)"


@query(
    "combined_geom",
    f"WITH {_GRID}, {_SPECIAL}, s(priority, n_merge, tile, j_lo, j_hi, i_lo, i_hi) AS (VALUES {', '.join(map(str, SCHEMES))}), re AS (SELECT * FROM g ANTI JOIN sp USING (tile, j, i)), h AS (SELECT re.tile, j, i, priority, (j - j_lo) // n_merge AS bj, (i - i_lo) // n_merge AS bi FROM re JOIN s ON re.tile % 4 = s.tile AND j >= j_lo AND j < j_hi AND i >= i_lo AND i < i_hi QUALIFY row_number() OVER (PARTITION BY re.tile, j, i ORDER BY priority) = 1) "
    "SELECT cell, tile, j, i, ord, size FROM sz UNION ALL SELECT CAST(dense_rank() OVER (ORDER BY priority, tile, bj, bi) - 1 + (SELECT max(cell) + 1 FROM sp) AS BIGINT), tile, j, i, CAST(row_number() OVER (PARTITION BY priority, tile, bj, bi ORDER BY j, i) - 1 AS INTEGER), count(*) OVER (PARTITION BY priority, tile, bj, bi) FROM h",
)
def combined_geom(spark, d):
    """Special cells first, then nested cells of the points that they leave, numbered after them."""
    g = grid(spark, d)
    special = g.where("tile % 4 = 0 and j < 6 and i < 9").select(F.expr("cast(tile div 4 * 6 + j div 3 * 3 + i div 3 as bigint)").alias("cell"), "tile", "j", "i", F.expr("cast(j % 3 * 3 + i % 3 as int)").alias("ord"))
    special = special.withColumn("size", F.count("*").over(Window.partitionBy("cell")))
    schemes = spark.createDataFrame(SCHEMES, "priority int, n_merge int, of4 int, j_lo int, j_hi int, i_lo int, i_hi int")
    tiles = g.select("tile").distinct().withColumn("of4", F.col("tile") % 4)
    return G.combined(special, g, tiles.join(F.broadcast(schemes), "of4").drop("of4"))


_RIVER = (
    "ri AS (SELECT p_partkey AS s, 470 + p_partkey * 13 % 180 AS y, p_partkey * 29 % 1100 AS x FROM part), "
    "rr AS (SELECT s, x * 0.25 + 0.125 AS lon, y * 0.25 - 89.875 AS lat, CASE WHEN abs(y - 484) <= 4 AND abs(x - 986) <= 6 THEN 1 WHEN (y - (-20.0 / 120 * (x - 108) + 520) > 0 AND y < 552 AND abs(x - 168) <= 60) OR (abs(y - 598) <= 26 AND abs(x - 80) < 44 AND (y < 584 OR x >= 54)) THEN NULL "
    "WHEN abs(y - 606) <= 6 AND abs(x - 650) <= 10 THEN 2 WHEN abs(y - 632) <= 10 AND abs(x - 296) <= 20 THEN 3 ELSE 0 END AS rule FROM ri)"
)


@query("river_redirects", f"WITH {_RIVER}, k AS (SELECT p.s, c.cell AS t, {_DIST} AS g FROM rr p JOIN ce c ON wet = 1 AND CASE rule WHEN 0 THEN true WHEN 1 THEN fmod(c.lon + 475, 360) < 180 WHEN 2 THEN c.lon - (c.lat - 60 + 163) <= 0 WHEN 3 THEN c.lon - 71 >= 0 ELSE false END) SELECT s, t FROM k QUALIFY row_number() OVER (PARTITION BY s ORDER BY g, t) = 1")
def river_redirects(spark, d):
    """The wet target that each river cell may go to, with the boxes that are left out and those that look one way only."""
    from gridtide.plans.base import table

    k = F.col("p_partkey")
    y, x = 470 + k * 13 % 180, k * 29 % 1100
    sources = table(spark, d, "part").select(k.alias("s"), y.alias("lat_ind"), x.alias("lon_ind"), (x * 0.25 + 0.125).alias("lon"), (y * 0.25 - 89.875).alias("lat"))
    return W.river_targets(sources, cells(spark, d).where("wet = 1").select(F.col("cell").alias("t"), "lon", "lat")).select("s", "t")


@query("coast_faces", f"WITH {_GRID}, k AS (SELECT a.tile, a.j, a.i, 0 AS side, a.lon AS x, a.lat AS y, b.lon AS x2, b.lat AS y2, a.wet AS w, b.wet AS w2 FROM g a JOIN g b ON a.tile = b.tile AND b.j = a.j + 1 AND b.i = a.i UNION ALL SELECT a.tile, a.j, a.i, 1, a.lon, a.lat, b.lon, b.lat, a.wet, b.wet FROM g a JOIN g b ON a.tile = b.tile AND b.i = a.i + 1 AND b.j = a.j), f AS (SELECT tile, j, i, side, (x + x2) / 2 AS lon, (y + y2) / 2 AS lat FROM k WHERE w <> w2) SELECT tile, j, i, side, round(lon, 6) AS lon, round(lat, 6) AS lat FROM f")
def coast_faces(spark, d):
    return G.coast_faces(grid(spark, d)).select("tile", "j", "i", "side", r6("lon"), r6("lat"))


@query("coast_buffer", f"WITH {_strip(900)} SELECT point AS cell FROM cs")
def coast_buffer(spark, d):
    line = spark.createDataFrame(LINE, "ord int, lon double, lat double")
    return G.coast_strip(line, points(spark, d).withColumnRenamed("point", "cell"), 900.0)


@query("polar_cell_test", "WITH k AS (SELECT point, (90 - abs(lat)) * cos(radians(lon)) AS x, (90 - abs(lat)) * sin(radians(lon)) AS y FROM pt) SELECT point, x + 20 >= 0 AND x <= 30 AND y + 15 >= 0 AND y <= 25 AS inside FROM k")
def polar_cell_test(spark, d):
    rows = points(spark, d)
    x, y = G.polar(F.col("lon"), F.abs("lat"))
    corners = [(F.lit(a), F.lit(b)) for a, b in ((-20.0, -15.0), (30.0, -15.0), (30.0, 25.0), (-20.0, 25.0))]
    return rows.select("point", G.in_quad(x, y, corners).alias("inside"))


@query("refine_join", f"WITH {_GRID} SELECT a.tile, a.j, a.i, round(a.lat - avg(b.lat), 6) AS diff, count(*) AS n FROM g a JOIN g b ON a.tile = b.tile AND b.j // 3 = a.j AND b.i // 3 = a.i GROUP BY a.tile, a.j, a.i, a.lat")
def refine_join(spark, d):
    g = grid(spark, d)
    fine = g.select("tile", F.expr("j div 3").alias("j"), F.expr("i div 3").alias("i"), F.col("lat").alias("fine"))
    return g.join(fine, ["tile", "j", "i"]).groupBy("tile", "j", "i", "lat").agg(F.avg("fine").alias("f"), F.count("*").alias("n")).select("tile", "j", "i", rnd(F.col("lat") - F.col("f")).alias("diff"), "n")


@query("llc_reshape", "WITH k AS (SELECT (vec_id * 64 + p) // 208 AS layer, (vec_id * 64 + p) % 208 AS pos, x FROM ar), s AS (SELECT layer, x, CASE WHEN pos < 112 THEN pos // 16 WHEN pos < 160 THEN 7 + ((pos - 112) % 12) // 4 ELSE 10 + ((pos - 160) % 12) // 4 END AS tile, CASE WHEN pos < 112 THEN (pos % 16) // 4 WHEN pos < 160 THEN (pos - 112) // 12 ELSE (pos - 160) // 12 END AS j, CASE WHEN pos < 112 THEN pos % 4 ELSE (pos - CASE WHEN pos < 160 THEN 112 ELSE 160 END) % 4 END AS i FROM k) SELECT layer, CAST(tile AS INTEGER) AS tile, CAST(j AS INTEGER) AS j, CAST(i AS INTEGER) AS i, round(x, 6) AS x FROM s")
def llc_reshape(spark, d):
    """All values one after another, 13 tiles of 4 by 4 points to a layer."""
    at = F.col("vec_id") * 64 + F.col("p")
    rows = arrays(spark, d).select(F.floor(at / F.lit(208)).alias("layer"), (at % 208).alias("pos"), "x")
    tile, j, i = llc_positions(F.col("pos"), 4)
    return rows.select("layer", tile.alias("tile"), j.alias("j"), i.alias("i"), r6("x"))


_BOX = """t AS (SELECT c_custkey AS t, (c_custkey * 7 % 300)::DOUBLE - 150 AS lon_lo, (c_custkey * 7 % 300)::DOUBLE - 150 + 3.5 AS lon_hi, (c_custkey * 5 % 140)::DOUBLE - 70 AS lat_lo, (c_custkey * 5 % 140)::DOUBLE - 70 + 2.25 AS lat_hi, CASE WHEN c_custkey % 5 > 0 THEN 1 ELSE 0 END AS wet FROM customer),
s AS (SELECT p_partkey AS s, (p_partkey * 11 % 300)::DOUBLE - 150.5 AS lon_lo, (p_partkey * 11 % 300)::DOUBLE - 150.5 + 2 AS lon_hi, (p_partkey * 3 % 140)::DOUBLE - 70.5 AS lat_lo, (p_partkey * 3 % 140)::DOUBLE - 70.5 + 2 AS lat_hi, CASE WHEN p_partkey % 3 > 0 THEN 1 ELSE 0 END AS wet FROM part),
o AS (SELECT t, s, t.wet AS tw, s.wet AS sw, 111100.0 * 111100.0 * cos(radians((greatest(t.lat_lo, s.lat_lo) + least(t.lat_hi, s.lat_hi)) / 2)) * (least(t.lon_hi, s.lon_hi) - greatest(t.lon_lo, s.lon_lo)) * (least(t.lat_hi, s.lat_hi) - greatest(t.lat_lo, s.lat_lo)) AS area
 FROM t JOIN s ON least(t.lon_hi, s.lon_hi) > greatest(t.lon_lo, s.lon_lo) AND least(t.lat_hi, s.lat_hi) > greatest(t.lat_lo, s.lat_lo)),
w AS (SELECT t, s, area / sum(area) OVER (PARTITION BY t) AS weight, row_number() OVER (PARTITION BY t ORDER BY s) AS n FROM (SELECT *, max(CASE WHEN tw = sw THEN 1 ELSE 0 END) OVER (PARTITION BY t) AS k FROM o) WHERE tw = sw OR k = 0)"""


def boxes(spark, d, name: str):
    from gridtide.plans.base import table

    if name == "t":
        k, rows, a, b, o, w, h, m = F.col("c_custkey"), table(spark, d, "customer"), 7, 5, 0.0, 3.5, 2.25, 5
    else:
        k, rows, a, b, o, w, h, m = F.col("p_partkey"), table(spark, d, "part"), 11, 3, 0.5, 2.0, 2.0, 3
    lon, lat = (k * a % 300).cast("double") - (150 + o), (k * b % 140).cast("double") - (70 + o)
    return rows.select(k.alias(name), lon.alias("lon_lo"), (lon + w).alias("lon_hi"), lat.alias("lat_lo"), (lat + h).alias("lat_hi"), F.when(k % m > 0, 1).otherwise(0).alias("wet"))


def _weights(spark, d):
    """The weights of groups of equal targets, and the members of these groups."""
    (targets, of_t), (sources, of_s) = W.alike(boxes(spark, d, "t"), "t"), W.alike(boxes(spark, d, "s"), "s")
    return W.weights(W.each(W.overlaps(targets, sources), of_s, "s")), of_t


@query("overlap_weights", f"WITH {_BOX} SELECT t, s, round(area / 1e6, 4) AS area FROM o")
def overlap_weights(spark, d):
    """The area of a pair of different boxes is taken once, for all targets and sources that have them."""
    (targets, of_t), (sources, of_s) = W.alike(boxes(spark, d, "t"), "t"), W.alike(boxes(spark, d, "s"), "s")
    met = W.overlaps(targets, sources).select("t", "s", rnd(F.col("area") / 1e6, 4).alias("area"))
    return W.each(W.each(met, of_t, "t"), of_s, "s").select("t", "s", "area")


@query("regrid_weights", f"WITH {_BOX} SELECT t, s, round(weight, 6) AS weight, CAST(n AS INTEGER) AS n FROM w")
def regrid_weights(spark, d):
    """Equal targets have the same weights, which are worked out once."""
    weight, of_t = _weights(spark, d)
    return W.each(weight.select("t", "s", r6("weight"), "n"), of_t, "t").select("t", "s", "weight", "n")


@query("regrid_apply", f"WITH {_BOX} SELECT t, p_size AS k, round(sum(weight * p_retailprice), 6) AS x FROM w JOIN part ON p_partkey = s GROUP BY 1, 2")
def regrid_apply(spark, d):
    """Equal targets have the same values, which are summed up once."""
    from gridtide.plans.base import table

    field = table(spark, d, "part").select(F.col("p_partkey").alias("s"), F.col("p_size").alias("k"), finite(F.col("p_retailprice")).alias("x"))
    weight, of_t = _weights(spark, d)
    return W.each(W.applied(weight, field, ["k"]).select("t", "k", r6("x")), of_t, "t").select("t", "k", "x")


#: Cells with four corners: by customer, a few of them about a pole.
_TARGETS = """q AS (SELECT c_custkey AS t, c_custkey % 500 = 7 AS pole, CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END AS sg, (c_custkey * 37 % 360)::DOUBLE - 179.687 AS lon0, (c_custkey * 17 % 179)::DOUBLE - 88.829 AS lat0, CASE WHEN c_custkey % 5 > 0 THEN 1 ELSE 0 END AS wet FROM customer),
tg AS (SELECT t, wet, pole, CASE WHEN pole THEN sg * 89.9 ELSE lat0 END AS lat,
 CASE WHEN pole THEN sg * 10.013 ELSE lon0 - 1.3 END AS lon1, CASE WHEN pole THEN sg * 100.013 ELSE lon0 + 1.17 END AS lon2, CASE WHEN pole THEN sg * 190.013 ELSE lon0 + 1.3 END AS lon3, CASE WHEN pole THEN sg * 280.013 ELSE lon0 - 1.43 END AS lon4,
 CASE WHEN pole THEN sg * 89.203 ELSE lat0 - 0.7 END AS lat1, CASE WHEN pole THEN sg * 89.203 ELSE lat0 - 0.56 END AS lat2, CASE WHEN pole THEN sg * 89.203 ELSE lat0 + 0.7 END AS lat3, CASE WHEN pole THEN sg * 89.203 ELSE lat0 + 0.63 END AS lat4 FROM q),
mk AS (SELECT p_partkey % 24 AS lat_ind, p_partkey // 24 % 48 AS lon_ind, CASE WHEN sum(p_size) % 3 > 0 THEN 1 ELSE 0 END AS wet FROM part GROUP BY 1, 2),
la AS (SELECT lat_ind, lat_ind * 7.5 - 86.25 AS lat, lat_ind * 7.5 - 90 AS lo, lat_ind * 7.5 - 82.5 AS hi FROM range(0, 24) t(lat_ind)), lo_ AS (SELECT lon_ind, lon_ind * 7.5 - 3.75 AS lo, lon_ind * 7.5 + 3.75 AS hi FROM range(0, 48) t(lon_ind))"""
_PLAIN = (
    "tb AS (SELECT t, wet, " + ", ".join(f"({e}[{i}] + {e}[{i + 1}]) / 2 AS {n}_{side}" for n, e in (("lat", "list_sort([lat1, lat2, lat3, lat4])"), ("lon", "list_sort([" + ", ".join(f"fmod(fmod(lon{k} - lon1 + 10, 360) + 360, 360) + lon1 - 10" for k in range(1, 5)) + "])")) for side, i in (("lo", 1), ("hi", 3))) + " FROM tg WHERE lat >= -70 AND lat < 60), "
    "po AS (SELECT t, tb.wet AS tw, mk.wet AS sw, mk.lat_ind, mk.lon_ind, 111100.0 * 111100.0 * cos(radians(la.lat)) * (least(lat_hi, la.hi) - greatest(lat_lo, la.lo)) * (least(lon_hi, lo_.hi + turn) - greatest(lon_lo, lo_.lo + turn)) AS area FROM tb JOIN la ON la.lo < lat_hi AND la.hi > lat_lo, lo_, (VALUES (-720), (-360), (0), (360)) v(turn), mk WHERE lo_.lo + turn < lon_hi AND lo_.hi + turn > lon_lo AND mk.lat_ind = la.lat_ind AND mk.lon_ind = lo_.lon_ind)"
)


def _angles() -> str:
    """Whether (x, y) is inside the quadrilateral of (x1, y1) to (x4, y4), by the angles at its corners."""
    out = []
    for k in range(1, 5):
        p, n = (k + 2) % 4 + 1, k % 4 + 1
        into = f"(atan2(y{k} - y{p}, x{k} - x{p}) - pi() + 1e-5)"
        turned = lambda a: f"(({a} - {into}) - 2 * pi() * floor(({a} - {into}) / (2 * pi())))"  # noqa: B023, E731
        out.append(f"{turned(f'atan2(y - y{k}, x - x{k})')} >= {turned(f'atan2(y{n} - y{k}, x{n} - x{k})')}")
    return " AND ".join(out)


_POINTS = (
    "pq AS (SELECT *, " + ", ".join(f"(90 - abs(lat{k})) * {f}(radians(sign(lat) * lon{k})) AS {c}{k}" for k in range(1, 5) for c, f in (("x", "cos"), ("y", "sin"))) + " FROM tg WHERE lat < -70 OR lat >= 60), "
    "pp AS (SELECT *, unnest(range(CAST(floor((CASE WHEN pole THEN 0 ELSE lon0 - 1.5 END) * 32) AS BIGINT), CAST(floor((CASE WHEN pole THEN 360 ELSE lon0 + 1.4 END) * 32) AS BIGINT))) AS k, rw FROM (SELECT pq.*, lon1 + 1.3 AS lon0, unnest(range(CAST(floor((CASE WHEN pole THEN 89.1 ELSE greatest(abs(lat1), abs(lat3)) - 1.6 END) * 32) AS BIGINT), CASE WHEN pole THEN 2880 ELSE least(2880, CAST(ceil((greatest(abs(lat1), abs(lat3)) + 0.1) * 32) AS BIGINT)) END)) AS rw FROM pq)), "
    "px AS (SELECT *, (k + 0.5) / 32 AS plon, sign(lat) * (rw + 0.5) / 32 AS plat FROM pp), "
    "py AS (SELECT *, (90 - abs(plat)) * cos(radians(sign(lat) * plon)) AS x, (90 - abs(plat)) * sin(radians(sign(lat) * plon)) AS y FROM px), "
    f"pi_ AS (SELECT t, wet AS tw, CAST(floor((plat + 90) / 7.5) AS BIGINT) AS lat_ind, CAST(floor((plon + 3.75) / 7.5) AS BIGINT) % 48 AS k0, 111100.0 * 111100.0 / 1024 * cos(radians(plat)) AS area FROM py WHERE {_angles()}), "
    "pw AS (SELECT t, tw, mk.wet AS sw, lat_ind, lon_ind, sum(area) AS area FROM (SELECT *, (k0 + 48) % 48 AS lon_ind FROM pi_) JOIN mk USING (lat_ind, lon_ind) GROUP BY ALL)"
)
_SHARES = "SELECT t, lat_ind, lon_ind, round(area / sum(area) OVER (PARTITION BY t), 6) AS weight, CAST(row_number() OVER (PARTITION BY t ORDER BY lat_ind, lon_ind) AS INTEGER) AS n FROM (SELECT *, max(CASE WHEN tw = sw THEN 1 ELSE 0 END) OVER (PARTITION BY t) AS k FROM {}) WHERE tw = sw OR k = 0"


def corner_grid(spark, d):
    """Targets with corners, the axes and the cells of a source grid."""
    from gridtide.plans.base import table

    k = F.col("c_custkey")
    pole, sign = k % 500 == 7, F.when(k % 2 == 0, -1).otherwise(1)
    lon0, lat0 = (k * 37 % 360).cast("double") - 179.687, (k * 17 % 179).cast("double") - 88.829
    lons = [F.when(pole, sign * a).otherwise(lon0 + b).alias(f"lon{i}") for i, (a, b) in enumerate(((10.013, -1.3), (100.013, 1.17), (190.013, 1.3), (280.013, -1.43)), 1)]
    lats = [F.when(pole, sign * 89.203).otherwise(lat0 + b).alias(f"lat{i}") for i, b in enumerate((-0.7, -0.56, 0.7, 0.63), 1)]
    targets = table(spark, d, "customer").select(k.alias("t"), F.when(pole, sign * 89.9).otherwise(lat0).alias("lat"), *lons, *lats, F.when(k % 5 > 0, 1).otherwise(0).alias("wet"))
    of = table(spark, d, "part").select((F.col("p_partkey") % 24).alias("lat_ind"), F.expr("p_partkey div 24 % 48").alias("lon_ind"), "p_size")
    mask = of.groupBy("lat_ind", "lon_ind").agg(F.when(F.sum("p_size") % 3 > 0, 1).otherwise(0).alias("wet"))
    return targets, spark.range(24).select(F.col("id").alias("lat_ind"), (F.col("id") * 7.5 - 86.25).alias("lat")), spark.range(48).select(F.col("id").alias("lon_ind"), (F.col("id") * 7.5).alias("lon")), mask


@query("polar_weights", f"WITH {_TARGETS}, {_POINTS} {_SHARES.format('pw')}")
def polar_weights(spark, d):
    """Cells about both poles, some of which hold a pole, by points."""
    targets, lats, lons, mask = corner_grid(spark, d)
    polar = targets.where((F.col("lat") < W.POLAR[0]) | (F.col("lat") >= W.POLAR[1]))
    rows = W.polar_overlaps(polar, W.axis_bounds(lats, "lat_ind", "lat"), W.axis_bounds(lons, "lon_ind", "lon", circle=360.0), mask)
    return W.weights(rows, ("lat_ind", "lon_ind")).select("t", "lat_ind", "lon_ind", r6("weight"), "n")


@query("regrid_weights_full", f"WITH {_TARGETS}, {_PLAIN}, {_POINTS}, al AS (SELECT t, tw, sw, lat_ind, lon_ind, area FROM po UNION ALL SELECT t, tw, sw, lat_ind, lon_ind, area FROM pw) {_SHARES.format('al')}")
def regrid_weights_full(spark, d):
    """All cells, from their corners: as boxes, across the date line too, and by points near the poles."""
    return W.grid_weights(*corner_grid(spark, d)).select("t", "lat_ind", "lon_ind", r6("weight"), "n")


_AREA = "111100.0 * 111100.0 * cos(radians((lat_lo + lat_hi) / 2)) * (lon_hi - lon_lo) * (lat_hi - lat_lo)"


@query(
    "regrid_weights_conservative",
    f"WITH {_BOX}, sa AS (SELECT s, {_AREA} AS s_area FROM s), ta AS (SELECT t, {_AREA} AS t_area FROM t), g AS (SELECT t, s, area, sum(area) OVER (PARTITION BY s) AS inc FROM o WHERE tw = 1), "
    "mid AS (SELECT s, (lon_lo + lon_hi) / 2 AS lon, (lat_lo + lat_hi) / 2 AS lat FROM s), tm AS (SELECT t, (lon_lo + lon_hi) / 2 AS lon, (lat_lo + lat_hi) / 2 AS lat FROM t WHERE wet = 1), "
    "nn AS (SELECT p.s, c.t, " + _DIST + " AS g FROM mid p JOIN tm c ON true), n1 AS (SELECT s, t FROM nn QUALIFY row_number() OVER (PARTITION BY s ORDER BY g, t) = 1), "
    "u AS (SELECT t, s, area / t_area * s_area / inc AS weight FROM g JOIN sa USING (s) JOIN ta USING (t) UNION ALL SELECT t, s, s_area / t_area FROM n1 JOIN sa USING (s) JOIN ta USING (t) WHERE s NOT IN (SELECT s FROM g)) SELECT t, s, round(weight, 6) AS weight FROM u",
)
def regrid_weights_conservative(spark, d):
    """Different boxes meet once; the weights of a pair of them go to all targets and sources that they stand for."""
    t, s = boxes(spark, d, "t"), boxes(spark, d, "s")
    area = W.METRES * W.METRES * F.cos(F.radians((F.col("lat_lo") + F.col("lat_hi")) / 2)) * (F.col("lon_hi") - F.col("lon_lo")) * (F.col("lat_hi") - F.col("lat_lo"))
    middle = [((F.col("lon_lo") + F.col("lon_hi")) / 2).alias("lon"), ((F.col("lat_lo") + F.col("lat_hi")) / 2).alias("lat")]
    (targets, of_t), (sources, of_s) = W.alike(t, "t"), W.alike(s, "s")
    targets, sources = W.written(targets), W.written(sources)
    places = W.written(t.where("wet = 1").select("t", *middle).groupBy("lon", "lat").agg(F.min("t").alias("t")))
    near = G.nearest_cell(sources.select("s", *middle), places, "s", "t").select("s", "t")
    met, s_area = W.overlaps(targets, sources), sources.select("s", area.alias("s_area"))
    direct = W.kept_shares(met.join(targets.select("t", "n").distinct(), "t"), s_area, targets.select("t", area.alias("t_area")), "n").select("t", "s", r6("weight"))
    lost = W.to_nearest(met, s_area, t.select("t", area.alias("t_area")), near).select("t", "s", r6("weight"))
    return W.each(W.each(direct, of_t, "t").unionByName(lost), of_s, "s").select("t", "s", "weight")


#: A field on the source grid: means by half-year of the shipments of a cell's parts.
_FIELD = "fl AS (SELECT l_partkey % 24 AS lat_ind, l_partkey // 24 % 48 AS lon_ind, CAST(year(l_shipdate) * 2 + (month(l_shipdate) - 1) // 6 AS BIGINT) AS h, avg(l_extendedprice) / 1e4 AS x FROM lineitem GROUP BY 1, 2, 3), vd AS (SELECT lat_ind, lon_ind FROM fl GROUP BY 1, 2 HAVING count(DISTINCT h) > 0.9 * (SELECT count(DISTINCT h) FROM fl))"


def grid_field(spark, d):
    """(lat_ind, lon_ind, h, x)."""
    from gridtide.plans.base import table

    k, at = F.col("l_partkey"), F.col("l_shipdate")
    half = (F.year(at) * 2 + F.floor((F.month(at) - 1) / F.lit(6))).cast("long")
    return table(spark, d, "lineitem").groupBy((k % 24).alias("lat_ind"), F.expr("l_partkey div 24 % 48").alias("lon_ind"), half.alias("h")).agg((F.avg("l_extendedprice") / 1e4).alias("x"))


@query(
    "altimetry_regrid",
    f"WITH {_TARGETS}, {_FIELD}, bx AS (SELECT c_custkey AS t, (c_custkey * 7 % 360)::DOUBLE - 178 AS lon_lo, (c_custkey * 7 % 360)::DOUBLE - 178 + 9.5 AS lon_hi, (c_custkey * 5 % 140)::DOUBLE - 70 AS lat_lo, (c_custkey * 5 % 140)::DOUBLE - 70 + 8.25 AS lat_hi FROM customer WHERE c_custkey % 4 > 0), "
    "wx AS (SELECT t, lon_ind, (least(lon_hi, lo_.hi + turn) - greatest(lon_lo, lo_.lo + turn)) / (lon_hi - lon_lo) AS wx FROM bx JOIN lo_ ON true JOIN (VALUES (-360), (0), (360)) v(turn) ON lo_.lo + turn < lon_hi AND lo_.hi + turn > lon_lo), "
    "wy AS (SELECT t, lat_ind, (least(lat_hi, la.hi) - greatest(lat_lo, la.lo)) / (lat_hi - lat_lo) * cos(radians((least(lat_hi, la.hi) + greatest(lat_lo, la.lo)) / 2)) AS wy FROM bx JOIN la ON la.lo < lat_hi AND la.hi > lat_lo), "
    "w AS (SELECT t, lat_ind, lon_ind, wx * wy / sum(wx * wy) OVER (PARTITION BY t) AS w FROM wx JOIN wy USING (t) JOIN vd USING (lat_ind, lon_ind)) SELECT t, h, round(sum(w * x), 6) AS x FROM w JOIN fl USING (lat_ind, lon_ind) GROUP BY 1, 2",
)
def altimetry_regrid(spark, d):
    """Wet targets take the field's valid cells by separable weights."""
    from gridtide.plans.base import table

    k = F.col("c_custkey")
    lon, lat = (k * 7 % 360).cast("double") - 178, (k * 5 % 140).cast("double") - 70
    boxes = table(spark, d, "customer").where(k % 4 > 0).select(k.alias("t"), lon.alias("lon_lo"), (lon + 9.5).alias("lon_hi"), lat.alias("lat_lo"), (lat + 8.25).alias("lat_hi"))
    _, lats, lons, _ = corner_grid(spark, d)
    field = grid_field(spark, d)
    valid = W.valid_cells(field, ["lat_ind", "lon_ind"], "h")
    weight = W.separable_weights(boxes, W.axis_bounds(lats, "lat_ind", "lat"), W.axis_bounds(lons, "lon_ind", "lon", circle=360.0), valid)
    return field.join(weight, ["lat_ind", "lon_ind"]).groupBy("t", "h").agg(rnd(F.sum(F.col("weight") * F.col("x"))).alias("x"))


@query(
    "region_mask_area",
    f"WITH {_TARGETS}, {_FIELD}, cw AS (SELECT t % 4 AS region, least(lat1, lat2, lat3, lat4) AS lat_lo, greatest(lat1, lat2, lat3, lat4) AS lat_hi, least(lon1, lon2, lon3, lon4) AS lon_lo, greatest(lon1, lon2, lon3, lon4) AS lon_hi FROM tg WHERE wet = 1 AND NOT pole), "
    "ar_ AS (SELECT region, lat_ind, lon_ind, sum(111100.0 * 111100.0 * cos(radians(la.lat)) * (least(lat_hi, la.hi) - greatest(lat_lo, la.lo)) * (least(lon_hi, lo_.hi + turn) - greatest(lon_lo, lo_.lo + turn))) AS area FROM cw JOIN la ON la.lo < lat_hi AND la.hi > lat_lo JOIN lo_ ON true JOIN (VALUES (-360), (0), (360)) v(turn) ON lo_.lo + turn < lon_hi AND lo_.hi + turn > lon_lo GROUP BY 1, 2, 3) "
    "SELECT region, lat_ind, lon_ind, round(CASE WHEN vd.lat_ind IS NULL THEN 0 ELSE area / 1e6 END, 3) AS area FROM ar_ LEFT JOIN vd USING (lat_ind, lon_ind)",
)
def region_mask_area(spark, d):
    """What wet targets cover of a source grid, by region, where the field has values at more than nine in ten times."""
    targets, lats, lons, _ = corner_grid(spark, d)
    wet = targets.where("wet = 1 and t % 500 <> 7").withColumn("region", F.col("t") % 4)
    valid = W.valid_cells(grid_field(spark, d), ["lat_ind", "lon_ind"], "h")
    out = W.mask_area(wet, W.axis_bounds(lats, "lat_ind", "lat"), W.axis_bounds(lons, "lon_ind", "lon", circle=360.0), valid, ["region"])
    return out.select("region", "lat_ind", "lon_ind", rnd(F.col("area") / 1e6, 3).alias("area"))


@query("regrid_apply_full", f"WITH {_TARGETS}, {_PLAIN}, {_POINTS}, {_FIELD}, al AS (SELECT t, tw, sw, lat_ind, lon_ind, area FROM po UNION ALL SELECT t, tw, sw, lat_ind, lon_ind, area FROM pw), wf AS (SELECT t, lat_ind, lon_ind, area / sum(area) OVER (PARTITION BY t) AS weight FROM (SELECT *, max(CASE WHEN tw = sw THEN 1 ELSE 0 END) OVER (PARTITION BY t) AS k FROM al) WHERE tw = sw OR k = 0) SELECT t, h, round(sum(weight * x), 6) AS x FROM wf JOIN fl USING (lat_ind, lon_ind) GROUP BY 1, 2")
def regrid_apply_full(spark, d):
    """A field on the cells with corners, by the weights of :func:`regrid_weights_full`."""
    return W.applied(W.grid_weights(*corner_grid(spark, d)), grid_field(spark, d), ["h"], source=("lat_ind", "lon_ind")).select("t", "h", r6("x"))


@query("bounds_from_centers", "WITH k AS (SELECT nation, cell, lat, lead(lat) OVER w - lat AS up, lat - lag(lat) OVER w AS dn FROM (SELECT nation, min(cell) AS cell, lat FROM ce GROUP BY nation, lat) WINDOW w AS (PARTITION BY nation ORDER BY lat)) SELECT nation, cell, round(lat - coalesce(dn, up) / 2, 6) AS lo, round(lat + coalesce(up, dn) / 2, 6) AS hi FROM k")
def bounds_from_centers(spark, d):
    rows = cells(spark, d).groupBy("nation", "lat").agg(F.min("cell").alias("cell"))
    return W.bounds_from_centres(rows, ["nation"], "lat").select("nation", "cell", r6("lo"), r6("hi"))
