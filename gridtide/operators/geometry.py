"""Longitudes, nearest cells, nested cells, regions, coasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KM_PER_DEGREE = 111.1


def wrapped(lon: Column, base: float) -> Column:
    """lon moved into [base, base + 360)."""
    return F.pmod(lon - base, F.lit(360.0)) + base


def planar_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Degrees, longitudes scaled by the cosine of the first latitude."""
    d = F.pmod(lon2 - lon1 + 180, F.lit(360.0)) - 180
    return F.sqrt(F.pow(F.cos(F.radians(lat1)) * d, 2) + F.pow(lat2 - lat1, 2))


SIDE = 60.0  # degrees of the squares that the search begins with; 6 by 3 of them
FINER = 4  # each level has squares of a quarter of the side
DEEPEST = 6


def _square(lon: Column, lat: Column, level: int) -> tuple[Column, Column]:
    side = SIDE / FINER**level
    return F.floor((lon + 180) / F.lit(side)).cast("long"), F.floor((lat + 90) / F.lit(side)).cast("long")


def _let(value: Column, use) -> Column:
    """use(value), value being worked out once a row, also where use has it within a function of an array's elements."""
    return F.transform(F.array(value), use)[0]


def _reachable(squares: Column, level: int) -> Column:
    """Those of an array of squares (x, y) that may hold the cell nearest to (plon, plat): no farther at least than any
    square is at most."""
    side = SIDE / FINER**level
    off_lon = lambda q: F.abs(F.pmod((q["x"] + 0.5) * side - F.col("plon"), F.lit(360.0)) - 180)
    off_lat = lambda q: F.abs((q["y"] + 0.5) * side - 90 - F.col("plat"))
    far = lambda c, a, b: c * a * a + b * b
    least = lambda c, q: far(c, F.greatest(F.lit(0.0), off_lon(q) - side / 2), F.greatest(F.lit(0.0), off_lat(q) - side / 2))
    most = lambda c, q: far(c, F.least(F.lit(180.0), off_lon(q) + side / 2), off_lat(q) + side / 2)
    told = _let(F.pow(F.cos(F.radians("plat")), 2), lambda c: F.transform(squares, lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), least(c, q).alias("least"), most(c, q).alias("most"))))
    near = lambda t, best: F.transform(F.filter(t, lambda q: q["least"] <= best * (1 + 1e-9) + 1e-9), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    return _let(told, lambda t: _let(F.array_min(F.transform(t, lambda q: q["most"])), lambda best: near(t, best)))


def nearest_cell(points: DataFrame, cells: DataFrame, point: str, cell: str, crowd: int = 256) -> DataFrame:
    """(point, cell, distance) of the nearest cell, however far; the smaller cell on ties.

    Points (point, lon, lat) look for cells (cell, lon, lat) in a tree of squares that is as deep as the cells are
    crowded: down to where a square holds no more than ``crowd`` places (or to squares of a hundredth of a degree). On
    each level a point goes on with those occupied squares only that can hold its nearest cell; where there is no cell
    for a long way, these are few and large. Cells of one place are one.
    """
    lon = wrapped(F.col("lon"), -180.0)
    places = cells.groupBy(lon.alias("clon"), F.col("lat").alias("clat")).agg(F.min(cell).alias(cell))
    squares = lambda level: places.groupBy(*(c.alias(n) for c, n in zip(_square(F.col("clon"), F.col("clat"), level), "xy", strict=True))).count()
    top = squares(0).where("x is not null and y is not null").collect()  # 24 at most
    depth, most = 0, max((r["count"] for r in top), default=0)
    while most > crowd and depth < DEEPEST:
        depth += 1
        most = squares(depth).agg(F.max("count")).first()[0]
    start = F.from_json(F.lit("[" + ",".join(f'{{"x":{a},"y":{b}}}' for a, b, _ in top) + "]"), "array<struct<x: bigint, y: bigint>>")
    rows = points.select(point, lon.alias("plon"), F.col("lat").alias("plat")).withColumn("_sq", _reachable(start, 0))
    for level in range(1, depth + 1):
        x, y = _square(F.col("clon"), F.col("clat"), level)
        within = places.select(x.alias("x"), y.alias("y")).distinct().groupBy(F.floor(F.col("x") / FINER).alias("_x"), F.floor(F.col("y") / FINER).alias("_y")).agg(F.collect_list(F.struct("x", "y")).alias("_in"))
        each = rows.withColumn("_q", F.explode("_sq")).select(point, "plon", "plat", F.col("_q.x").alias("_x"), F.col("_q.y").alias("_y")).join(within, ["_x", "_y"])
        rows = each.groupBy(point, "plon", "plat").agg(F.flatten(F.collect_list("_in")).alias("_sq")).withColumn("_sq", _reachable(F.col("_sq"), level))
    x, y = _square(F.col("clon"), F.col("clat"), depth)
    each = rows.withColumn("_q", F.explode("_sq")).select(point, "plon", "plat", F.col("_q.x").alias("_x"), F.col("_q.y").alias("_y"))
    both = each.join(places.withColumns({"_x": x, "_y": y}), ["_x", "_y"]).withColumn("d", planar_distance(F.col("plon"), F.col("plat"), F.col("clon"), F.col("clat")))
    return both.groupBy(point).agg(F.min(F.struct("d", F.col(cell).alias(cell))).alias("m")).select(point, f"m.{cell}", F.col("m.d").alias("distance"))


def nested_cells(grid: DataFrame, schemes: DataFrame) -> DataFrame:
    """grid (tile, j, i) with its cell: blocks of n_merge by n_merge of the first scheme that covers it.

    schemes (priority, n_merge, tile, j_lo, j_hi, i_lo, i_hi) has a few rows a tile; cells are numbered in order of
    priority, tile and block, ord counts the members of a cell. Uncovered points are left out. Running numbers are
    kept by priority and by tile, so no window holds more than the tiles of one priority.
    """
    s = F.broadcast(schemes) if schemes.limit(10_001).count() <= 10_000 else schemes
    hit = grid.join(s, "tile").where("j >= j_lo and j < j_hi and i >= i_lo and i < i_hi")
    hit = first_of(hit, ["tile", "j", "i"], "priority")
    hit = hit.withColumns({"bj": F.expr("cast(floor((j - j_lo) / n_merge) as int)"), "bi": F.expr("cast(floor((i - i_lo) / n_merge) as int)")})
    blocks = hit.groupBy("priority", "tile", "bj", "bi").agg(F.count("*").alias("size"))
    before = blocks.groupBy("priority", "tile").agg(F.count("*").alias("n"))
    earlier = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = before.groupBy("priority").agg(F.sum("n").alias("n")).select("priority", earlier(Window.orderBy("priority")).alias("_p"))  # a row a priority
    before = before.join(F.broadcast(ranks), "priority").withColumn("base", F.col("_p") + earlier(Window.partitionBy("priority").orderBy("tile"))).drop("_p")
    at = F.row_number().over(Window.partitionBy("priority", "tile").orderBy("bj", "bi"))
    blocks = blocks.join(before, ["priority", "tile"]).withColumn("cell", (F.col("base") + at - 1).cast("long"))
    order = F.row_number().over(Window.partitionBy("cell").orderBy("j", "i")) - 1
    return hit.join(blocks.select("priority", "tile", "bj", "bi", "cell", "size"), ["priority", "tile", "bj", "bi"]).withColumn("ord", order).select("cell", "tile", "j", "i", "ord", "size")


def combined(special: DataFrame, grid: DataFrame, schemes: DataFrame) -> DataFrame:
    """special (cell, tile, j, i, ord, size) first, then nested cells of the points that it leaves, numbered after it."""
    rest = nested_cells(grid.join(special.select("tile", "j", "i"), ["tile", "j", "i"], "left_anti"), schemes)
    base = special.agg((F.coalesce(F.max("cell"), F.lit(-1)) + 1).alias("_base"))  # one row
    rest = rest.crossJoin(F.broadcast(base)).withColumn("cell", F.col("cell") + F.col("_base")).select("cell", "tile", "j", "i", "ord", "size")
    return special.select("cell", "tile", "j", "i", "ord", "size").unionByName(rest)


def first_of(df: DataFrame, keys: list[str], priority: str) -> DataFrame:
    """The row of the smallest priority for the keys."""
    own = df.groupBy(*keys).agg(F.min(priority).alias(priority))
    return df.join(own, [*keys, priority])


def regions(lon: Column, lat: Column) -> Column:
    """Number of the first region of the north-west Atlantic that holds a point, or NULL."""
    inside = lambda lon0, width: F.pmod(lon - lon0, F.lit(360.0)) < width
    # Bounds of the regions, in order of priority; 6, the coast strip, is built from a coast line.
    rules = [
        (0, inside(-90, 1) & lat.between(28, 29.7)),
        (1, inside(-89, 7) & lat.between(22, 31)),
        (2, inside(-98, 9) & lat.between(18, 30)),
        (3, inside(-89, 28) & (lat >= 9) & (lat < 22) & (2 / 3 * (lon + 83) + (lat - 10) >= 0) & (0.25 * (lon + 72) + (lat - 20) <= 0)),
        (4, (F.pmod(lon + 3 / 23 * lat + 76, F.lit(360.0)) < 79) & lat.between(5, 25)),
        (5, inside(-82, 3) & lat.between(22, 27)),
        (7, inside(-80, 80) & lat.between(25, 35)),
        (8, inside(-80, 80) & (lat > 35) & (lat <= 45) & (-1.4 * (lon + 5.5) + (lat - 36) >= 0)),
        (9, (F.pmod(lon + 75, F.lit(360.0)) - (75 - 0.8 * (lat - 53.125)) < 0) & (lat > 45) & (lat <= 55)),
        (10, inside(-73, 93) & (lat > 55) & (lat <= 70)),
    ]
    out = F.when(rules[0][1], rules[0][0])
    for number, rule in rules[1:]:
        out = out.when(rule, number)
    return out


def centroids(members: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Mean longitude about the first member's, mean latitude and summed area of each cell."""
    first = members.groupBy(*keys).agg(F.min_by("lon", order).alias("lon0"))
    around = members.join(first, keys).withColumn("off", F.pmod(F.col("lon") - F.col("lon0") + 180, F.lit(360.0)) - 180)
    out = around.groupBy(*keys).agg(F.first("lon0").alias("lon0"), F.avg("off").alias("off"), F.avg("lat").alias("lat"), F.sum("area").alias("area"))
    return out.withColumn("lon", F.pmod(F.col("lon0") + F.col("off") + 180, F.lit(360.0)) - 180).select(*keys, "lon", "lat", "area")


def coast_faces(grid: DataFrame) -> DataFrame:
    """(tile, j, i, side) where wetness changes towards the next j (0) or i (1), with the mean place of both cells."""
    cols = ["tile", "j", "i", "lon", "lat", "wet"]
    out = None
    for side, name in enumerate(("j", "i")):
        other = grid.select(*[(F.col(c) - 1 if c == name else F.col(c)).alias(c if c in ("tile", "j", "i") else f"o_{c}") for c in cols])
        face = grid.select(*cols).join(other, ["tile", "j", "i"]).where("wet <> o_wet")
        face = face.select("tile", "j", "i", F.lit(side).alias("side"), ((F.col("lon") + F.col("o_lon")) / 2).alias("lon"), ((F.col("lat") + F.col("o_lat")) / 2).alias("lat"))
        out = face if out is None else out.unionByName(face)
    return out


def coast_strip(line: DataFrame, cells: DataFrame, km: float, right: bool = True) -> DataFrame:
    """Cells within km of a polyline (ord, lon, lat) on one side of it: next to a segment, or around its end points.

    Segments meet the cells of the bands of latitude that they reach.
    """
    reach = km / KM_PER_DEGREE
    w = Window.orderBy("ord")  # one coast line: some thousand points
    seg = line.select("ord", F.col("lon").alias("lon1"), F.col("lat").alias("lat1"), F.lead("lon").over(w).alias("lon2"), F.lead("lat").over(w).alias("lat2")).where("lon2 is not null")
    low, high = F.least("lat1", "lat2") - reach, F.greatest("lat1", "lat2") + reach
    seg = seg.withColumn("_b", F.explode(F.sequence(F.floor(low / F.lit(reach)), F.floor(high / F.lit(reach)))))
    near = seg.join(cells.withColumn("_b", F.floor(F.col("lat") / F.lit(reach))), "_b")
    scale = F.cos(F.radians((F.col("lat1") + F.col("lat2")) / 2))
    near = near.withColumns({"dx": (F.col("lon2") - F.col("lon1")) * scale, "dy": F.col("lat2") - F.col("lat1"), "px": (F.col("lon") - F.col("lon1")) * scale, "py": F.col("lat") - F.col("lat1")})
    size = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    along = F.try_divide(F.col("px") * F.col("dx") + F.col("py") * F.col("dy"), size)
    across = F.try_divide(F.col("px") * F.col("dy") - F.col("py") * F.col("dx"), size)
    off = across if right else -across
    beside = (along >= 0) & (along <= size) & (off >= 0) & (off <= reach)
    corner = (F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py")) <= reach) & (off >= 0)
    return near.where(beside | corner).select("cell").distinct()


def coast_line(faces: DataFrame, lon: tuple[float, float] = (-81.5, -66.4), lat: tuple[float, float] = (27.0, 45.0)) -> DataFrame:
    """(ord, lon, lat) of the faces of one coast from south to north, without the islands off it.

    Fixed values: the bounds of the east coast of the United States, and the line that parts it from the Bahamas.
    """
    own = faces.where((F.pmod(F.col("lon") - lon[0], F.lit(360.0)) <= lon[1] - lon[0]) & F.col("lat").between(*lat))
    own = own.where(-(F.col("lon") + 79) + (F.col("lat") - 25) >= 0)
    order = F.row_number().over(Window.orderBy(F.col("lat") + 0.001 * F.col("lon"), "lon"))  # one coast: some thousand points
    return own.select("lon", "lat").distinct().select(order.alias("ord"), "lon", "lat")


def regions_with_coast(cells: DataFrame, line: DataFrame, km: float = 300.0) -> DataFrame:
    """(cell, region) of cells (cell, lon, lat): those of :func:`regions`, and 6, the strip along a coast line, for cells
    that none of the regions before it holds."""
    strip = coast_strip(line, cells, km).withColumn("_coast", F.lit(True))
    own = regions(F.col("lon"), F.col("lat"))
    return cells.join(strip, "cell", "left").select("cell", F.when(own <= 5, own).when(F.col("_coast"), 6).otherwise(own).alias("region"))


def in_quad(x: Column, y: Column, corners: list[tuple[Column, Column]]) -> Column:
    """Whether (x, y) is inside a convex quadrilateral whose corners go round it."""
    sides = []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        sides.append((bx - ax) * (y - ay) - (by - ay) * (x - ax))
    left, right = sides[0] >= 0, sides[0] <= 0
    for s in sides[1:]:
        left, right = left & (s >= 0), right & (s <= 0)
    return left | right


def polar(lon: Column, lat: Column, north: bool = True) -> tuple[Column, Column]:
    """Plane coordinates about a pole, in degrees of latitude."""
    r = 90 - lat if north else 90 + lat
    return r * F.cos(F.radians(lon)), r * F.sin(F.radians(lon))
