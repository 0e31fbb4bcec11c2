"""Conservative regridding: overlap weights as a table, applied by a join and a sum."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridtide.functions.shared import new_path
from gridtide.operators.geometry import in_quad, nearest_cell, wrapped

METRES = 111100.0


def bounds_from_centres(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """lo and hi of each centre: half way to its neighbours, the outer ones as far as the inner ones."""
    w = Window.partitionBy(*keys).orderBy(at)
    up, down = F.lead(at).over(w) - F.col(at), F.col(at) - F.lag(at).over(w)
    return df.withColumns({"lo": F.col(at) - F.coalesce(down, up) / 2, "hi": F.col(at) + F.coalesce(up, down) / 2})


def square_side(*boxes: DataFrame) -> float:
    """A whole part of 360 degrees near twice the mean extent of boxes, within a twentieth of a degree and 30 degrees."""
    each = [b.select((F.col("lon_hi") - F.col("lon_lo")).alias("w"), (F.col("lat_hi") - F.col("lat_lo")).alias("h")) for b in boxes]
    mean = functools.reduce(DataFrame.unionByName, each).agg(F.avg((F.col("w") + F.col("h")) / 2)).first()[0]
    return 360.0 / min(7200, max(12, round(180.0 / mean))) if mean else 5.0


#: The columns of a box.
BOX = ("lon_lo", "lon_hi", "lat_lo", "lat_hi", "wet")


def alike(boxes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Each different box (key, BOX, n) once, where key is a group and n the number of its rows, and the members (key, _of)
    of the groups. What depends on boxes alone is so worked out once a group; :func:`each` hands it to the members.

    Boxes under keys of their own are a group if they are equal. A key in several rows is a group by itself, and its rows
    stay as they are: a sum by group is always that by key.
    """
    by_key = boxes.groupBy(key).agg(F.count("*").alias("_m"), F.first(F.struct(*BOX)).alias("_box"))
    once = F.col("_m") == 1
    box = F.concat_ws(",", *(F.coalesce(F.col(f"_box.{c}").cast("string"), F.lit("-")) for c in BOX))  # as text, which is shuffled as it is
    by_key = by_key.withColumn("_of", F.when(once, box).otherwise(F.coalesce(F.concat(F.lit("key "), F.col(key).cast("string")), F.lit("key"))))
    one = by_key.where(once).groupBy(F.col("_of").alias(key)).agg(F.first("_box").alias("_box"), F.count("*").alias("n")).select(key, "_box.*", "n")
    again = by_key.where(~once).select(F.col(key).alias("_key"), "_of")
    more = boxes.join(again, F.col(key).eqNullSafe(F.col("_key"))).select(F.col("_of").alias(key), *BOX, F.lit(1).cast("long").alias("n"))
    return one.unionByName(more), by_key.select(key, "_of")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: a few rows out of many, which are used several times, or on which costly
    conditions are put that Spark would work out on the many."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def each(rows: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """rows by group (key) for each member of the group, under the member's own key.

    Many rows come out of few, so the partitions are those of the session and are not put together by what goes in.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumnRenamed(key, "_of").repartition(n, "_of")
    return rows.join(members.repartition(n, "_of").hint("merge"), "_of").drop("_of")


def overlaps(target: DataFrame, source: DataFrame, cell: float | None = None) -> DataFrame:
    """Areas (t, s, area) where boxes (lon_lo, lon_hi, lat_lo, lat_hi, wet) of targets t and sources s overlap.

    Boxes are dealt to the grid squares of ``cell`` degrees that they touch, and meet only there; without ``cell`` the
    side comes from the boxes' own extent, so that a finer grid has no more boxes a square. Longitudes are a circle:
    a box from 179 to 181 meets those on both sides of the date line. Boxes are less than half a circle wide.
    """
    cell = square_side(target, source) if cell is None else cell
    turns = round(360 / cell)

    def dealt(df, p):
        square = lambda lo, hi: F.sequence(F.floor(F.col(lo) / F.lit(cell)), F.floor(F.col(hi) / F.lit(cell)))
        cols = [F.col(c).alias(f"{p}_{c}") for c in ("lon_lo", "lon_hi", "lat_lo", "lat_hi", "wet")]
        round_ = F.array_distinct(F.transform(square("lon_lo", "lon_hi"), lambda k: F.pmod(k, F.lit(turns))))
        return df.select(F.col(p), *cols, F.explode(round_).alias("_x"), F.col("lat_lo"), F.col("lat_hi")).withColumn("_y", F.explode(square("lat_lo", "lat_hi"))).drop("lat_lo", "lat_hi")

    both = dealt(target, "t").join(dealt(source, "s"), ["_x", "_y"])
    turned = 360 * F.rint((F.col("t_lon_lo") + F.col("t_lon_hi") - F.col("s_lon_lo") - F.col("s_lon_hi")) / 720)
    lo_x, hi_x = F.greatest("t_lon_lo", F.col("s_lon_lo") + turned), F.least("t_lon_hi", F.col("s_lon_hi") + turned)
    lo_y, hi_y = F.greatest("t_lat_lo", "s_lat_lo"), F.least("t_lat_hi", "s_lat_hi")
    own = (F.pmod(F.floor(lo_x / F.lit(cell)), F.lit(turns)) == F.col("_x")) & (F.floor(lo_y / F.lit(cell)) == F.col("_y"))  # in one square only
    area = METRES * METRES * F.cos(F.radians((lo_y + hi_y) / 2)) * (hi_x - lo_x) * (hi_y - lo_y)
    return both.where((hi_x > lo_x) & (hi_y > lo_y) & own).select("t", "s", "t_wet", "s_wet", area.alias("area"))


def weights(overlap: DataFrame, source: tuple[str, ...] = ("s",)) -> DataFrame:
    """(t, source, weight, n): sources of the target's own kind, wet or dry, or all if it has none; weights sum up to 1."""
    w = Window.partitionBy("t")
    same = F.col("t_wet") == F.col("s_wet")
    kept = overlap.withColumn("_any", F.max(same.cast("int")).over(w)).where(same | (F.col("_any") == 0))
    n = F.row_number().over(w.orderBy(*source))
    return kept.select("t", *source, (F.col("area") / F.sum("area").over(w)).alias("weight"), n.alias("n"))


def axis_bounds(axis: DataFrame, ind: str, at: str, circle: float | None = None, ends: tuple[float, float] = (-90.0, 90.0)) -> DataFrame:
    """axis (ind, at) with lo and hi, half way to the neighbours; the outer ones end at ``ends``, or meet on a circle."""
    w = Window.orderBy(at)  # one axis of a grid: some thousand places
    before, after = F.lag(at).over(w), F.lead(at).over(w)
    rows = axis.withColumns({"_before": before, "_after": after})
    if circle:
        first, last = (f(at).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for f in (F.min, F.max))
        rows = rows.withColumns({"_before": F.coalesce("_before", last - circle), "_after": F.coalesce("_after", first + circle)})
    lo, hi = (F.col(at) + F.col("_before")) / 2, (F.col(at) + F.col("_after")) / 2
    return rows.withColumns({"lo": F.coalesce(lo, F.lit(ends[0])), "hi": F.coalesce(hi, F.lit(ends[1]))}).drop("_before", "_after")


def axis_overlap(boxes: DataFrame, lo: str, hi: str, axis: DataFrame, ind: str, width: str, circle: float | None = None, bin: float = 2.0, also: tuple[str, ...] = ()) -> DataFrame:
    """boxes with the cells of an axis (ind, lo, hi) that their range lo to hi overlaps, and the width of that overlap.

    Ranges and cells meet in bins of ``bin`` degrees; on a circle bins go round, and cells are turned next to the range.
    """
    turns = None if circle is None else int(circle // bin)

    def bins(low, high):
        some = F.sequence(F.floor(low / F.lit(bin)), F.floor(high / F.lit(bin)))
        return F.explode(some if turns is None else F.array_distinct(F.transform(some, lambda k: F.pmod(k, F.lit(turns)))))

    cells = axis.select(ind, *also, F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), bins(F.col("lo"), F.col("hi")).alias("_bin"))
    both = boxes.withColumn("_bin", bins(F.col(lo), F.col(hi))).join(cells, "_bin")
    turned = F.lit(0.0) if circle is None else circle * F.rint((F.col(lo) + F.col(hi) - F.col("_lo") - F.col("_hi")) / (2 * circle))
    both = both.withColumns({"_from": F.greatest(F.col(lo), F.col("_lo") + turned), "_to": F.least(F.col(hi), F.col("_hi") + turned)})
    at = F.floor(F.col("_from") / F.lit(bin))
    own = (at if turns is None else F.pmod(at, F.lit(turns))) == F.col("_bin")  # in one bin only
    return both.where((F.col("_to") > F.col("_from")) & own).withColumn(width, F.col("_to") - F.col("_from")).drop("_bin", "_lo", "_hi", "_from", "_to")


def separable_weights(boxes: DataFrame, lats: DataFrame, lons: DataFrame, valid: DataFrame) -> DataFrame:
    """(t, lat_ind, lon_ind, weight) of boxes (t, lon_lo, lon_hi, lat_lo, lat_hi) on a grid with the axes lats (lat_ind, lo,
    hi) and lons (lon_ind, lo, hi): the shares of the range of longitude and of latitude, the latter by the cosine of the
    middle of the part, over the valid cells (lat_ind, lon_ind), scaled to sum up to 1.

    The two ranges are met with their axes one by one, each different range once, and multiplied after that.
    """
    across = axis_overlap(boxes.select("lon_lo", "lon_hi").distinct(), "lon_lo", "lon_hi", lons, "lon_ind", "_dlon", circle=360.0)
    along = axis_overlap(boxes.select("lat_lo", "lat_hi").distinct(), "lat_lo", "lat_hi", lats, "lat_ind", "_dlat", also=("lo", "hi"))
    middle = (F.greatest("lat_lo", "lo") + F.least("lat_hi", "hi")) / 2
    across = across.select("lon_lo", "lon_hi", "lon_ind", (F.col("_dlon") / (F.col("lon_hi") - F.col("lon_lo"))).alias("_wx"))
    along = along.select("lat_lo", "lat_hi", "lat_ind", (F.col("_dlat") / (F.col("lat_hi") - F.col("lat_lo")) * F.cos(F.radians(middle))).alias("_wy"))
    rows = boxes.select("t", "lon_lo", "lon_hi", "lat_lo", "lat_hi").join(along, ["lat_lo", "lat_hi"]).join(across, ["lon_lo", "lon_hi"])
    rows = rows.join(valid.select("lat_ind", "lon_ind"), ["lat_ind", "lon_ind"]).withColumn("_w", F.col("_wx") * F.col("_wy"))
    return rows.select("t", "lat_ind", "lon_ind", (F.col("_w") / F.sum("_w").over(Window.partitionBy("t"))).alias("weight"))


def valid_cells(field: DataFrame, keys: list[str], at: str, share: float = 0.9, value: str = "x") -> DataFrame:
    """Cells (keys) of a field that have values at more than ``share`` of all its times."""
    times = field.agg(F.count_distinct(at).alias("_all"))  # one row
    own = field.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count_distinct(at).alias("_n"))
    return own.crossJoin(F.broadcast(times)).where(F.col("_n") > share * F.col("_all")).select(*keys)


def mask_area(targets: DataFrame, lats: DataFrame, lons: DataFrame, valid: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, lat_ind, lon_ind, area): the area of a source grid's cells that the outer boxes of targets (keys, lon1, lat1
    ... lon4, lat4) cover, summed by keys; 0 in cells that are not valid. Areas are those at the latitude of the source."""
    base = F.col("lon1") - 180
    lons_of = [wrapped(F.col(f"lon{k}"), base) for k in CORNERS]
    lats_of = [F.col(f"lat{k}") for k in CORNERS]
    boxes = targets.select(*keys, F.least(*lons_of).alias("lon_lo"), F.greatest(*lons_of).alias("lon_hi"), F.least(*lats_of).alias("lat_lo"), F.greatest(*lats_of).alias("lat_hi"))
    rows = axis_overlap(boxes, "lat_lo", "lat_hi", lats, "lat_ind", "_dlat", also=("lat",))
    rows = axis_overlap(rows, "lon_lo", "lon_hi", lons, "lon_ind", "_dlon", circle=360.0)
    rows = rows.groupBy(*keys, "lat_ind", "lon_ind").agg(F.sum(METRES * METRES * F.cos(F.radians("lat")) * F.col("_dlat") * F.col("_dlon")).alias("area"))
    ok = valid.select("lat_ind", "lon_ind", F.lit(True).alias("_ok"))
    return rows.join(ok, ["lat_ind", "lon_ind"], "left").select(*keys, "lat_ind", "lon_ind", F.when(F.col("_ok"), F.col("area")).otherwise(0.0).alias("area"))


CORNERS = range(1, 5)


def corner_boxes(targets: DataFrame) -> DataFrame:
    """targets with the box of their corners (lon1, lat1, ... lon4, lat4): between the means of the two least and of the
    two largest latitudes, and so for longitudes, turned to follow the first corner from 10 degrees before it."""
    base = F.col("lon1") - 10
    lats = F.sort_array(F.array(*(F.col(f"lat{k}") for k in CORNERS)))
    lons = F.sort_array(F.array(*(wrapped(F.col(f"lon{k}"), base) for k in CORNERS)))
    out = {}
    for name, some in (("lat", lats), ("lon", lons)):
        out |= {f"{name}_lo": (some[0] + some[1]) / 2, f"{name}_hi": (some[2] + some[3]) / 2}
    return targets.withColumns(out)


def corner_overlaps(targets: DataFrame, lats: DataFrame, lons: DataFrame, mask: DataFrame) -> DataFrame:
    """(t, lat_ind, lon_ind, t_wet, s_wet, area) of targets (t, corners, wet) taken for boxes of latitude and longitude.

    lats (lat_ind, lat, lo, hi) and lons (lon_ind, lo, hi) are the axes of the source, mask (lat_ind, lon_ind, wet) its
    cells. Areas are those at the latitude of the source cell.
    """
    boxes = corner_boxes(targets).select("t", F.col("wet").alias("t_wet"), "lat_lo", "lat_hi", "lon_lo", "lon_hi")
    rows = axis_overlap(boxes, "lat_lo", "lat_hi", lats, "lat_ind", "_dlat", also=("lat",))
    rows = axis_overlap(rows, "lon_lo", "lon_hi", lons, "lon_ind", "_dlon", circle=360.0)
    rows = rows.join(mask.select("lat_ind", "lon_ind", F.col("wet").alias("s_wet")), ["lat_ind", "lon_ind"])
    area = METRES * METRES * F.cos(F.radians("lat")) * F.col("_dlat") * F.col("_dlon")
    return rows.select("t", "lat_ind", "lon_ind", "t_wet", "s_wet", area.alias("area"))


def polar_overlaps(targets: DataFrame, lats: DataFrame, lons: DataFrame, mask: DataFrame, per_degree: int = 32) -> DataFrame:
    """As :func:`corner_overlaps`, but by points: those of a lattice of ``per_degree`` points a degree that are inside the
    quadrilateral of the corners on the plane about the pole, each with the area that it stands for.

    A target makes the points of the rings and the arc that it reaches, so nothing is shuffled before the points are
    summed by source cell; a target that holds the pole makes whole rings.
    """
    step = 1.0 / per_degree
    north = F.col("lat1") + F.col("lat2") + F.col("lat3") + F.col("lat4") >= 0
    radius = lambda lat: F.when(F.col("_north"), 90 - lat).otherwise(90 + lat)
    plane = lambda lon, r: (r * F.cos(F.radians(lon)), r * F.sin(F.radians(lon)))
    rows = targets.withColumn("_north", north)
    corners = [plane(F.col(f"lon{k}"), radius(F.col(f"lat{k}"))) for k in CORNERS]
    rows = rows.withColumns({f"_{c}{k}": v for k, xy in zip(CORNERS, corners, strict=True) for c, v in zip("xy", xy, strict=True)})
    quad = [(F.col(f"_x{k}"), F.col(f"_y{k}")) for k in CORNERS]
    rows = rows.withColumn("_pole", in_quad(F.lit(0.0), F.lit(0.0), quad))
    off = [F.pmod(F.col(f"lon{k}") - F.col("lon1") + 180, F.lit(360.0)) - 180 for k in CORNERS]
    far = F.greatest(*(radius(F.col(f"lat{k}")) for k in CORNERS))
    arc = (F.greatest(*off) - F.least(*off)) / 2
    near = F.when(F.col("_pole"), F.lit(0.0)).otherwise(F.least(*(radius(F.col(f"lat{k}")) for k in CORNERS)) * F.cos(F.radians(arc)))
    west, east = F.col("lon1") + F.least(*off), F.col("lon1") + F.greatest(*off)
    whole = F.sequence(F.lit(0).cast("long"), F.lit(360 * per_degree - 1).cast("long"))
    some = F.sequence(F.floor(west / step), F.floor(east / step))
    rows = rows.withColumn("_ring", F.explode(F.sequence(F.floor(near / step), F.least(F.floor(far / step), F.lit(90 * per_degree - 1).cast("long")))))
    rows = rows.withColumn("_k", F.explode(F.when(F.col("_pole"), whole).otherwise(some)))
    lon, r = (F.col("_k") + 0.5) * step, (F.col("_ring") + 0.5) * step
    rows = rows.where(in_quad(*plane(lon, r), quad))
    rows = rows.select("t", F.col("wet").alias("t_wet"), F.pmod("_k", F.lit(360 * per_degree)).alias("_k"), F.when(F.col("_north"), 90 * per_degree - 1 - F.col("_ring")).otherwise(F.col("_ring") - 90 * per_degree).alias("_row"))
    ring = F.explode(F.sequence(F.ceil(F.col("lo") / step - 0.5), F.ceil(F.col("hi") / step - 0.5) - 1))
    of_lat = lats.where("hi > lo").select("lat_ind", ring.alias("_row"))
    side = F.explode(F.sequence(F.ceil(F.col("lo") / step - 0.5), F.ceil(F.col("hi") / step - 0.5) - 1))
    of_lon = lons.where("hi > lo").select("lon_ind", side.alias("_k")).withColumn("_k", F.pmod("_k", F.lit(360 * per_degree)))
    counts = rows.join(F.broadcast(of_lat), "_row").join(F.broadcast(of_lon), "_k")  # a row a ring or meridian of the lattice
    point = METRES * METRES * step * step * F.cos(F.radians((F.col("_row") + 0.5) * step))
    counts = counts.groupBy("t", "t_wet", "lat_ind", "lon_ind").agg(F.sum(point).alias("area"))
    return counts.join(mask.select("lat_ind", "lon_ind", F.col("wet").alias("s_wet")), ["lat_ind", "lon_ind"]).select("t", "lat_ind", "lon_ind", "t_wet", "s_wet", "area")


#: Targets south or north of these latitudes are met by points (fixed values).
POLAR = (-70.0, 60.0)


def grid_weights(targets: DataFrame, lats: DataFrame, lons: DataFrame, mask: DataFrame, per_degree: int = 32) -> DataFrame:
    """(t, lat_ind, lon_ind, weight, n) of targets (t, lat, lon1, lat1 ... lon4, lat4, wet) from a source grid with the
    axes lats (lat_ind, lat) and lons (lon_ind, lon) and the cells mask (lat_ind, lon_ind, wet).

    Near the poles cells are met by points, elsewhere as boxes, also across the date line.
    """
    lats, lons = axis_bounds(lats, "lat_ind", "lat"), axis_bounds(lons, "lon_ind", "lon", circle=360.0)
    polar = (F.col("lat") < POLAR[0]) | (F.col("lat") >= POLAR[1])
    own = corner_overlaps(targets.where(~polar), lats, lons, mask).unionByName(polar_overlaps(targets.where(polar), lats, lons, mask, per_degree))
    return weights(own, ("lat_ind", "lon_ind"))


def kept_shares(overlap: DataFrame, source_area: DataFrame, target_area: DataFrame, times: str | None = None) -> DataFrame:
    """(t, s, weight): overlap over target area among wet targets, scaled so that what falls on dry ones is not lost. A row
    counts ``times`` times in the scale, where it stands for so many targets."""
    counted = F.col("area") * F.col(times) if times else F.col("area")
    rows = overlap.where("t_wet = 1").withColumn("_in", F.sum(counted).over(Window.partitionBy("s"))).join(source_area, "s").join(target_area, "t")
    return rows.select("t", "s", (F.col("area") / F.col("t_area") * F.col("s_area") / F.col("_in")).alias("weight"))


def to_nearest(overlap: DataFrame, source_area: DataFrame, target_area: DataFrame, nearest: DataFrame) -> DataFrame:
    """(t, s, weight) of sources without a wet target, which go to their nearest one (s, t)."""
    lost = source_area.join(overlap.where("t_wet = 1").select("s").distinct(), "s", "left_anti").join(nearest, "s").join(target_area, "t")
    return lost.select("t", "s", (F.col("s_area") / F.col("t_area")).alias("weight"))


def conserving(overlap: DataFrame, source_area: DataFrame, target_area: DataFrame, nearest: DataFrame) -> DataFrame:
    """(t, s, weight) that keep each source's total: :func:`kept_shares`, and :func:`to_nearest` for sources without any."""
    return kept_shares(overlap, source_area, target_area).unionByName(to_nearest(overlap, source_area, target_area, nearest))


def river_rule(lat_ind, lon_ind):
    """Which targets a source cell of the river grid may go to: 0 any, 1 to 3 see :data:`RIVER_TARGETS`, NULL none.

    Fixed values: boxes on a grid of a quarter degree around the Gulf of California, the Black and the Caspian Sea, the
    Baltic, Penzhina Bay and the Gulf of Ob, in this order.
    """
    gulf = (F.abs(lat_ind - 484) <= 4) & (F.abs(lon_ind - 986) <= 6)
    black = (lat_ind - (-20 / 120 * (lon_ind - 108) + 520) > 0) & (lat_ind < 552) & (F.abs(lon_ind - 168) <= 60)
    baltic = (F.abs(lat_ind - 598) <= 26) & (F.abs(lon_ind - 80) < 44) & ((lat_ind < 584) | (lon_ind >= 54))
    bay = (F.abs(lat_ind - 606) <= 6) & (F.abs(lon_ind - 650) <= 10)
    ob = (F.abs(lat_ind - 632) <= 10) & (F.abs(lon_ind - 296) <= 20)
    return F.when(gulf, 1).when(black | baltic, F.lit(None).cast("int")).when(bay, 2).when(ob, 3).otherwise(0)


#: Conditions on the longitude and latitude of targets (fixed values).
RIVER_TARGETS = {
    0: lambda lon, lat: F.lit(True),
    1: lambda lon, lat: F.pmod(lon + 115, F.lit(360.0)) < 180,
    2: lambda lon, lat: lon - (lat - 60 + 163) <= 0,
    3: lambda lon, lat: lon - 71 >= 0,
}


def river_targets(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(s, t) of the target (t, lon, lat) nearest to each source (s, lat_ind, lon_ind, lon, lat) that may take it."""
    rows = sources.withColumn("_rule", river_rule(F.col("lat_ind"), F.col("lon_ind")))
    out = None
    for rule, fits in RIVER_TARGETS.items():
        near = nearest_cell(rows.where(F.col("_rule") == rule), targets.where(fits(F.col("lon"), F.col("lat"))), "s", "t").select("s", "t")
        out = near if out is None else out.unionByName(near)
    return out


def applied(weight: DataFrame, field: DataFrame, keys: list[str], value: str = "x", source: tuple[str, ...] = ("s",)) -> DataFrame:
    """Sums of weight times value by target and keys; targets without a weight have no row. source names the columns by
    which weights and field meet."""
    return field.join(weight, [*source]).groupBy("t", *keys).agg(F.sum(F.col("weight") * F.col(value)).alias(value))
