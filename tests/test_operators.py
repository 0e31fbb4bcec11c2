"""Operators on a few rows: missing values, ties, single values, the date line, and invariants."""

from __future__ import annotations

import datetime as dt
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.functions import special
from gridtide.functions.nulls import finite, without_sentinel
from gridtide.operators import alignment as L
from gridtide.operators import attribution as A
from gridtide.operators import filters as X
from gridtide.operators import geometry as G
from gridtide.operators import references
from gridtide.operators import regrid as W
from gridtide.operators import resample as R
from gridtide.operators import stats as S
from gridtide.operators import timejoin as J
from gridtide.sources import fluxes, grids, series, tables
from gridtide.streaming import means


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_missing_values(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, float("inf")), (1, 2.0), (2, None)], "k int, x double").withColumn("x", finite(F.col("x")))
    assert rows(S.masked_mean(df, ["k"]), "k") == [(1, 2.0, 1), (2, None, 0)]
    assert {r[0] for r in df.select(without_sentinel(F.col("x"), most=1.0)).collect()} == {None}


def test_trend_and_detrend(spark):
    df = spark.createDataFrame([("a", t, 2.0 * t + 1) for t in range(5)] + [("b", 3, 7.0)], "k string, t int, x double")
    got = {r["k"]: r for r in S.trend(df, ["k"], "t", delta=0.5).collect()}
    assert got["a"]["slope"] == pytest.approx(4.0) and got["b"]["slope"] is None
    assert max(abs(r["resid"]) for r in S.detrended(df, ["k"], "t").collect()) < 1e-12


def test_variance_explained_is_shift_invariant(spark):
    rng = np.random.default_rng(0)
    data = [(i, float(b), float(p)) for i, (b, p) in enumerate(rng.normal(size=(40, 2)))]
    df = spark.createDataFrame(data, "i int, b double, p double").withColumn("k", F.lit(1))
    a = S.variance_explained(df, ["k"], "b", "p").first()["varexp"]
    b = S.variance_explained(df.withColumn("p", F.col("p") + 5), ["k"], "b", "p").first()["varexp"]
    x = np.array(data)
    assert a == pytest.approx(1 - np.var(x[:, 1] - x[:, 2]) / np.var(x[:, 1])) and a == pytest.approx(b)


def test_nearest_takes_the_earlier_of_two(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 100.0)], "id int, a double")
    right = spark.createDataFrame([(7, 8.0), (8, 12.0), (9, 12.0)], "r int, b double")
    assert rows(J.nearest(left, right, [], "a", "b", ["id"], "r").select("id", "r"), "id") == [(1, 7), (2, 8)]
    assert rows(J.nearest(left, right, [], "a", "b", ["id"], "r", 5).select("id", "r"), "id") == [(1, 7)]
    assert J.nearest(left, right.limit(0), [], "a", "b", ["id"], "r").where("r is not null").count() == 0


def test_unique_within(spark):
    left = spark.createDataFrame([(1, 10.0), (2, 50.0), (3, 90.0)], "id int, a double").withColumn("k", F.lit(1))
    right = spark.createDataFrame([(7, 9.0), (8, 49.0), (9, 51.0)], "r int, b double").withColumn("k", F.lit(1))
    assert rows(J.unique_within(left, right, ["k"], "a", "b", 3, ["id"]).select("id", "r"), "id") == [(1, 7)]


def test_week_lattice_and_versions(spark):
    df = spark.createDataFrame([(694224000, 1.0), (694224000 + 604799, 3.0), (694224000 - 1, 9.0)], "s long, x double").withColumn("k", F.lit(1))
    assert rows(R.weekly_mean(df, ["k"]).select("week", "mean"), "week") == [(694224000 - 604800, 9.0), (694224000, 2.0)]
    v = spark.createDataFrame([(1, 1, 5.0), (1, 5, 6.0), (1, 5, None), (2, 1, None), (2, 5, 4.0)], "h int, v int, x double")
    assert {(r["h"], r["v"]) for r in R.best_version(v, ["h"], "v").collect()} == {(1, 1), (2, 5)}


def test_longitudes_and_nearest_cell(spark):
    assert spark.range(1).select(G.wrapped(F.lit(-190.5), -180.0)).first()[0] == pytest.approx(169.5)
    p = spark.createDataFrame([(1, 179.9, 0.0)], "p int, lon double, lat double")
    c = spark.createDataFrame([(1, -179.9, 0.0), (2, 178.0, 0.0)], "c int, lon double, lat double")
    assert G.nearest_cell(p, c, "p", "c").first()["c"] == 1


def test_nested_cells_cover_once(spark):
    grid = spark.range(64).select(F.lit(0).alias("tile"), (F.col("id") / 8).cast("int").alias("j"), (F.col("id") % 8).cast("int").alias("i"))
    schemes = spark.createDataFrame([(1, 2, 0, 0, 4, 0, 4), (2, 3, 0, 0, 8, 0, 8)], "priority int, n_merge int, tile int, j_lo int, j_hi int, i_lo int, i_hi int")
    out = G.nested_cells(grid, schemes)
    assert out.count() == 64 == out.select("j", "i").distinct().count()
    assert sorted(r["cell"] for r in out.select("cell").distinct().collect()) == list(range(out.select("cell").distinct().count()))


def test_point_in_quad(spark):
    corners = [(F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0))]
    r = spark.range(1).select(G.in_quad(F.lit(1.0), F.lit(0.5), corners), G.in_quad(F.lit(3.0), F.lit(0.5), corners)).first()
    assert tuple(r) == (True, False)


def boxes(spark, name, items):
    return spark.createDataFrame(items, f"{name} int, lon_lo double, lon_hi double, lat_lo double, lat_hi double, wet int")


def test_weights_sum_to_one_and_conserve(spark):
    t = boxes(spark, "t", [(1, 0.0, 2.0, 0.0, 2.0, 1), (2, 2.0, 4.0, 0.0, 2.0, 0), (3, 20.0, 21.0, 0.0, 1.0, 1)])
    s = boxes(spark, "s", [(1, -1.0, 1.0, -1.0, 1.0, 1), (2, 1.0, 3.0, 0.0, 2.0, 0), (3, 2.5, 3.5, 0.5, 1.5, 1), (4, 19.0, 19.5, 0.0, 1.0, 1)])
    overlap = W.overlaps(t, s)
    for r in W.weights(overlap).groupBy("t").agg(F.sum("weight").alias("w")).collect():
        assert r["w"] == pytest.approx(1.0)
    area = lambda df, k: df.select(k, ((F.col("lon_hi") - F.col("lon_lo")) * (F.col("lat_hi") - F.col("lat_lo"))).alias(f"{k}_area"))
    near = s.select("s").withColumn("t", F.lit(3))
    w = W.conserving(overlap, area(s, "s"), area(t, "t"), near).join(area(t, "t"), "t")
    for r in w.groupBy("s").agg(F.sum(F.col("weight") * F.col("t_area")).alias("a")).join(area(s, "s"), "s").collect():
        assert r["a"] == pytest.approx(r["s_area"])


def _box(spark, name, lon, lat, size, wet=1):
    return spark.createDataFrame([(1, lon, lon + size, lat, lat + size, wet)], f"{name} int, lon_lo double, lon_hi double, lat_lo double, lat_hi double, wet int")


@pytest.mark.parametrize("lon", [-181.0, 179.0])
def test_overlaps_across_the_date_line(spark, lon):
    other = _box(spark, "s", -180.5, 0.0, 1.0).unionByName(_box(spark, "s", 179.5, 0.0, 0.25).withColumn("s", F.lit(2)))
    got = {r["s"]: r["area"] for r in W.overlaps(_box(spark, "t", lon, 0.0, 2.0), other).collect()}
    unit = W.METRES**2 * math.cos(math.radians(0.5))
    assert got == {1: pytest.approx(unit), 2: pytest.approx(W.METRES**2 * math.cos(math.radians(0.125)) / 16)}


def _grid_axes(spark, step):
    n, m = int(180 / step), int(360 / step)
    lats = spark.createDataFrame([(k, -90 + (k + 0.5) * step) for k in range(n)], "lat_ind int, lat double")
    lons = spark.createDataFrame([(k, k * step) for k in range(m)], "lon_ind int, lon double")
    mask = spark.createDataFrame([(i, j, (i + j) % 2) for i in range(n) for j in range(m)], "lat_ind int, lon_ind int, wet int")
    return lats, lons, mask


def test_weights_from_corners(spark):
    """Date line, both poles, a cell that holds a pole, a target without a source of its kind."""
    names = "t int, lat double, " + ", ".join(f"lon{k} double, lat{k} double" for k in range(1, 5)) + ", wet int"
    quad = lambda t, lon, lat, w, wet=1: (t, lat, lon - w, lat - w, lon + w, lat - w, lon + w, lat + w, lon - w, lat + w, wet)
    pole = lambda t, s: (t, s * 89.95, s * 5.0, s * 89.1, s * 95.0, s * 89.1, s * 185.0, s * 89.1, s * 275.0, s * 89.1, 1)
    data = [quad(1, 180.0, 10.0, 1.0), quad(2, -0.5, -20.0, 2.0), quad(3, 33.0, 75.0, 0.8), quad(4, -179.9, -80.0, 0.7), pole(5, 1), pole(6, -1), quad(7, 10.0, 12.0, 0.3, 0)]
    out = W.grid_weights(spark.createDataFrame(data, names), *_grid_axes(spark, 10.0)).collect()
    total = {t: sum(r["weight"] for r in out if r["t"] == t) for t in range(1, 8)}
    assert total == {t: pytest.approx(1.0) for t in range(1, 8)}
    assert {(r["lat_ind"], r["lon_ind"]) for r in out if r["t"] == 1} <= {(9, 18), (10, 18)} and {r["lon_ind"] for r in out if r["t"] == 2} <= {0, 35}
    assert len({r["lon_ind"] for r in out if r["t"] == 5}) == 18 and {r["lat_ind"] for r in out if r["t"] == 5} == {17} and {r["lat_ind"] for r in out if r["t"] == 6} == {0}
    assert [(r["lat_ind"], r["lon_ind"]) for r in out if r["t"] == 7] == [(10, 1)]


def test_polar_points_fill_the_cell(spark):
    """The points inside a small cell about the pole stand for about its area, whatever its corners' order."""
    lats, lons, _ = _grid_axes(spark, 30.0)
    mask = spark.createDataFrame([(i, j, 1) for i in range(6) for j in range(12)], "lat_ind int, lon_ind int, wet int")
    lats, lons = W.axis_bounds(lats, "lat_ind", "lat"), W.axis_bounds(lons, "lon_ind", "lon", circle=360.0)
    names = "t int, " + ", ".join(f"lon{k} double, lat{k} double" for k in range(1, 5)) + ", wet int"
    turn = [(20.0, 70.0), (22.0, 70.0), (22.0, 71.0), (20.0, 71.0)]
    data = [(1, *sum(turn, ()), 1), (2, *sum(turn[::-1], ()), 1)]
    area = {r["t"]: r["area"] for r in W.polar_overlaps(spark.createDataFrame(data, names), lats, lons, mask).groupBy("t").agg(F.sum("area").alias("area")).collect()}
    assert area[1] == area[2] == pytest.approx(W.METRES**2 * 2 * math.cos(math.radians(70.5)), rel=0.03)


def test_cumulative_poison_and_pre_post(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, None), (1, 2, 2.0)], "k int, lag int, impact double")
    assert [r["cum"] for r in A.cumulative(df, ["k"], "lag").orderBy("lag").collect()] == [1.0, 1.0, 3.0]
    assert [r["cum"] for r in A.cumulative(df, ["k"], "lag", poison=True).orderBy("lag").collect()] == [1.0, None, None]
    pp = spark.createDataFrame([(1, 0, 1.0, 10.0), (1, 1, 2.0, 20.0)], "k int, lag int, pre double, post double")
    assert [r["cum"] for r in A.before_and_after(pp, ["k"], "lag", "pre", "post").orderBy("lag").collect()] == [21.0, 3.0]


def test_bandpass_bands_add_up(spark):
    parts = [{"low": 0.0, "high": 0.1}, {"low": 0.1, "high": math.inf}]
    total = sum(special.band_weight(0.07, p["low"], p["high"], 3.0, half_power=False) for p in parts)
    assert total == pytest.approx(1.0)


def test_band_passed_keeps_a_slow_wave(spark):
    t = np.arange(240)
    x = np.sin(2 * math.pi * t / 60) + 0.5 * np.sin(2 * math.pi * t / 4) + 0.01 * t
    data = [(1, int(i), None if i == 50 else float(v)) for i, v in zip(t, x, strict=True)]
    out = X.band_passed(spark.createDataFrame(data, "k int, t int, x double"), ["k"], "t", 1.0, 1 / 120, 1 / 20).orderBy("t").collect()
    got = np.array([np.nan if r["band"] is None else r["band"] for r in out])
    assert np.isnan(got[50]) and np.nanmax(np.abs(got - np.sin(2 * math.pi * t / 60))[40:200]) < 0.15


def test_band_passed_edges(spark):
    """The trend alone passes a low-pass, a mask takes the ends off, gaps stay gaps, and a constant is no wave."""
    t = np.arange(96)
    x = np.sin(2 * math.pi * t / 24)
    sets = {1: 0.02 * t + 3, 2: x, 3: np.where((t > 40) & (t < 44), np.nan, x), 4: np.full(96, np.nan), 5: np.where(t < 10, np.nan, x)}
    df = spark.createDataFrame([(k, int(i), None if np.isnan(v) else float(v)) for k, s in sets.items() for i, v in zip(t, s, strict=True)], "k int, t int, x double")
    low = {k: np.array([np.nan if r["band"] is None else r["band"] for r in X.band_passed(df.where(f"k = {k}"), ["k"], "t", 1.0, 0.0, 1 / 12, 2.0, keep_trend=True).orderBy("t").collect()]) for k in (1, 4)}
    assert np.allclose(low[1], sets[1], atol=1e-9) and np.isnan(low[4]).all()
    band = X.band_passed(df, ["k"], "t", 1.0, 1 / 48, 1 / 12, mask_edges=True)
    got = {k: np.array([np.nan if r["band"] is None else r["band"] for r in band.where(f"k = {k}").orderBy("t").collect()]) for k in (2, 3, 5)}
    assert np.isnan(got[2][[0, 95]]).all() and np.nanmax(np.abs(got[2] - x)) < 0.2
    assert np.isnan(got[3][41:44]).all() and np.isfinite(got[3][50]) and np.isnan(got[5][:11]).all()


def test_harmonics_match_least_squares(spark):
    rng = np.random.default_rng(2)
    day = np.sort(rng.choice(4000, 70, replace=False))
    x = rng.normal(size=70) + np.cos(2 * math.pi * day / 365.24)
    df = spark.createDataFrame([(1, int(d), float(v)) for d, v in zip(day, x, strict=True)], "k int, day int, x double")
    got = [r["anom"] for r in X.harmonics(df, ["k"], "day", 4).orderBy("day").collect()]
    a = np.column_stack([np.ones(70)] + [f(2 * math.pi * k * day / 365.24) for k in range(1, 5) for f in (np.cos, np.sin)])
    assert np.allclose(got, x - a @ np.linalg.lstsq(a, x, rcond=None)[0])


def test_harmonics_of_few_or_like_days(spark):
    like = [("like", 365.24 * k + 3, float(k)) for k in range(8)]
    few = [("few", d, x) for d, x in ((0.0, 1.0), (90.0, 4.0), (200.0, 2.0), (300.0, 7.0))]
    out = X.harmonics(spark.createDataFrame(like + few, "k string, day double, x double"), ["k"], "day", 3)
    assert [r["anom"] for r in out.where("k = 'like'").orderBy("day").collect()] == pytest.approx([k - 3.5 for k in range(8)])
    a = np.array([[1, math.cos(2 * math.pi * d / 365.24), math.sin(2 * math.pi * d / 365.24)] for _, d, _ in few])
    x = np.array([v for *_, v in few])
    assert [r["anom"] for r in out.where("k = 'few'").orderBy("day").collect()] == pytest.approx(x - a @ np.linalg.lstsq(a, x, rcond=None)[0])


def test_gaps_and_interpolation(spark):
    df = spark.createDataFrame([(1, 0, None), (1, 1, 1.0), (1, 2, None), (1, 3, 3.0), (1, 4, None)], "k int, p int, x double")
    assert [r["filled"] for r in X.gaps_filled(df, ["k"], "p").orderBy("p").collect()] == [None, 1.0, 2.0, 3.0, None]


def _correlated(a, b, lags, delta=1.0, confidence=0.95):
    """The lagged correlation by numpy: detrended, the smaller integral scale, Fisher's bounds."""
    i = np.arange(len(a), dtype=float)

    def flat(x):
        ok = np.isfinite(x)
        return x - np.polyval(np.polyfit(i[ok], x[ok], 1), i)

    def corr(x, y):
        ok = np.isfinite(x) & np.isfinite(y)
        return (np.corrcoef(x[ok], y[ok])[0, 1], ok.sum()) if ok.sum() > 1 else (np.nan, ok.sum())

    def scale(x):
        total = 0.0
        for k in range(1, max(map(abs, lags)) + 1):
            r = corr(x[:-k], x[k:])[0]
            total += 0 if np.isnan(r) else r
            if not r >= 0:
                break
        return delta * (1 + max(0.0, 2 * total))

    a, b = flat(a), flat(b)
    least, out = min(scale(a), scale(b)), {}
    for lag in lags:
        r, n = corr(a[max(0, -lag) : len(a) - max(0, lag)], b[max(0, lag) : len(b) - max(0, -lag)])
        dof = delta * n / least
        wide = special.erfinv(confidence) * math.sqrt(2) / math.sqrt(dof - 3) if dof > 3 else math.inf
        out[lag] = (r, n, dof, np.sign(r) * math.tanh(math.atanh(abs(r)) - wide), np.sign(r) * math.tanh(math.atanh(abs(r)) + wide))
    return out, scale(a), scale(b)


def test_correlated_by_numpy(spark):
    """Gaps, trends, a series too short for bounds, negative lags."""
    rng = np.random.default_rng(5)
    walk = np.convolve(rng.normal(size=90), np.ones(5), "valid")
    sets = {1: (walk + 0.1 * np.arange(86), np.roll(walk, 2) + rng.normal(size=86)), 2: (rng.normal(size=86), -walk), 3: (rng.normal(size=5), rng.normal(size=5))}
    sets[1][0][[3, 4, 40]] = np.nan
    sets[2][1][10:20] = np.nan
    data = [(k, i, None if np.isnan(x) else float(x), None if np.isnan(y) else float(y)) for k, (a, b) in sets.items() for i, (x, y) in enumerate(zip(a, b, strict=True))]
    lags = [-2, -1, 0, 1, 2]
    out = X.correlated(spark.createDataFrame(data, "k int, p int, a double, b double"), ["k"], "p", "a", "b", lags, delta=0.5).collect()
    for k, (a, b) in sets.items():
        want, scale_a, scale_b = _correlated(a, b, lags, 0.5)
        got = {r["lag"]: r for r in out if r["k"] == k}
        assert set(got) == set(lags)
        for lag, row in got.items():
            assert (row["r"], row["n"], row["dof"], row["low"], row["high"]) == pytest.approx(want[lag])
            assert (row["scale_a"], row["scale_b"], row["dof_zero"]) == pytest.approx((scale_a, scale_b, want[0][2]))
            assert row["significant"] == (want[lag][3] * want[lag][0] > 0)


def test_gauge_and_global_mean(spark):
    lines = spark.createDataFrame([("1990.0417; 7005;0;000",), ("1990.1250; -99999;0;000",), ("bad",)], "value string")
    assert rows(series.gauge(lines).select("year", "month", "x"), "month") == [(1990, 1, 7.005), (1990, 2, None)]
    text = [(0, "x"), (1, "Header_End"), (2, "1 2 1993.5 4 5 12.0 7 8 9 10 11"), (3, "1 2 1993.6 4 5 99900 7 8 9 10 11")]
    out = rows(series.global_mean(spark.createDataFrame(text, "n int, value string"), "n"), "s")
    assert out[0] == (725846400 + int(0.5 * 365 * 86400), 0.012) and out[1][1] is None


def test_binary_grids(spark, tmp_path):
    side = 2
    values = [float(v) for v in range(13 * side * side)]
    values[3] = float("nan")
    for k, name in enumerate(("empmr.0000000084.data", "empmr.0000000252.data")):
        (tmp_path / name).write_bytes(struct.pack(f">{len(values)}f", *[v + 100 * k for v in values]))
    got = grids.weekly_forcing(spark, str(tmp_path), side)
    assert got.count() == 2 * len(values) and got.where("x is null").count() == 2
    # the slab of tiles 7 to 9 has rows of three tiles: place 28 + 6 is row 1 of tile 7
    assert got.where("s = 694224000 and tile = 7 and j = 1 and i = 0").first()["x"] == 34.0
    assert [r["s"] for r in got.select("s").distinct().orderBy("s").collect()] == [694224000, 694224000 + 604800]


def test_grid_files_are_read_in_part(spark, tmp_path):
    """Filters on file names, records and tiles reach the files; the bytes read are those asked for."""
    side = 2
    size = 13 * side * side
    for name in ("empmr.0000000084.data", "empmr.0000000252.data", "qnet.0000000252.data", "odd.data"):
        (tmp_path / name).write_bytes(struct.pack(f">{2 * size + 6}f", *[float(v) for v in range(2 * size + 6)]))
    df = grids.floats(spark, str(tmp_path), side=side)
    some = grids.floats(spark, str(tmp_path), side=side, stems=["empmr"], first=200, records=[1], tiles=[3, 8])
    want = {(t, j, i): 52.0 + (12 + 2 * j + i if t == 3 else 28 + 6 * j + 2 + i) for t in (3, 8) for j in (0, 1) for i in (0, 1)}
    assert {(r["tile"], r["j"], r["i"]): r["x"] for r in some.collect()} == want
    assert df.where("stem = 'empmr' and x > 50 and tile = 0").count() == 2 * 8 and df.count() == 4 * (2 * size + 6)
    both = {tuple(r) for r in df.select("path", "record", "tile", "j", "i", "x").collect()}
    assert {tuple(r) for r in some.select("path", "record", "tile", "j", "i", "x").collect()} <= both

    def read(**options):
        reader = grids.GridReader({"path": str(tmp_path), "side": str(side)} | options)
        return sum(n for p in reader.partitions() for *_, n in reader.ranges(p))

    assert read() == 4 * 4 * (2 * size + 6)
    assert read(tiles="3", records="0") == 4 * 4 * 4
    assert read(tiles="8", first="84", last="85") == 2 * 4 * 12
    assert read(stems="none") == 0 and read(stems="qnet,odd", records="2") == 2 * 4 * 6
    assert grids.weekly_forcing(spark, str(tmp_path), side, ["empmr"], first=694224000 + 604800).select("s").distinct().collect()[0][0] == 694224000 + 604800


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1, 1, 1, 2.0)], tables.SCHEMAS["impact"])
    tables.write(df, str(tmp_path / "impact"), ["forc"])
    assert tables.read(spark, str(tmp_path / "impact"), "impact").count() == 1


def test_streams_agree_with_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = means.weekly(stream, ["event_type"]).writeStream.outputMode("complete").format("memory").queryName("weekly_means").start()
    q.processAllAvailable()
    q.stop()
    got = {(r["event_type"], int(r["week"].timestamp())): r["mean"] for r in spark.sql("select event_type, week, mean from weekly_means").collect()}
    e = src.select("event_type", F.col("ts").cast("long").alias("s"), F.col("value").alias("x"))
    want = {(r["event_type"], r["week"]): r["mean"] for r in R.weekly_mean(e, ["event_type"]).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_same_result_for_any_partitioning(spark):
    from gridtide.plans.catalog import QUERIES

    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = set()
    for n, adaptive in (("1", "true"), ("7", "false"), ("50", "true")):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        seen.add(tuple(sorted(map(tuple, QUERIES["nearest_join"](spark, "/root/testdata/sf0.001").collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(seen) == 1


def test_ranges_give_what_one_range_gives(spark):
    rng = np.random.default_rng(2)
    left = spark.createDataFrame([(i, int(k), float(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 900, 200), strict=True))], "id int, k int, a double")
    right = spark.createDataFrame([(i, int(k), float(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 900, 60), strict=True))], "r int, k int, b double")
    every = right.collect()
    want = [(r["id"], min((abs(x["b"] - r["a"]), x["b"], x["r"]) for x in every if x["k"] == r["k"])[2]) for r in left.orderBy("id").collect()]
    for width in (None, 7.0, 150.0, 1e6):
        assert rows(J.nearest(left, right, ["k"], "a", "b", ["id"], "r", width=width).select("id", "r"), "id") == want
    gaps = left.groupBy("k", "a").agg(F.min(F.when(F.col("id") % 3 == 0, F.col("id") * 1.0)).alias("x"))
    one = rows(X.gaps_filled(gaps, ["k"], "a").select("k", "a", "filled"), "k", "a")
    assert rows(X.gaps_filled(gaps, ["k"], "a", width=11.0).select("k", "a", "filled"), "k", "a") == one
    odd = gaps.unionByName(spark.createDataFrame([(0, None, 5.0), (0, None, None)], "k int, a double, x double"))
    for width in (None, 11.0):  # values at no time have no part in it
        assert rows(X.gaps_filled(odd, ["k"], "a", width=width).where("a is not null").select("k", "a", "filled"), "k", "a") == one
    ends = X.gaps_filled(gaps, ["k"], "a", clamped=True)
    assert ends.where("filled is null").count() == 0 and any(r[2] is None for r in one)


def test_many_bins_on_a_circle(spark):
    rng = np.random.default_rng(3)
    left = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.uniform(-50, 900, 80))], "id int, a double")
    bins = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.uniform(0, 365, 30))], "bin int, at double")
    few, many = (J.circular_nearest(left, bins, "a", "at", "bin", ["id"], 365.0, most) for most in (1000, 3))
    assert rows(few.select("id", "bin", F.round("distance", 6)), "id") == rows(many.select("id", "bin", F.round("distance", 6)), "id")


@pytest.mark.parametrize("crowd", [256, 3, 1])
def test_nearest_cell_however_far(spark, crowd):
    """Points far from all cells, poles, the date line, a crowd in one spot and cells of one place, at any depth."""
    rng = np.random.default_rng(4)
    p = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 120), np.append(rng.uniform(-90, 90, 114), [89.9, -89.9, 90, -90, 0, 60]), strict=True))]
    c = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 25), rng.uniform(-88, -20, 25), strict=True))] + [(99, 10.0, 89.5)]
    c += [(100 + i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(100, 100.4, 60), rng.uniform(-40, -39.6, 60), strict=True))] + [(50, 180.0, -21.0), (51, -180.0, -21.0), (52, 180.0, -21.0)]
    got = dict(rows(G.nearest_cell(spark.createDataFrame(p, "p int, lon double, lat double"), spark.createDataFrame(c, "c int, lon double, lat double"), "p", "c", crowd).select("p", "c"), "p"))
    assert len(got) == len(p)

    def distance(a, b):
        d = (b[1] - a[1] + 180) % 360 - 180
        return math.hypot(math.cos(math.radians(a[2])) * d, b[2] - a[2])

    for a in p:
        best = min(c, key=lambda b: (distance(a, b), b[0]))
        assert got[a[0]] == best[0] or distance(a, best) == pytest.approx(distance(a, next(b for b in c if b[0] == got[a[0]])))


def test_conservation_with_a_far_source(spark):
    box = "lon_lo double, lon_hi double, lat_lo double, lat_hi double, wet int"
    t = spark.createDataFrame([(1, 0.0, 4.0, 0.0, 4.0, 1), (2, 4.0, 8.0, 0.0, 4.0, 0)], f"t int, {box}")
    s = spark.createDataFrame([(1, 1.0, 3.0, 1.0, 3.0, 1), (2, 3.0, 5.0, 1.0, 3.0, 1), (3, 150.0, 152.0, -80.0, -78.0, 1)], f"s int, {box}")
    area = W.METRES**2 * F.cos(F.radians((F.col("lat_lo") + F.col("lat_hi")) / 2)) * (F.col("lon_hi") - F.col("lon_lo")) * (F.col("lat_hi") - F.col("lat_lo"))
    middle = [((F.col("lon_lo") + F.col("lon_hi")) / 2).alias("lon"), ((F.col("lat_lo") + F.col("lat_hi")) / 2).alias("lat")]
    s_area, t_area = s.select("s", area.alias("s_area")), t.select("t", area.alias("t_area"))
    near = G.nearest_cell(s.select("s", *middle), t.where("wet = 1").select("t", *middle), "s", "t").select("s", "t")
    got = W.conserving(W.overlaps(t, s), s_area, t_area, near).join(t_area, "t").groupBy("s").agg(F.sum(F.col("weight") * F.col("t_area")).alias("total"))
    for r in got.join(s_area, "s").collect():
        assert r["total"] == pytest.approx(r["s_area"])
    assert got.count() == 3


def test_alignment_is_that_of_loops(spark):
    years, week = [1999, 2000, 2001], 604800
    jan = lambda y: (dt.date(y, 1, 1) - dt.date(1970, 1, 1)).days * 86400
    start = 694224000 + week // 2 + round((jan(years[0] - 1) - 694224000) / week) * week
    lattice = list(range(start, jan(years[-1] + 1), week))
    nearest = lambda s: min(lattice, key=lambda x: (abs(x - s), x))
    centre = lambda k, y: jan(y) + k * week + week // 2
    steps = [(m, k, jan(2008) + m * 2629728 - (n - 1 - k) * week, n) for m, n in ((1, 54), (7, 55)) for k in range(n)]
    want = set()
    for m, k, s, n in steps:
        year = 365.24 * 86400
        b = min(range(52), key=lambda j: (round(min((s - centre(j, 2004)) % year, year - (s - centre(j, 2004)) % year), 3), j))
        for y in years:
            if b >= k:
                gap = nearest(centre(0, y)) - nearest(centre(51, y - 1)) > 10.5 * 86400
                at = nearest(centre(b, y - 1)) + (week if gap else 0)
            else:
                at = nearest(centre(b, y + 1 if b < k - (n - 5) else y))
            want.add((m, k, y, b, at))
    got = L.aligned(spark.createDataFrame(steps, "month int, step int, s long, n int"), years)
    assert {tuple(r) for r in got.collect()} == want


def test_fluxes(spark, tmp_path):
    day = 86400
    jan = 10957 * day  # 2000-01-01
    spark.createDataFrame([(jan - 15 * day, 1, 0, 0, 0.5, 0.25), (jan - 14 * day, 1, 0, 0, 0.5, 0.25), (jan, 1, 0, 0, None, 0.25)], fluxes.WATER).write.parquet(str(tmp_path / "w"))
    spark.createDataFrame([(jan, 3, 4, 2.0), (jan + 375 * day, 3, 4, 1.0)], fluxes.RIVER).write.parquet(str(tmp_path / "r"))
    assert rows(fluxes.evaporation_less_rain(spark, str(tmp_path / "w"), [2000], 2).select("s", "x"), "s") == [(jan - 14 * day, 250.0), (jan, None)]
    assert rows(fluxes.river_discharge(spark, str(tmp_path / "r"), [2000], 2).select("s", "x"), "s") == [(jan, -2.0)]
    assert fluxes.after_start("x_seas5_ensmean") == (8, "weekly")
    with pytest.raises(ValueError, match="no forecast"):
        fluxes.after_start("era5")
    readers = {k: (lambda forc, k=k: (k, forc)) for k in ("ecco", "ecco_emp", "era5", "jra55do")}
    assert fluxes.before_start("ecco_v4", "emp", readers) == ("ecco_emp", "emp") and fluxes.before_start("era5", "tauu", readers) == ("era5", "tauu")


def test_special_cells_before_nested_ones(spark):
    grid = spark.createDataFrame([(0, j, i) for j in range(4) for i in range(4)], "tile int, j int, i int")
    special = spark.createDataFrame([(0, 0, 0, 0, 0, 2), (0, 0, 0, 1, 1, 2), (1, 0, 3, 3, 0, 1)], "cell long, tile int, j int, i int, ord int, size long")
    schemes = spark.createDataFrame([(1, 2, 0, 0, 4, 0, 4)], "priority int, n_merge int, tile int, j_lo int, j_hi int, i_lo int, i_hi int")
    out = rows(G.combined(special, grid, schemes), "cell", "ord")
    assert len({r[1:4] for r in out}) == len(out) == 16 and sorted({r[0] for r in out}) == list(range(6))
    assert [r[0] for r in out if r[1:4] == (0, 1, 1)] == [2] and out[0][5] == 2


def test_coast_strip_is_a_region(spark):
    faces = spark.createDataFrame([(-80.0, 29.0), (-79.5, 31.0), (-76.0, 36.0), (-74.0, 40.0), (-77.0, 26.5), (-70.0, 28.0)], "lon double, lat double")
    line = G.coast_line(faces)
    assert rows(line.select("lon", "lat"), "ord") == [(-80.0, 29.0), (-79.5, 31.0), (-76.0, 36.0), (-74.0, 40.0)]
    cells = spark.createDataFrame([(1, -79.0, 30.0), (2, -60.0, 30.0), (3, -81.0, 25.0), (4, -75.0, 37.0)], "cell int, lon double, lat double")
    assert rows(G.regions_with_coast(cells, line), "cell") == [(1, 6), (2, 7), (3, 5), (4, 6)]


def test_rivers_go_where_they_may(spark):
    t = spark.createDataFrame([(1, -110.0, 30.0), (2, -120.0, 30.0), (3, 80.0, 70.0), (4, 60.0, 70.0)], "t int, lon double, lat double")
    s = spark.createDataFrame([(1, 484, 986, -116.0, 30.0), (2, 540, 150, 30.0, 44.0), (3, 598, 80, 20.0, 60.0), (4, 632, 296, 64.0, 70.0), (5, 100, 100, -119.0, 29.0)], "s int, lat_ind int, lon_ind int, lon double, lat double")
    assert rows(W.river_targets(s, t), "s") == [(1, 1), (4, 3), (5, 2)]


def test_level_from_surface(spark):
    surface = spark.createDataFrame([(1, 2.0), (2, 3.0)], "m int, eta double")
    other = spark.createDataFrame([(1, 1.5, 1.0)], "m int, ssh double, eta double")
    world = spark.createDataFrame([(1, 0.25, 0.5, 0.125)], "m int, eta double, other_ssh double, other_eta double")
    assert rows(references.level_from_surface(surface, other, world), "m") == [(1, 2.5 - 0.625)]


def test_sensitivities_of_many_years(spark, tmp_path):
    values = np.arange(2 * 13 * 4, dtype=">f4") + 1
    (tmp_path / "adxx_tauu.0000000059_dim.data").write_bytes(values.tobytes())
    (tmp_path / "adxx_tauu.0000000012.data").write_bytes(values.tobytes())
    out = grids.sensitivities_of_many_years(spark, str(tmp_path), side=2)
    assert out.count() == 104 and out.agg(F.max("s")).first()[0] == 16806 * 86400 - 302400


def test_cycle_at_other_times(spark):
    """The fit's coefficients give the fit at its own days and go on beyond them; few days have fewer harmonics."""
    rng = np.random.default_rng(8)
    day = np.sort(rng.choice(3000, 60, replace=False)).astype(float)
    x = rng.normal(size=60) + 2 * np.cos(2 * math.pi * day / 365.24) + 5
    few = [(2, d, v) for d, v in ((0.0, 1.0), (90.0, 4.0), (200.0, 2.0), (300.0, 7.0))]
    df = spark.createDataFrame([(1, float(d), float(v)) for d, v in zip(day, x, strict=True)] + few, "k int, day double, x double")
    found = X.seasonal_coefficients(df, ["k"], "day", 3)
    ask = np.arange(-100.0, 4000.0, 37.0)
    got = [r["cycle"] for r in X.seasonal_at(found, spark.createDataFrame([(1, float(d)) for d in ask], "k int, day double"), ["k"], "day").orderBy("day").collect()]
    design = lambda t: np.column_stack([np.ones(len(t))] + [f(2 * math.pi * k * t / 365.24) for k in (1, 2, 3) for f in (np.cos, np.sin)])
    assert np.allclose(got, design(ask) @ np.linalg.lstsq(design(day), x, rcond=None)[0])
    both = X.seasonal_at(found, X.harmonics(df, ["k"], "day", 3), ["k"], "day", "again").collect()
    assert all(r["again"] == pytest.approx(r["x"] - r["anom"]) for r in both) and found.where("k = 2").first()["coefs"][2:] == [0.0] * 4


def test_record_carried_back(spark):
    """The early record's level and trend, the late record's level and cycle."""
    wave = lambda d: math.cos(2 * math.pi * d / 365.24)
    late = [(1, float(d), 3 + wave(d)) for d in range(7305, 11000, 30)]
    early = [(1, float(d), 0.001 * d) for d in range(3650, 11000, 365)]
    ask = [(1, float(d)) for d in range(3652, 7305, 30)]
    out = references.extended_back(*(spark.createDataFrame(x, "k int, day double, x double") for x in (early, late)), spark.createDataFrame(ask, "k int, day double"), ["k"], "day", 7305.0, 10957.0)
    got = {r["day"]: r["x"] for r in out.collect()}
    shift = np.mean([v for _, d, v in late if d < 10957]) - np.mean([v for _, d, v in early if 7305 <= d < 10957])
    line = np.polyfit([d for _, d in ask], [wave(d) for _, d in ask], 1)
    assert len(got) == len(ask) and all(got[d] == pytest.approx(0.001 * d + shift + wave(d) - np.polyval(line, d), abs=1e-6) for _, d in ask)


def test_filter_bank_is_each_band_alone(spark):
    rng = np.random.default_rng(9)
    data = [(k, t, None if k == 2 and t in (5, 6) else float(v)) for k in (1, 2, 3) for t, v in enumerate(rng.normal(size=40 + 7 * k).cumsum())]
    df = spark.createDataFrame(data, "k int, t int, x double")
    bands = {"fast": {"low": 1 / 10, "high": 1 / 3}, "slow": {"low": 0.0, "high": 1 / 12, "steep": 2.0, "keep_trend": True}, "edge": {"low": 1 / 24, "high": 1 / 6, "mask_edges": True}}
    out = {(r["k"], r["t"]): r for r in X.filter_bank(X.series_arrays(df, ["k"], "t"), ["k"], "t", 1.0, bands).collect()}
    for name, band in bands.items():
        for r in X.band_passed(df, ["k"], "t", 1.0, **band).collect():
            assert out[r["k"], r["t"]][name] == (None if r["band"] is None else pytest.approx(r["band"], abs=1e-12))
    assert out[2, 5]["slow"] is None and len(out) == len(data)


def test_dense_series(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 3, 4.0), ("b", 4, 1.0), ("c", 2, None)], "k string, m long, x double")
    assert rows(X.dense(df, ["k"], "m", fill=0.0), "k") == [("a", [1, 2, 3, 4], [2.0, 0.0, 4.0, 0.0]), ("b", [1, 2, 3, 4], [0.0, 0.0, 0.0, 1.0])]
    assert rows(X.dense(df.where("k = 'a'"), ["k"], "m"), "k") == [("a", [1, 2, 3], [2.0, None, 4.0])]


def test_sums_after_a_start(spark):
    """Starts a day apart are one forecast, also in a chain; steps without a start have no sum."""
    data = [(1, 0, 10.0, 1.0), (1, 1, 11.0, 2.0), (1, 2, 12.5, None), (1, 3, 14.5, 8.0), (1, 4, 10.0, 16.0), (1, 5, None, 32.0), (2, 0, 10.0, 5.0)]
    out = A.accumulated_after(spark.createDataFrame(data, "k int, step int, start double, x double"), ["k"], "step", "start", "x")
    assert [r["after"] for r in out.orderBy("k", "step").collect()] == [19.0, 18.0, 16.0, 8.0, 16.0, None, 5.0]


def test_last_step_filled(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (1, 2, None), (2, 0, None), (2, 1, 4.0), (3, 0, None)], "k int, step int, cum double")
    assert [r["cum"] for r in A.last_filled(df, ["k"], "step").orderBy("k", "step").collect()] == [1.0, 3.0, 3.0, None, 4.0, None]


def test_steps_in_front(spark):
    long = spark.createDataFrame([(1, k, 10.0 + k) for k in range(6)], "k int, step int, w double")
    short = spark.createDataFrame([(1, k, float(k)) for k in range(4)], "k int, step int, w double")
    times = lambda first, n: spark.createDataFrame([(1, k, y, first + 7.0 * k + y) for y in (0, 1) for k in range(n)], "k int, step int, year int, at double")
    out = A.prepended(long, short, times(0.0, 6), times(14.5, 4), ["k"], "step", "at", 2)
    assert [tuple(r) for r in out.orderBy("step").collect()] == [(1, 0, 10.0), (1, 1, 11.0), (1, 2, 0.75 * 12), (1, 3, 0.25 * 13 + 0.75), (1, 4, 2.0), (1, 5, 3.0)]


def test_separable_weights_and_mask(spark):
    lats, lons, _ = _grid_axes(spark, 10.0)
    lats, lons = W.axis_bounds(lats, "lat_ind", "lat"), W.axis_bounds(lons, "lon_ind", "lon", circle=360.0)
    field = spark.createDataFrame([(i, j, t, 1.0) for i in range(18) for j in range(36) for t in range(20) if not (i == 9 and t < 2) and not (j == 0 and t < 1)], "lat_ind int, lon_ind int, t int, x double")
    valid = W.valid_cells(field, ["lat_ind", "lon_ind"], "t")
    assert valid.where("lat_ind = 9").count() == 0 and valid.where("lon_ind = 0").count() == 17
    box = spark.createDataFrame([(1, -7.0, 3.0, 8.0, 12.0), (2, 355.0, 356.0, 1.0, 2.0)], "t int, lon_lo double, lon_hi double, lat_lo double, lat_hi double")
    got = {(r["t"], r["lat_ind"], r["lon_ind"]): r["weight"] for r in W.separable_weights(box, lats, lons, valid).collect()}
    assert got == {(1, 10, 35): pytest.approx(0.2), (1, 10, 0): pytest.approx(0.8)}
    quad = spark.createDataFrame([("a", -7.0, 8.0, 3.0, 8.5, 3.0, 12.0, -6.0, 12.0)], "k string, " + ", ".join(f"lon{k} double, lat{k} double" for k in range(1, 5)))
    area = {(r["lat_ind"], r["lon_ind"]): r["area"] for r in W.mask_area(quad, lats, lons, valid, ["k"]).collect()}
    unit = W.METRES**2 * math.cos(math.radians(15.0))
    assert area == {(9, 35): 0.0, (9, 0): 0.0, (10, 35): pytest.approx(unit * 2 * 2), (10, 0): pytest.approx(unit * 2 * 8)}


def test_files_merged(spark, tmp_path):
    """By the names of real files: the first one's row, an error where they differ, or each column's first value."""
    from gridtide.sources import forecasts

    names = "k int, x double, y double"
    spark.createDataFrame([(1, 1.0, None), (2, 2.0, 2.0)], names).coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(2, 9.0, 2.0), (3, None, 3.0), (1, 1.0, 7.0)], names).coalesce(1).write.parquet(str(tmp_path / "b"))
    df = forecasts.with_path(spark, str(tmp_path), names)
    assert rows(tables.merged(df, ["k"]), "k") == [(1, 1.0, None), (2, 2.0, 2.0), (3, None, 3.0)]
    assert rows(tables.merged(df, ["k"], how="filled"), "k") == [(1, 1.0, 7.0), (2, 2.0, 2.0), (3, None, 3.0)]
    assert rows(tables.merged(df.where("k = 3"), ["k"], how="equal"), "k") == [(3, None, 3.0)]
    with pytest.raises(Exception, match="differ"):
        tables.merged(df, ["k"], how="equal").collect()
    with pytest.raises(ValueError, match="no such"):
        tables.merged(df, ["k"], how="any")


def test_mapping_is_applied(spark, tmp_path):
    data = [(0, 1, 2, 5, 6, 0, 0.25), (0, 1, 2, 5, 7, 1, 0.75)]
    tables.write(spark.createDataFrame(data, tables.SCHEMAS["regrid_weight"]), str(tmp_path / "w"))
    field = spark.createDataFrame([(5, 6, 1, 4.0), (5, 7, 1, 8.0), (9, 9, 1, 1.0)], "lat_ind int, lon_ind int, m int, x double")
    out = W.applied(tables.mapping(spark, str(tmp_path / "w")), field, ["m"], source=("lat_ind", "lon_ind")).collect()
    assert [(tuple(r["t"]), r["m"], r["x"]) for r in out] == [((0, 1, 2), 1, 7.0)]
