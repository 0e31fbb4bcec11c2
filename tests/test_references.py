from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridtide.operators import filters, references
from gridtide.sources import forecasts


def test_references(spark):
    level = spark.createDataFrame([(24000 + i, float(i)) for i in range(24)], "m long, x double")
    assert references.reference("gauge", level=level, global_mean=level).agg(F.max(F.abs("x"))).first()[0] == 0
    out = references.by_month(references.reference("gauge", level=level))
    assert out.where("month = 1").agg(F.sum("y")).first()[0] == pytest.approx(0)
    assert references.by_month(references.reference("gauge", level=level), detrend=True).agg(F.max(F.abs("y"))).first()[0] < 1e-9
    field = spark.createDataFrame([(c, m, None if c == 2 and m > 1 else float(c)) for c in (1, 2, 3) for m in (1, 2, 3)], "cell int, m long, x double")
    weight = spark.createDataFrame([(1, 1.0), (2, 5.0), (3, 3.0)], "cell int, w double")
    assert {r["x"] for r in references.reference("altimetry", field=field, weight=weight).collect()} == {2.5}
    cells = spark.createDataFrame([(1, 0.0, 0.0), (3, 5.0, 5.0)], "cell int, lon double, lat double")
    assert {r["x"] for r in references.reference("at_point", field=field, cells=cells, lon=4.0, lat=4.0).collect()} == {3.0}
    fc = spark.createDataFrame([(i, i + k, float(k)) for i in (0, 3, 6) for k in (0, 1, 2, 3)], "init long, pred long, x double")
    assert {(r["m"], r["lead_num"]) for r in references.reference("model", forecast=fc).collect()} >= {(3, 0), (3, 1)}
    with pytest.raises(ValueError, match="no such"):
        references.reference("none")


def test_forecast_names_and_stamps(spark):
    r = spark.range(1).select(forecasts.init_month(F.lit("/x/run.SSH.198011-199012.nc")), forecasts.step_middle(F.lit("a.0000000744.data")), forecasts.no_leap_middle(F.lit(721605.0 + 31))).first()
    assert r[0] == 1980 * 12 + 11 and r[1] == 694224000 + 31 * 43200 and r[2] == 1977 * 12 + 1


def test_weekly_fluxes(spark):
    df = spark.createDataFrame([(1, 0, 100, -1.0, 0.5, None), (2, 604800, 900, -1.0, 0.0, 0.0)], "init int, lead long, s long, e double, tp double, ro double")
    out = forecasts.weekly_fluxes(df, "lead", 0, 500, ["init"]).collect()
    assert len(out) == 1 and out[0]["empmr"] == pytest.approx(500 / 302400)


def test_fourier_interpolation(spark):
    t = np.arange(16)
    x = np.cos(2 * np.pi * t / 8) + 0.0 * t
    df = spark.createDataFrame([(1, float(a), float(b)) for a, b in zip(t, x, strict=True)], "k int, t double, x double")
    got = [r["x"] for r in filters.interpolated_fourier(df, ["k"], "t", 1.0, [3.0, 4.0, 5.0]).orderBy("t").collect()]
    assert np.allclose(got, x[3:6], atol=1e-9)
