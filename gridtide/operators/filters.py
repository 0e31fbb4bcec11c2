"""Filters and statistics of single series: band-pass, harmonics, interpolation, lagged correlation."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from gridtide.functions.shipping import ship
from gridtide.functions.special import erfinv
from gridtide.operators.timejoin import neighbours


def lag_list(n: int) -> list[int]:
    """1, 2, 3 and then lags whose logarithms are 0.3 apart, up to a series of n values."""
    return [1, 2, 3, *(round(math.exp(1.5 + 0.3 * k)) for k in range(max(0, math.ceil((math.log(n) - 1.5) / 0.3))))]


def lag_weights(lags: list[int]) -> list[list[float]]:
    """For each place in the list, the weights of the correlations up to it: half the way between their neighbours."""
    ends = lambda n: [*lags[1 : n + 1], lags[n]]
    return [[0.5 * (b - a) for a, b in zip([0, *lags[:n]], ends(n), strict=True)] for n in range(len(lags))]


def averaged_points(n: int, delta: float, low: float, high: float) -> int:
    """How many values at either end a padding is taken from: an eighth of the band's middle period."""
    return round(0.125 / math.sqrt(max(low, 1 / (n * delta)) * min(high, 1 / (2 * delta))) / delta)


def dense(df: DataFrame, keys: list[str], at: str, value: str = "x", fill: float | None = None, span: DataFrame | None = None) -> DataFrame:
    """(keys, at: array, value: array): a series a row, with every whole place from the first to the last of all series, or
    of span (first, last: one row); places without a value get ``fill``."""
    ends = df.agg(F.min(at).cast("long").alias("first"), F.max(at).cast("long").alias("last")) if span is None else span
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col(at).cast("long"), F.col(value).cast("double")))).alias("_of"))
    rows = rows.crossJoin(F.broadcast(ends)).withColumn(at, F.sequence("first", "last"))
    filled = F.transform(at, lambda k: F.coalesce(F.try_element_at("_of", k), F.lit(fill).cast("double")))
    return rows.select(*keys, at, filled.alias(value))


def series_arrays(df: DataFrame, keys: list[str], at: str, value: str = "x") -> DataFrame:
    """(keys, at: array, value: array): the rows of each series in order of ``at``."""
    rows = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(at, F.col(value).cast("double").alias(value)))).alias("_s"))
    return rows.select(*keys, F.col(f"_s.{at}").alias(at), F.col(f"_s.{value}").alias(value))


def filter_bank(series: DataFrame, keys: list[str], at: str, delta: float, bands: dict[str, dict], value: str = "x", least: float = 1e-15) -> DataFrame:
    """(keys, at, a column for each band): whole series (keys, at: array, value: array) through several band-passes at once.

    bands: by name, low and high and, if they differ from these, steep=5.0, half_power=True, keep_trend=False,
    mask_edges=False. A series has a value for each of its places, ``delta`` apart; values that are NULL or, beside the
    largest, below ``least`` are missing (0: a zero is a value). The trend is taken off, gaps are interpolated, and the series is put into twice its
    length. Either end goes on with the level and the slope of the values there, by an error function to zero; a series
    that does not reach both ends of its places is followed by zeros. The whole is weighted by frequency. Then the trend
    comes back if ``keep_trend``, missing values are missing again, and with ``mask_edges`` so are the values next to
    either end that the padding may have changed, the more the longer the series' own time scale is beside the band.

    Series stay where they are: nothing is shuffled, a task works through its rows batch by batch, and bands whose ends
    are padded alike share one transform.
    """
    import numpy as np
    import pyarrow as pa

    from gridtide.functions.special import band_weight

    default = {"steep": 5.0, "half_power": True, "keep_trend": False, "mask_edges": False}
    bands = {k: default | v for k, v in bands.items()}
    responses: dict[tuple, np.ndarray] = {}  # by the number of places and the band
    ramp = np.vectorize(math.erf, otypes=[float])

    def time_scale(y: np.ndarray) -> float:
        lags = lag_list(len(y))
        r: list[float] = []
        for k, (lag, weights) in enumerate(zip(lags, lag_weights(lags), strict=True)):
            a, b = y[: max(len(y) - lag, 0)], y[lag:]
            both = np.isfinite(a) & np.isfinite(b)
            a, b = a[both] - a[both].mean() if both.any() else a[both], b[both] - b[both].mean() if both.any() else b[both]
            norm = math.sqrt(float(a @ a)) * math.sqrt(float(b @ b))
            r.append(float(a @ b) / norm if norm > 0 else math.nan)
            if r[-1] < 0 or k == len(lags) - 1:
                return delta if k == 0 else delta * (1 + 2 * float(np.dot(weights, r)))
        return math.nan

    def edge(scale: float, low: float, high: float) -> float:
        # The margin by the series' time scale and the band.
        q, width = 1 / (2 * scale), delta * high * (1 - math.sqrt(low / high)) ** 1.25
        middle = delta * math.sqrt(q * low)
        return float(np.rint(np.fmax(np.fmin((0.9 * low / q - 3 / 40) / middle + (0.45 - 1.8 * low / q) / width, 0.15 / middle), 0.3 / width)))

    def padded(alone: np.ndarray, good: np.ndarray, near: int) -> np.ndarray:
        n, i = len(alone), np.arange(len(alone))
        first, last = np.flatnonzero(good)[[0, -1]]
        buffer, start = np.zeros(2 * n), n // 2
        buffer[start + first : start + last + 1] = np.interp(i[first : last + 1], i[good], alone[good])
        place = np.arange(2 * n) - start
        if first == 0 and last == n - 1:
            for level, way, gone in ((first, 1, place < first), (last, -1, place > last)):
                away = way * (place - level)
                if near:
                    one, two = buffer[(away >= 0) & (away < near)].mean(), buffer[(away >= near) & (away < 2 * near)].mean()
                    slope = (two - one) / near
                    value = one - (near - 1) / 2 * slope
                else:
                    value = buffer[start + level]
                    slope = value / 0.5
                if value:
                    buffer[gone] = value * (1 + ramp(math.sqrt(math.pi) / 2 * abs(slope / value) * away[gone]))
        return buffer

    def passed(x: np.ndarray) -> list[np.ndarray]:
        n, i = len(x), np.arange(len(x))
        size = np.abs(np.where(np.isfinite(x), x, 0))
        good = np.isfinite(x) & (size >= least * size.max(initial=0)) & (size.max(initial=0) > 0)
        if not good.any():
            return [np.full(n, np.nan)] * len(bands)
        off = i - i[good].mean()
        spread = float(off[good] @ off[good])
        line = x[good].mean() + (float(off[good] @ (x[good] - x[good].mean())) / spread * off if spread else 0 * off)
        alone = np.where(good, x - line, np.nan)
        first, last = np.flatnonzero(good)[[0, -1]]
        waves: dict[int, tuple[np.ndarray, float]] = {}
        out, scale = [], None
        for name, b in bands.items():
            near = averaged_points(n, delta, b["low"], b["high"])
            if near not in waves:
                buffer = padded(alone, good, near)
                waves[near] = np.fft.rfft(buffer), buffer.mean()
            if (n, name) not in responses:
                responses[n, name] = np.array([band_weight(f, b["low"], b["high"], b["steep"], b["half_power"]) for f in np.fft.rfftfreq(2 * n, delta)])
            done = np.fft.irfft(waves[near][0] * responses[n, name], 2 * n)[n // 2 : n // 2 + n]
            if b["keep_trend"]:
                done = done + line + waves[near][1]
            keep = good
            if b["mask_edges"]:
                scale = time_scale(alone) if scale is None else scale
                margin = edge(scale, b["low"], b["high"])
                keep = good & ~(i < first + margin) & ~(i > last - margin)
            out.append(np.where(keep, done, np.nan))
        return out

    def task(batches):
        for batch in (x.slice(i, 1000) for x in batches for i in range(0, x.num_rows, 1000)):
            lists = batch.column(len(keys) + 1)
            found: list[list[np.ndarray]] = [[] for _ in bands]
            for x in lists:
                own = np.array([], float) if x.values is None else x.values.to_numpy(zero_copy_only=False).astype(float)
                for held, got in zip(found, passed(own) if len(own) else [own] * len(bands), strict=True):
                    held.append(got)
            ends = pa.array(np.cumsum([0, *(len(x) for x in found[0])]).astype(np.int32))
            columns = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else [], pa.float64(), from_pandas=True)) for x in found]
            yield pa.record_batch([*(batch.column(k) for k in range(len(keys) + 1)), *columns], names=[*keys, at, *bands])

    ship(series.sparkSession)
    rows = series.select(*keys, at, F.col(value).cast("array<double>").alias(value))
    schema = rows.select(*keys, at).schema
    for name in bands:
        schema = schema.add(name, ArrayType(DoubleType()))
    each = rows.mapInArrow(task, schema).select(*keys, F.explode(F.arrays_zip(at, *bands)).alias("_s"))
    return each.select(*keys, *(F.col(f"_s.{c}").alias(c) for c in (at, *bands)))


def band_passed(df: DataFrame, keys: list[str], at: str, delta: float, low: float, high: float, steep: float = 5.0, half_power: bool = True, keep_trend: bool = False, mask_edges: bool = False, value: str = "x") -> DataFrame:
    """(keys, at, band): one band of :func:`filter_bank` of series given as rows."""
    band = {"low": low, "high": high, "steep": steep, "half_power": half_power, "keep_trend": keep_trend, "mask_edges": mask_edges}
    return filter_bank(series_arrays(df, keys, at, value), keys, at, delta, {"band": band}, value)


def _orthogonal(df: DataFrame, keys: list[str], days: str, n_harmonics: int, value: str, period: float) -> tuple[DataFrame, list[str]]:
    """Rows with a value, the regressors made orthogonal one after another by sums over each series (modified
    Gram-Schmidt), their means (_m), what each column loses to those before it (_b), and the rest of the value (_r)."""
    w = Window.partitionBy(*keys)
    angle = lambda k: F.lit(2 * math.pi * k / period) * F.col(days)
    rows = df.where(F.col(value).isNotNull())
    names, columns = [], {}
    for k in range(1, n_harmonics + 1):
        for name, f in (("c", F.cos), ("s", F.sin)):
            names.append(f"_{name}{k}")
            columns[names[-1]] = f(angle(k))
    rows = rows.withColumns(columns).withColumn("_r", F.col(value))
    room = F.least(F.ceil(F.count("*").over(w) / 2) - 1, F.lit(n_harmonics))
    rows = rows.withColumns({"_room": room, **{f"{c}_d": F.stddev_pop(c).over(w) for c in names}})
    told = [F.when(F.lit(int(c[2:])) <= F.col("_room"), F.col(f"{c}_d")) for c in names]
    rows = rows.withColumn("_told", F.coalesce(F.least(*told), F.lit(0.0)) >= 2**-1.5)
    rows = rows.withColumns({c: F.when(F.col("_told") & (F.lit(int(c[2:])) <= F.col("_room")), F.col(c)).otherwise(0.0) for c in names}).drop("_room", "_told", *(f"{c}_d" for c in names))
    todo = [*names, "_r"]
    rows = rows.withColumns({f"{c}_m": F.avg(c).over(w) for c in todo})
    rows = rows.withColumns({c: F.col(c) - F.col(f"{c}_m") for c in todo})
    for j, q in enumerate(names):
        norm = F.sum(F.col(q) * F.col(q)).over(w)
        shares = {f"{c}_b{q}": F.coalesce(F.sum(F.col(c) * F.col(q)).over(w) / F.when(norm > 1e-9, norm), F.lit(0.0)) for c in todo[j + 1 :]}
        rows = rows.withColumns(shares)
        rows = rows.withColumns({c: F.col(c) - F.col(f"{c}_b{q}") * F.col(q) for c in todo[j + 1 :]})
    return rows, names


def harmonics(df: DataFrame, keys: list[str], days: str, n_harmonics: int, value: str = "x", period: float = 365.24) -> DataFrame:
    """value without its seasonal cycle (``anom``), and the cycle: least squares on cosines and sines of the period.

    A series of n values has at most half of n, rounded up, less one harmonics; one whose days are too much alike to tell
    them (a regressor's standard deviation is below 2^-3/2) loses its mean only.
    """
    rows, _ = _orthogonal(df, keys, days, n_harmonics, value, period)
    out = rows.select(*df.columns, F.col("_r").alias("anom"))
    return out.withColumn("cycle", F.col(value) - F.avg(value).over(Window.partitionBy(*keys)) - F.col("anom"))


def seasonal_coefficients(df: DataFrame, keys: list[str], days: str, n_harmonics: int, value: str = "x", period: float = 365.24) -> DataFrame:
    """A row a series: keys, mean, level and coefs (cosine and sine of each harmonic) of the fit of :func:`harmonics`.

    The orthogonal regressors' coefficients are brought back to the cosines and sines themselves, from the last one on.
    """
    rows, names = _orthogonal(df, keys, days, n_harmonics, value, period)
    told = [f"{c}_b{q}" for j, q in enumerate(names) for c in [*names[j + 1 :], "_r"]] + [f"{c}_m" for c in [*names, "_r"]]
    out = rows.groupBy(*keys).agg(*(F.first(c).alias(c) for c in told))
    for j in reversed(range(len(names))):
        rest = F.col(f"_r_b{names[j]}")
        for c in names[j + 1 :]:
            rest = rest - F.col(f"{c}_b{names[j]}") * F.col(f"{c}_x")
        out = out.withColumn(f"{names[j]}_x", rest)
    level = F.col("_r_m")
    for c in names:
        level = level - F.col(f"{c}_m") * F.col(f"{c}_x")
    return out.select(*keys, F.col("_r_m").alias("mean"), level.alias("level"), F.array(*(F.col(f"{c}_x") for c in names)).alias("coefs"))


def seasonal_at(coefficients: DataFrame, targets: DataFrame, keys: list[str], days: str, out: str = "cycle", period: float = 365.24) -> DataFrame:
    """targets (keys, days, ...) with the mean and seasonal cycle of :func:`seasonal_coefficients` at their days."""
    angle = F.lit(2 * math.pi / period) * F.col(days)
    wave = lambda c, k: c * F.when(k % 2 == 0, F.cos(angle * (F.floor(k / 2) + 1))).otherwise(F.sin(angle * (F.floor(k / 2) + 1)))
    value = F.col("level") + F.aggregate(F.transform("coefs", wave), F.lit(0.0), lambda a, b: a + b)
    return targets.join(coefficients.select(*keys, "level", "coefs"), keys).withColumn(out, value).drop("level", "coefs")


def valid_span(df: DataFrame, keys: list[str], idx: str, value: str = "x") -> DataFrame:
    ok = F.when(F.col(value).isNotNull(), F.col(idx))
    return df.groupBy(*keys).agg(F.min(ok).alias("first"), F.max(ok).alias("last"), F.count(value).alias("n"))


def gaps_filled(df: DataFrame, keys: list[str], idx: str, value: str = "x", clamped: bool = False, width: float | None = None) -> DataFrame:
    """Linear interpolation between the nearest values on either side; beyond the first and last nothing, or with
    ``clamped`` their values. ``width`` deals the rows of a hot key to ranges of idx."""
    rows = neighbours(df, keys, idx, F.col(value).isNotNull(), [value], width)
    before, after = F.col(f"_before.{value}"), F.col(f"_after.{value}")
    share = F.try_divide(F.col(idx) - F.col("_before.t"), F.col("_after.t") - F.col("_before.t"))
    filled = before + share * (after - before)
    if clamped:
        filled = F.coalesce(filled, before, after)
    return rows.withColumn("filled", F.coalesce(F.col(value), filled)).drop("_before", "_after")


def lag_arrays(df: DataFrame, keys: list[str], idx: str, named: dict[str, tuple[str, str, list[int]]]) -> DataFrame:
    """A row a series: for each name and its (a, b, lags), arrays name_r and name_n of the Pearson correlations of a at idx
    with b at idx + lag over the pairs that both exist, and the numbers of these pairs.

    A series has one row a place at most. All lags are frames of one window over the rows by series: the rows are shuffled
    and sorted once, whatever the number of lags, and nothing is joined.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(idx).cast("long"))
    later = {f"_{name}{k}": F.max(b).over(w.rangeBetween(lag, lag)) for name, (_, b, lags) in named.items() for k, lag in enumerate(lags)}
    missing = F.lit(None).cast("double")
    out = []
    for name, (a, _, lags) in named.items():
        r = [F.nanvl(F.corr(a, f"_{name}{k}"), missing) for k in range(len(lags))]
        n = [F.count(F.when(F.col(a).isNotNull(), F.col(f"_{name}{k}"))) for k in range(len(lags))]
        out += [F.array(*r).alias(f"{name}_r"), F.array(*n).alias(f"{name}_n")]
    return df.withColumns(later).groupBy(*keys).agg(*out)


def lag_correlation(df: DataFrame, keys: list[str], idx: str, a: str, b: str, lags: list[int]) -> DataFrame:
    """Pearson correlation of a at idx with b at idx + lag over pairs that both exist; positive lag: b is later."""
    rows = lag_arrays(df, keys, idx, {"c": (a, b, lags)})
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, lags)).alias("lag"), F.col("c_r").alias("r"), F.col("c_n").alias("n")))
    return rows.select(*keys, each.alias("_x")).select(*keys, "_x.lag", "_x.r", "_x.n").where("n > 0")


def scale_of(r: str, step: float = 1.0):
    """The integral scale of autocorrelations r at multiples of ``step``: one step and twice the sum up to and with the
    first that is negative or unknown; never below one step. NULL where the first one is unknown."""
    stop = f"coalesce(nullif(array_position(transform({r}, x -> x is null or x < 0), true), 0), size({r}))"
    total = f"aggregate(filter(slice({r}, 1, cast({stop} as int)), x -> x is not null), 0D, (s, x) -> s + x)"
    return F.lit(step) * F.expr(f"case when {r}[0] is not null then 1 + greatest(0D, 2 * {total}) end")


def integral_scale(df: DataFrame, keys: list[str], idx: str, value: str, most: int) -> DataFrame:
    """(keys, scale) by :func:`scale_of` from the autocorrelations at lags 1 to ``most``."""
    return lag_arrays(df, keys, idx, {"c": (value, value, list(range(1, most + 1)))}).select(*keys, scale_of("c_r").alias("scale"))


def time_scale(df: DataFrame, keys: list[str], idx: str, value: str, n: int, delta: float = 1.0) -> DataFrame:
    """(keys, scale) of series of n places: the autocorrelations at :func:`lag_list`, summed over the lags that they
    stand for up to and with the first negative one."""
    lags = lag_list(n)
    weights = lag_weights(lags)
    ends = "array(" + ", ".join(f"{weights[k][k]!r}D" for k in range(len(lags))) + ")"
    inside = "array(" + ", ".join(f"{weights[min(k + 1, len(lags) - 1)][k]!r}D" for k in range(len(lags))) + ")"
    rows = lag_arrays(df, keys, idx, {"c": (value, value, lags)})
    rows = rows.withColumn("_stop", F.expr(f"coalesce(nullif(array_position(transform(c_r, x -> x < 0), true), 0), {len(lags)}) - 1"))
    total = F.expr(f"aggregate(sequence(0, cast(_stop as int)), 0D, (s, k) -> s + coalesce(c_r[k], 0D) * case when k = _stop then ({ends})[k] else ({inside})[k] end)")
    return rows.select(*keys, (F.lit(delta) * F.when(F.col("_stop") == 0, 1.0).otherwise(1 + 2 * total)).alias("scale"))


def line_removed(df: DataFrame, keys: list[str], idx: str, value: str) -> DataFrame:
    """df with value about its line over idx. Values that are not finite, or nothing beside the largest, are missing."""
    w = Window.partitionBy(*keys)
    x = F.col(value).cast("double")
    finite = F.when(F.abs(x) < float("inf"), x)
    good = F.when(F.abs(finite) >= 1e-15 * F.max(F.abs(finite)).over(w), finite)
    rows = df.withColumn(value, good)
    place = F.when(F.col(value).isNotNull(), F.col(idx).cast("double"))
    rows = rows.withColumns({"_mx": F.avg(value).over(w), "_mi": F.avg(place).over(w), "_slope": F.regr_slope(F.col(value), place).over(w)})
    line = F.col("_mx") + F.coalesce(F.col("_slope"), F.lit(0.0)) * (F.col(idx) - F.col("_mi"))
    return rows.withColumn(value, F.col(value) - line).drop("_mx", "_mi", "_slope")


def correlated(df: DataFrame, keys: list[str], idx: str, a: str, b: str, lags: list[int], delta: float = 1.0, step: int = 1, confidence: float = 0.95) -> DataFrame:
    """Lagged correlations of two series with their uncertainty: a row (keys, lag) with r, n, dof, low, high and, for the
    whole series, scale_a, scale_b, dof_zero; significant: the lower bound has the sign of r.

    The columns are those of a series with a row for each of its places, ``delta`` apart. Each series loses its own mean
    and trend first. Integral scales come from the autocorrelations at multiples of ``step`` up to the largest lag; the
    smaller one parts the n pairs of a lag into degrees of freedom, those without a lag are dof_zero. low and high are
    the bounds of smaller and larger size by Fisher's transformation; with 3 degrees or fewer they are of size 1, the lower one with
    the other sign. Lags without a pair have no r and no bounds.
    """
    rows = line_removed(line_removed(df.select(*keys, idx, a, b), keys, idx, a), keys, idx, b)
    own = list(range(step, max(map(abs, lags)) + 1, step))
    rows = lag_arrays(rows, keys, idx, {"c": (a, b, lags), "a": (a, a, own), "b": (b, b, own), "z": (a, b, [0])})
    rows = rows.withColumns({"scale_a": scale_of("a_r", delta * step), "scale_b": scale_of("b_r", delta * step)})
    rows = rows.withColumn("_least", F.least("scale_a", "scale_b")).withColumn("dof_zero", delta * F.col("z_n")[0] / F.col("_least"))
    each = F.explode(F.arrays_zip(F.array(*map(F.lit, lags)).alias("lag"), F.col("c_r").alias("r"), F.col("c_n").alias("n")))
    rows = rows.select(*keys, "scale_a", "scale_b", "dof_zero", "_least", each.alias("_x"))
    rows = rows.select(*keys, "_x.lag", "_x.r", "_x.n", "scale_a", "scale_b", "dof_zero", (delta * F.col("_x.n") / F.col("_least")).alias("dof"))
    width = F.when(F.col("dof") > 3, F.lit(erfinv(confidence) * math.sqrt(2)) / F.sqrt(F.col("dof") - 3)).when(F.col("dof").isNotNull(), F.lit(float("inf")))
    size = F.atanh(F.least(F.abs("r"), F.lit(1.0)))
    rows = rows.withColumns({"low": F.signum("r") * F.tanh(size - width), "high": F.signum("r") * F.tanh(size + width)})
    return rows.withColumn("significant", F.coalesce(F.col("low") * F.col("r") > 0, F.lit(False)))


def interpolated(points: DataFrame, targets: DataFrame, keys: list[str], at: str, value: str = "x", clamped: bool = False, width: float | None = None) -> DataFrame:
    """Linear interpolation of points at the targets; NULL before the first and after the last point, or with
    ``clamped`` their values. ``width`` deals the points of a hot key to ranges of time."""
    marks = points.select(*keys, at, value, F.lit(0).alias("_t")).unionByName(targets.select(*keys, at, F.lit(None).cast("double").alias(value), F.lit(1).alias("_t")))
    rows = marks.groupBy(*keys, at).agg(F.avg(value).alias(value), F.max("_t").alias("_t"))
    return gaps_filled(rows, keys, at, value, clamped, width).where("_t = 1").select(*keys, at, F.col("filled").alias(value))


def interpolated_fourier(df: DataFrame, keys: list[str], at: str, delta: float, targets: list[float], most: float | None = None, value: str = "x") -> DataFrame:
    """Whole, evenly spaced series at other places: mean and trend kept, the rest by its Fourier series up to the
    frequency ``most`` (all of it by default). Series with missing values give NULL."""
    import numpy as np
    import pandas as pd

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        t, x = pdf[at].to_numpy(float), pdf[value].to_numpy(float)
        new = np.array(targets, float)
        out = np.full(len(new), np.nan)
        if len(x) > 1 and np.isfinite(x).all():
            slope, offset = np.polyfit(t, x, 1)
            f = np.fft.fftfreq(len(x), delta)
            c = np.fft.fft(x - slope * t - offset) / len(x)
            keep = np.abs(f) <= (np.inf if most is None else most)
            waves = np.exp(2j * np.pi * np.outer(new - t[0], f[keep]))
            out = (waves @ c[keep]).real + slope * new + offset
        return pd.DataFrame({k: [pdf[k].iloc[0]] * len(new) for k in keys} | {at: new, value: out})

    ship(df.sparkSession)
    schema = df.select(*keys).schema.add(at, "double").add(value, "double")
    return df.select(*keys, at, value).groupBy(*keys).applyInPandas(one, schema).withColumn(value, F.nanvl(value, F.lit(None).cast("double")))
