"""Numbers that the filters need before a query runs: erf band weights and their kernels."""

from __future__ import annotations

import math
from statistics import NormalDist


def erfinv(x: float) -> float:
    return NormalDist().inv_cdf((x + 1) / 2) / math.sqrt(2)


def band_weight(f: float, low: float, high: float, steep: float, half_power: bool = True) -> float:
    """Response at frequency f of the band from low to high whose edges follow the error function of ln f."""
    if f == 0:
        return 0.0
    a = math.exp(erfinv(math.sqrt(2) - 1) / steep) if half_power else 1.0
    lower = math.erf(steep * (math.log(abs(f)) - math.log(low / a))) if low > 0 else 1.0
    upper = math.erf(steep * (math.log(abs(f)) - math.log(high * a))) if math.isfinite(high) else -1.0
    return 0.5 * (lower - upper)


def band_kernel(n: int, delta: float, low: float, high: float, steep: float, half_power: bool = True) -> list[float]:
    """Circular convolution kernel of length n of the band: the real inverse transform of its weights."""
    weights = [band_weight(((k + n // 2) % n - n // 2) / (n * delta), low, high, steep, half_power) for k in range(n)]
    return [sum(w * math.cos(2 * math.pi * k * i / n) for k, w in enumerate(weights)) / n for i in range(n)]
