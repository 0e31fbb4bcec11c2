"""All queries of the library over the driver's tables, with the equivalent SQL."""

from __future__ import annotations

from gridtide.plans import attribution, files, filtering, series, space, times  # noqa: F401
from gridtide.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
