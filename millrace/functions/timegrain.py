"""Order-preserving time segments.

A segment splits one entity's timeline into pieces that different tasks can hold. All
grains are plain integers computed from calendar fields, so they never depend on the
session time zone, and a later instant never lands in an earlier segment.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("year", "month", "day", "hour")
DEFAULT_GRAIN = "month"


def segment(ts: Column, grain: str = DEFAULT_GRAIN) -> Column:
    if grain == "year":
        return F.year(ts)
    if grain == "month":
        return F.year(ts) * F.lit(12) + F.month(ts)
    if grain == "day":
        return F.unix_date(F.to_date(ts))
    if grain == "hour":
        return F.unix_date(F.to_date(ts)) * F.lit(24) + F.hour(ts)
    raise ValueError(f"unknown grain {grain!r}; known: {', '.join(GRAINS)}")
