"""Column expressions shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.schema import EARTH_RADIUS_KM, VECTOR_WIDTH


def great_circle_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance from point 1 to point 2, from the straight line between two points of
    the unit sphere. The steps are those of the SQL answers: another formula of the same distance
    differs in the last bits, which decide the order of scores that are nearly equal."""

    def point(lat: Column, lng: Column) -> list[Column]:
        lat, lng = F.radians(lat), F.radians(lng)
        return [F.cos(lat) * F.cos(lng), F.cos(lat) * F.sin(lng), F.sin(lat)]

    gaps = [F.pow(x - y, F.lit(2.0)) for x, y in zip(point(lat1, lng1), point(lat2, lng2), strict=True)]
    half = F.sqrt(reduce(lambda a, b: a + b, gaps)) / 2
    # Opposite points may come out beyond 1 by rounding.
    return 2 * EARTH_RADIUS_KM * F.asin(F.when(half > 1, F.lit(1.0)).otherwise(half))


def dot(left: Column, right: Column, width: int = VECTOR_WIDTH) -> Column:
    """Inner product in double precision; NULL if either vector is. Vectors of unequal length
    raise.

    Vectors of the expected width take a sum written out element by element, which is
    compiled in small pieces; any other width takes the interpreted lambda form. (The
    lambda also keeps the written-out sum out of one whole-stage method, where it would
    be too long for the JVM to compile.)
    """
    terms = [
        F.get(left, F.lit(i)).cast("double") * F.get(right, F.lit(i)).cast("double")
        for i in range(width)
    ]
    general = F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )
    expected = (F.size(left) == width) & (F.size(right) == width)
    unequal = F.raise_error(F.lit("vectors of unequal length")).cast("double")
    return (
        F.when(expected, reduce(lambda a, b: a + b, terms))
        .when(F.size(left) == F.size(right), general)
        .when(left.isNotNull() & right.isNotNull(), unequal)
    )


def within_size(short_list: DataFrame, size: int, position: str) -> DataFrame:
    """short_list, where evaluating a position outside 1..size raises instead of losing a row."""
    beyond = F.raise_error(F.concat(F.lit(f"a list of {size} has position "), F.col(position)))
    kind = short_list.schema[position].dataType
    checked = F.when(F.col(position).between(1, size), F.col(position)).otherwise(beyond.cast(kind))
    return short_list.withColumn(position, checked)


def hashed_draw(parts: list[Column], size: Column) -> Column:
    """A repeatable draw in [0, size) from the text `a:b:c`, identical in any engine."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    head = F.substring(F.md5(text.cast("binary")), 1, 8)
    return F.conv(head, 16, 10).cast("bigint") % size
