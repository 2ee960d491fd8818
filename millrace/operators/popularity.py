"""Popularity: the whole-catalog ranking and the short pool cut from it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.order import in_order
from millrace.schema import POOL_SIZE, REVIEW
from millrace.session import growing


def instant(at: datetime) -> Column:
    """A zone-free literal. Written as text: a datetime literal would pass through the
    driver's and the session's time zones."""
    return F.lit(at.isoformat(" ")).cast("timestamp_ntz")


def day_start(at: datetime) -> datetime:
    """Day-grain bound: an event on the split's own date is not history. Written on the
    timestamp, not on its date, so that the scan can use it."""
    return datetime(at.year, at.month, at.day)


def before(events: DataFrame, at: datetime) -> DataFrame:
    """Review events strictly earlier than `at`; the bound on year prunes partitions."""
    return events.filter(
        (F.col("event_type") == REVIEW)
        & (F.col("year") <= at.year)
        & (F.col("ts") < instant(at))
    )


def catalog_counts(events: DataFrame, dim: DataFrame, at: datetime) -> DataFrame:
    """(business_id, name, pre_t_reviews) for the whole catalog, zero counts included."""
    counted = (
        before(events, day_start(at))
        .groupBy("business_id")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        dim.select("business_id", F.coalesce("name", F.lit("")).alias("name"))
        .join(growing(counted), "business_id", "left")
        .select("business_id", "name", F.coalesce("n", F.lit(0)).alias("pre_t_reviews"))
    )


def popularity_rank(events: DataFrame, dim: DataFrame, at: datetime) -> DataFrame:
    """Every catalog item by (count desc, id asc), with its position."""
    order = [F.desc("pre_t_reviews"), F.asc("business_id")]
    return in_order(catalog_counts(events, dim, at), order)


def popularity_pool(events: DataFrame, at: datetime, size: int = POOL_SIZE) -> DataFrame:
    """(business_id, pool_rank): the `size` most reviewed items; no zero-count rows.

    At most `size` rows, a fixed setting, so the position window over them is one small
    task and the pool may be broadcast.
    """
    top = (
        before(events, at)
        .groupBy("business_id")
        .agg(F.count(F.lit(1)).alias("reviews"))
        .orderBy(F.desc("reviews"), "business_id")
        .limit(size)
    )
    return number_short_list(
        top, [F.desc("reviews"), F.asc("business_id")], "pool_rank", size
    )


def number_short_list(df: DataFrame, order: list[Column], name: str, size: int) -> DataFrame:
    """Positions 1..n of a list whose length is bounded by a setting, not by the data."""
    return df.withColumn(name, F.row_number().over(W.orderBy(*order))).filter(
        F.col(name) <= size
    )
