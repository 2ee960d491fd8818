"""Cumulative, inclusive state timelines per user, item and (user, category).

State is never cut at the split: strictness belongs to the reader. Ties on (entity,
instant) are collapsed first, which also is the map-side reduction that keeps a hot
entity's shuffle small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.hot import HOT_ROWS, hot_keys
from millrace.functions.running import running_totals
from millrace.functions.timegrain import DEFAULT_GRAIN
from millrace.schema import GEO_SCALE, ITEM_TOTALS, REVIEW, USER_TOTALS
from millrace.session import growing

STATE_KEYS = {
    "user": ("user_id", "ts"),
    "item": ("business_id", "ts"),
    "user_category": ("user_id", "category", "ts"),
}


def _reviews(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == REVIEW)


def _fixed_point(degrees: str) -> Column:
    # Integer sums are associative, so any partial-aggregation order is bit-exact.
    return F.sum(F.round(F.col(degrees) * GEO_SCALE).cast("bigint"))


def _placed(events: DataFrame, dim: DataFrame) -> DataFrame:
    return _reviews(events).join(
        growing(dim.select("business_id", "latitude", "longitude", "price_tier")),
        "business_id",
        "left",
    )


def _user_sums() -> list[Column]:
    sums = (
        F.count(F.lit(1)),
        F.sum("stars"),
        _fixed_point("latitude"),
        _fixed_point("longitude"),
        F.count("latitude"),
        F.sum("price_tier"),
        F.count("price_tier"),
    )
    return [s.alias(name) for name, s in zip(USER_TOTALS, sums)]


def _item_sums() -> list[Column]:
    return [F.count(F.lit(1)).alias("cum_count"), F.sum("stars").alias("cum_sum")]


def _in_place(names: Sequence[str]) -> dict[str, str]:
    return {name: name for name in names}


def user_state(
    events: DataFrame, dim: DataFrame, grain: str = DEFAULT_GRAIN, hot_rows: int = HOT_ROWS
) -> DataFrame:
    per_instant = _placed(events, dim).groupBy("user_id", "ts").agg(*_user_sums())
    hot = hot_keys(_reviews(events), ["user_id"], hot_rows)
    return running_totals(per_instant, ["user_id"], "ts", _in_place(USER_TOTALS), hot, grain)


def user_totals(events: DataFrame, dim: DataFrame) -> DataFrame:
    """The last user_state row of the given events, without building the timeline."""
    return _placed(events, dim).groupBy("user_id").agg(F.max("ts").alias("ts"), *_user_sums())


def item_state(
    events: DataFrame, grain: str = DEFAULT_GRAIN, hot_rows: int = HOT_ROWS
) -> DataFrame:
    per_instant = _reviews(events).groupBy("business_id", "ts").agg(*_item_sums())
    hot = hot_keys(_reviews(events), ["business_id"], hot_rows)
    return running_totals(per_instant, ["business_id"], "ts", _in_place(ITEM_TOTALS), hot, grain)


def item_totals(events: DataFrame) -> DataFrame:
    return (
        _reviews(events).groupBy("business_id").agg(F.max("ts").alias("ts"), *_item_sums())
    )


def item_categories(dim: DataFrame) -> DataFrame:
    """(business_id, category), one row per listed category, duplicates kept."""
    return dim.select("business_id", F.explode("categories").alias("category"))


def user_category_state(
    events: DataFrame, dim: DataFrame, grain: str = DEFAULT_GRAIN, hot_rows: int = HOT_ROWS
) -> DataFrame:
    # Collapse before exploding: repeats of one item at one instant explode once.
    per_item = (
        _reviews(events)
        .groupBy("user_id", "business_id", "ts")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    per_instant = (
        per_item.join(growing(item_categories(dim)), "business_id")
        .groupBy("user_id", "category", "ts")
        .agg(F.sum("n").alias("cum_count"))
    )
    # A (user, category) timeline is never longer than its user's.
    hot = hot_keys(_reviews(events), ["user_id"], hot_rows)
    return running_totals(
        per_instant, ["user_id", "category"], "ts", {"cum_count": "cum_count"}, hot, grain
    )


def user_category_totals(events: DataFrame, dim: DataFrame) -> DataFrame:
    per_item = (
        _reviews(events)
        .groupBy("user_id", "business_id")
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts"))
    )
    return (
        per_item.join(growing(item_categories(dim)), "business_id")
        .groupBy("user_id", "category")
        .agg(F.max("ts").alias("ts"), F.sum("n").alias("cum_count"))
    )


def write_states(states: Mapping[str, DataFrame], path: str) -> DataFrame:
    """Write every group sorted by its total key; returns (group, rows).

    A range exchange on (entity, ts) rather than a hash on the entity: the rows of a hot
    entity spread over several files, and files stay prunable by entity.
    """
    written = []
    for group, state in states.items():
        target = f"{path}/{group}"
        state.orderBy(*STATE_KEYS[group]).write.mode("overwrite").parquet(target)
        rows = state.sparkSession.read.parquet(target).agg(F.count(F.lit(1)).alias("rows"))
        written.append(rows.select(F.lit(group).alias("state_group"), "rows"))
    return reduce(DataFrame.unionByName, written)


def state_counts(states: Mapping[str, DataFrame]) -> DataFrame:
    """(state_group, rows) without writing."""
    parts = [
        s.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(g).alias("state_group"), "rows")
        for g, s in states.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def timeline_example(user: DataFrame, low: int = 4, high: int = 6) -> DataFrame:
    """The first user with a short timeline: each instant's running mean and centroid."""
    chosen = (
        user.groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n").between(low, high))
        .agg(F.min("user_id").alias("user_id"))
    )
    scaled = F.lit(float(GEO_SCALE)) * F.nullif(F.col("cum_geo_n"), F.lit(0))
    return user.join(chosen, "user_id", "left_semi").select(
        "user_id",
        "ts",
        "cum_count",
        (F.col("cum_sum") / F.col("cum_count")).alias("mean_stars"),
        (F.col("cum_lat_e7") / scaled).alias("mean_lat"),
        (F.col("cum_lng_e7") / scaled).alias("mean_lng"),
    )
