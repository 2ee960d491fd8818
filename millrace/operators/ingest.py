"""Raw records to canonical events and the business dimension, plus their profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.schema import REVIEW
from millrace.session import growing

# Fixed value: the attribute that carries the price tier in the raw records.
PRICE_PATH = "$.RestaurantsPriceRange2"


def in_metro(city: str, state: str) -> Column:
    return (F.trim("city") == city) & (F.trim("state") == state)


def canonical_events(reviews: DataFrame) -> DataFrame:
    """Typed events with their partition year."""
    ts = F.col("date").cast("timestamp_ntz")
    return reviews.select(
        "user_id",
        "business_id",
        F.lit(REVIEW).alias("event_type"),
        ts.alias("ts"),
        F.round("stars").cast("smallint").alias("stars"),
        F.year(ts).alias("year"),
    )


def ingest_events(
    reviews: DataFrame, businesses: DataFrame, city: str, state: str
) -> DataFrame:
    """Reviews of one metro's businesses as canonical events."""
    members = businesses.filter(in_metro(city, state)).select("business_id")
    return canonical_events(reviews.join(growing(members), "business_id", "left_semi"))


def write_events(events: DataFrame, path: str) -> None:
    """Year-partitioned, overwritten as a whole: re-running yields the same table.

    Rows are spread inside a year by user, so one busy year is many files rather than
    one task's.
    """
    events.repartition("year", "user_id").write.mode("overwrite").partitionBy("year").parquet(
        path
    )


def parse_categories(raw: Column) -> Column:
    """Comma list to trimmed, non-empty tokens; a missing list is an empty one."""
    tokens = F.transform(F.split(raw, ","), lambda t: F.trim(t))
    return F.coalesce(
        F.filter(tokens, lambda t: t != ""), F.array().cast("array<string>")
    )


def parse_price_tier(attributes: Column) -> Column:
    """A tier of 1..4, NULL for anything else, including text and out-of-range digits."""
    tier = F.get_json_object(attributes, PRICE_PATH).try_cast("smallint")
    return F.when(tier.between(1, 4), tier)


def dimension(businesses: DataFrame) -> DataFrame:
    """The seven-column business dimension."""
    return businesses.select(
        "business_id",
        "name",
        "latitude",
        "longitude",
        parse_categories(F.col("categories")).alias("categories"),
        parse_price_tier(F.col("attributes")).alias("price_tier"),
        F.col("is_open").cast("boolean").alias("is_open"),
    )


def build_dim(businesses: DataFrame, city: str, state: str) -> DataFrame:
    return dimension(businesses.filter(in_metro(city, state)))


def write_dim(dim: DataFrame, path: str) -> None:
    """Sorted by id through a range exchange, so the sort stays parallel."""
    dim.orderBy("business_id").write.mode("overwrite").parquet(path)


def event_profile(events: DataFrame) -> DataFrame:
    """Rows, first and last instant per event type, overall (NULL year) and per year."""
    per_year = events.groupBy("event_type", "year").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    overall = per_year.groupBy("event_type").agg(
        F.sum("rows").alias("rows"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
    )
    return per_year.unionByName(overall.withColumn("year", F.lit(None).cast("int")))


def dim_coverage(dim: DataFrame) -> DataFrame:
    def share(condition: Column) -> Column:
        return F.avg(F.when(condition, 1.0).otherwise(0.0))

    return dim.agg(
        share(F.col("latitude").isNotNull()).alias("with_location"),
        share(F.size("categories") > 0).alias("with_categories"),
        share(F.col("price_tier").isNotNull()).alias("with_price"),
        share(F.col("is_open")).alias("open_share"),
        F.avg(F.size("categories")).alias("mean_categories"),
    )


def price_distribution(dim: DataFrame) -> DataFrame:
    return (
        dim.groupBy("price_tier")
        .agg(F.count(F.lit(1)).alias("businesses"))
        .orderBy(F.asc_nulls_last("price_tier"))
    )


def top_categories(dim: DataFrame, n: int = 10) -> DataFrame:
    return (
        dim.select(F.explode("categories").alias("category"))
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("businesses"))
        .orderBy(F.desc("businesses"), "category")
        .limit(n)
    )
