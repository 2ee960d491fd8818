"""The engine's inputs expressed over the driver's star-schema tables.

| input | derived from |
|---|---|
| raw reviews | lineitem joined to its order: customer reviewed part on the order date |
| raw businesses | part; one brand is placed in another city |
| dimension | the raw businesses of both cities |
| events | the raw reviews, canonical form |
| vector state | embeddings, one per entity and yearly boundary |
| request log | events: a request is one user's day, a clock is an event type |
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import ingest
from millrace.schema import REVIEW, SLICE_YEARS
from millrace.session import growing

METRO = ("Philadelphia", "PA")
COLD_SEGMENT = "BUILDING"  # customers of this segment have no vector

# Event types of the driver's log standing in for the clocks of one request.
REQUEST_CLOCKS = {
    "signup": "retrieval_ms",
    "error": "ranking_ms",
    "view": "total_ms",
    "click": "server_ms",
    "purchase": "client_wall_ms",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_key(custkey: Column) -> Column:
    return F.concat(F.lit("u"), custkey.cast("string"))


def item_key(partkey: Column) -> Column:
    return F.concat(F.lit("b"), partkey.cast("string"))


def raw_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(growing(orders), F.col("l_orderkey") == F.col("o_orderkey")).select(
        user_key(F.col("o_custkey")).alias("user_id"),
        item_key(F.col("l_partkey")).alias("business_id"),
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("double").alias("stars"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("date"),
    )


def raw_businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size = F.col("p_partkey"), F.col("p_size")
    price = (
        F.when(size % 10 == 0, F.lit('{"RestaurantsPriceRange2": null}'))
        .when(size % 10 == 1, F.lit('{"RestaurantsPriceRange2": "None"}'))
        .when(size % 10 == 2, F.lit('{"RestaurantsPriceRange2": "9"}'))
        .when(size % 10 == 3, F.lit(None).cast("string"))
        .otherwise(
            F.concat(
                F.lit('{"WiFi": "free", "RestaurantsPriceRange2": "'),
                (1 + size % 4).cast("string"),
                F.lit('"}'),
            )
        )
    )
    return table(spark, sf_dir, "part").select(
        item_key(key).alias("business_id"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_brand") == "Brand#13", "Pittsburgh")
        .otherwise(" Philadelphia ")
        .alias("city"),
        F.lit("PA ").alias("state"),
        (39.8 + (key % 97) * 0.004).alias("latitude"),
        (-75.3 + (key % 89) * 0.004).alias("longitude"),
        F.when(key % 11 == 0, 0).otherwise(1).cast("bigint").alias("is_open"),
        # A part of size 50 is uncategorised; blanks and empties are left for the parser.
        F.when(
            size < 50,
            F.concat(
                F.col("p_type"),
                F.lit(" , "),
                F.col("p_brand"),
                F.lit(",, "),
                F.regexp_replace("p_name", " ", ", "),
            ),
        ).alias("categories"),
        price.alias("attributes"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical events of the raw reviews, without the detour through text dates."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(growing(orders), F.col("l_orderkey") == F.col("o_orderkey")).select(
        user_key(F.col("o_custkey")).alias("user_id"),
        item_key(F.col("l_partkey")).alias("business_id"),
        F.lit(REVIEW).alias("event_type"),
        F.col("o_orderdate").alias("ts"),
        (1 + F.floor((F.col("l_quantity") - 1) / 10)).cast("smallint").alias("stars"),
        F.year("o_orderdate").alias("year"),
    )


def dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.dimension(raw_businesses(spark, sf_dir))


def _vector_rows(
    spark: SparkSession, sf_dir: str, ids: DataFrame, key: str, mult: int, step: int
) -> DataFrame:
    """(key, year, value): every id at every boundary year, spread over the embeddings."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    total = vectors.agg(F.count(F.lit(1))).scalar()
    slots = ids.withColumn("year", F.explode(F.array(*[F.lit(y) for y in SLICE_YEARS])))
    slots = slots.withColumn(
        "vec_id", (F.col("n") * mult + F.col("year").cast("bigint") * step) % total
    )
    return slots.join(growing(vectors), "vec_id").select(
        key, "year", F.col("embedding").alias("value")
    )


def user_vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = (
        table(spark, sf_dir, "customer")
        .filter(F.col("c_mktsegment") != COLD_SEGMENT)
        .select(user_key(F.col("c_custkey")).alias("user_id"), F.col("c_custkey").alias("n"))
    )
    return _vector_rows(spark, sf_dir, ids, "user_id", 7, 1)


def item_vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "part").select(
        item_key(F.col("p_partkey")).alias("business_id"), F.col("p_partkey").alias("n")
    )
    return _vector_rows(spark, sf_dir, ids, "business_id", 11, 3)


def as_state(rows: DataFrame, key: str) -> DataFrame:
    """Vector slices as timestamped state: (key, ts, value)."""
    return rows.select(
        key,
        F.make_timestamp_ntz(
            F.col("year"), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)
        ).alias("ts"),
        "value",
    )


def user_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_state(user_vector_rows(spark, sf_dir), "user_id")


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_state(item_vector_rows(spark, sf_dir), "business_id")


def user_embedding(spark: SparkSession, sf_dir: str, year: int = 2000) -> DataFrame:
    """The retrieval model's user vectors: (user_id, value), cold users absent."""
    rows = user_vector_rows(spark, sf_dir)
    return rows.filter(F.col("year") == year).select("user_id", "value")


def item_embedding(spark: SparkSession, sf_dir: str, year: int = 2000) -> DataFrame:
    rows = item_vector_rows(spark, sf_dir)
    return rows.filter(F.col("year") == year).select("business_id", "value")


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(user_key(F.col("c_custkey")).alias("user_id"))


def review_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feature query per distinct (user, item, instant) that was reviewed."""
    return (
        events(spark, sf_dir)
        .select("user_id", "business_id", "ts")
        .distinct()
        .withColumn(
            "query_id",
            F.concat_ws("|", "user_id", "business_id", F.date_format("ts", "yyyyMMdd")),
        )
    )


def request_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, clock, value): the slowest reading per request and clock."""
    log = table(spark, sf_dir, "events")
    clock = reduce(
        lambda acc, kv: acc.when(F.col("event_type") == kv[0], kv[1]),
        REQUEST_CLOCKS.items(),
        F,
    )
    return (
        log.select(
            F.concat_ws(
                "|", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")
            ).alias("request_id"),
            clock.alias("clock"),
            "value",
        )
        .groupBy("request_id", "clock")
        .agg(F.max("value").alias("value"))
    )
