"""Readers for the raw records and the canonical tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schema import RAW_BUSINESS, RAW_REVIEW


def read_businesses(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited JSON business records; never infers a schema."""
    return spark.read.schema(RAW_BUSINESS).json(path)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited JSON reviews; fields outside the schema are not parsed."""
    return spark.read.schema(RAW_REVIEW).json(path)


def read_events(spark: SparkSession, path: str, before: datetime | None = None) -> DataFrame:
    """The year-partitioned event table, right-exclusively cut at `before`.

    The bound on `year` repeats the bound on `ts` so that whole partitions are skipped;
    the bound on `ts` alone would open every file.
    """
    events = spark.read.parquet(path)
    if before is None:
        return events
    return events.filter(
        (F.col("year") <= before.year) & (F.col("ts") < F.lit(before).cast("timestamp_ntz"))
    )
