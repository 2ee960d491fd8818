"""Helpers shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import registry
from millrace.operators.features import Store, build_store, store_before
from millrace.schema import SPLIT_T
from millrace.session import materialized
from millrace.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
DIGITS = 6  # decimals of reported fractions


def rounded(df: DataFrame, columns: Sequence[str], digits: int = DIGITS) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def fractional(names: Sequence[str] | None = None) -> list[str]:
    return [f.name for f in registry.resolve(names) if f.dtype == "double"]


def full_store(spark: SparkSession, sf_dir: str) -> Store:
    """Every timeline, materialised before it is read: the reads use each group several
    times and rely on its size. Vector states are tables as they are."""
    return stored(
        build_store(
            materialized(tables.events(spark, sf_dir), "events"),
            materialized(tables.dim(spark, sf_dir), "dim"),
            tables.user_vectors(spark, sf_dir),
            tables.item_vectors(spark, sf_dir),
        )
    )


def stored(store: Store) -> Store:
    groups = {
        f.name: getattr(store, f.name)
        for f in fields(store)
        if f.name not in ("dim", "user_als", "item_als", "vector_width")
    }
    return replace(
        store,
        **{name: materialized(df, name) for name, df in groups.items() if df is not None},
    )


def split_store(spark: SparkSession, sf_dir: str) -> Store:
    """Current state at the frozen split."""
    return store_before(
        tables.events(spark, sf_dir),
        tables.dim(spark, sf_dir),
        SPLIT_T,
        tables.user_vectors(spark, sf_dir),
        tables.item_vectors(spark, sf_dir),
    )
