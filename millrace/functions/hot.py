"""Hot keys: the few keys whose rows would overload one task.

A per-key window is the cheapest plan while every key's rows fit a task, and a failure
once one key holds a large share of the data. The two cases are separated by counting:
keys above the threshold take a segmented plan, all others the plain one. The counts are
pre-aggregated per task, and at most rows / HOT_ROWS keys can exceed the threshold, so
the list of hot keys is always small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 4_000_000


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The distinct keys with more than hot_rows rows, marked for broadcast."""
    return F.broadcast(
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > hot_rows)
        .select(*keys)
    )


def split_hot(df: DataFrame, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of ordinary keys, rows of hot keys)."""
    keys = hot.columns
    return df.join(hot, keys, "left_anti"), df.join(hot, keys, "left_semi")
