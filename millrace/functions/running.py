"""Running totals along an entity's timeline, safe for entities of any size.

Ordinary entities use one window per entity. A hot entity's timeline is cut into time
segments that different tasks hold: the window runs inside (entity, segment), and each
segment is lifted by the total of the entity's earlier segments. The carry table has one
row per (hot entity, segment), so its own per-entity window is as long as the number of
segments, not the number of events.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.hot import split_hot
from millrace.functions.timegrain import DEFAULT_GRAIN, segment


def _add(carry: Column, local: Column) -> Column:
    """SQL sum of two partial sums: NULL only while nothing has been summed yet."""
    return F.when(
        carry.isNotNull() | local.isNotNull(),
        F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0)),
    )


def _plain(df: DataFrame, keys: list[str], ts: str, totals: Mapping[str, str]) -> DataFrame:
    upto = W.partitionBy(*keys).orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    return df.select(
        *keys, ts, *[F.sum(src).over(upto).cast("bigint").alias(out) for out, src in totals.items()]
    )


def _segmented(
    df: DataFrame, keys: list[str], ts: str, totals: Mapping[str, str], grain: str
) -> DataFrame:
    pieces = df.withColumn("_seg", segment(F.col(ts), grain))
    inside = W.partitionBy(*keys, "_seg").orderBy(ts).rowsBetween(W.unboundedPreceding, 0)
    local = pieces.select(
        *keys,
        "_seg",
        ts,
        *[F.sum(src).over(inside).alias(out) for out, src in totals.items()],
    )
    earlier = W.partitionBy(*keys).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    carry = (
        pieces.groupBy(*keys, "_seg")
        .agg(*[F.sum(src).alias(out) for out, src in totals.items()])
        .select(
            *keys,
            "_seg",
            *[F.sum(out).over(earlier).alias(f"_carry_{out}") for out in totals],
        )
    )
    return local.join(carry, [*keys, "_seg"], "inner").select(
        *keys,
        ts,
        *[
            _add(F.col(f"_carry_{out}"), F.col(out)).cast("bigint").alias(out)
            for out in totals
        ],
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    totals: Mapping[str, str],
    hot: DataFrame,
    grain: str = DEFAULT_GRAIN,
) -> DataFrame:
    """(keys, ts, totals...) with inclusive running sums; df is unique on keys + ts.

    hot lists the hot entities (a subset of the key columns), see hot_keys.
    """
    ordinary, heavy = split_hot(df, hot)
    return _plain(ordinary, list(keys), ts, totals).unionByName(
        _segmented(heavy, list(keys), ts, totals, grain)
    )
