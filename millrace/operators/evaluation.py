"""The frozen holdout and the metrics measured on it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.popularity import before, day_start, instant
from millrace.schema import REVIEW, TOP_K
from millrace.session import growing

DEFAULT_KS = (10, 50, 100, 500)


def holdout(events: DataFrame, dim: DataFrame, at: datetime) -> DataFrame:
    """(user_id, business_id): catalog items reviewed on or after the split by users with
    earlier catalog history. Day grain; repeats of earlier visits count as targets."""
    catalog = growing(dim.select("business_id"))
    midnight = day_start(at)
    later = (
        events.filter(
            (F.col("event_type") == REVIEW)
            & (F.col("year") >= at.year)
            & (F.col("ts") >= instant(midnight))
        )
        .select("user_id", "business_id")
        .distinct()
    )
    earlier = before(events, midnight).select("user_id", "business_id").distinct()
    known = earlier.join(catalog, "business_id", "left_semi").select("user_id").distinct()
    return (
        later.join(catalog, "business_id", "left_semi")
        .join(growing(known), "user_id", "left_semi")
        .select("user_id", "business_id")
    )


def relevant_counts(truth: DataFrame) -> DataFrame:
    return truth.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_relevant"))


def gain(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + 1)


def ideal_dcg(n: Column, k: int) -> Column:
    positions = F.sequence(F.lit(1), F.least(n, F.lit(k)).cast("int"))
    return F.aggregate(positions, F.lit(0.0), lambda total, i: total + gain(i))


def list_hits(lists: DataFrame, truth: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., user_id, rank) of the recommended items that are targets."""
    return lists.select(*by, "user_id", "business_id", "rank").join(
        truth, ["user_id", "business_id"]
    )


def shared_list_hits(head: DataFrame, truth: DataFrame) -> DataFrame:
    """The same for one list served to everyone: targets meet the list directly, so it is
    never copied per user."""
    return truth.join(head.select("business_id", "rank"), "business_id").select(
        "user_id", "business_id", "rank"
    )


def user_metrics(
    hits: DataFrame, truth: DataFrame, ks: Sequence[int], by: Sequence[str] = ()
) -> DataFrame:
    """(by..., user_id, recall@k..., ndcg@10, n_relevant) for users with at least one hit;
    all other users have zeros."""
    counted = hits.groupBy(*by, "user_id").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"_h{k}") for k in ks],
        F.sum(F.when(F.col("rank") <= TOP_K, gain(F.col("rank"))).otherwise(0.0)).alias("_dcg"),
    )
    return counted.join(relevant_counts(truth), "user_id").select(
        *by,
        "user_id",
        *[(F.col(f"_h{k}") / F.col("n_relevant")).alias(f"recall@{k}") for k in ks],
        (F.col("_dcg") / ideal_dcg(F.col("n_relevant"), TOP_K)).alias(f"ndcg@{TOP_K}"),
        "n_relevant",
    )


def recall_at_k(hits: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(user_id, recall) for every holdout user."""
    name = f"recall@{k}"
    found = user_metrics(hits, truth, [k]).select("user_id", F.col(name).alias("recall"))
    users = relevant_counts(truth).select("user_id")
    return users.join(found, "user_id", "left").withColumn(
        "recall", F.coalesce("recall", F.lit(0.0))
    )


def ndcg_at_k(hits: DataFrame, truth: DataFrame, k: int = TOP_K) -> DataFrame:
    """(user_id, ndcg) for every holdout user."""
    users = relevant_counts(truth)
    gained = (
        hits.filter(F.col("rank") <= k)
        .groupBy("user_id")
        .agg(F.sum(gain(F.col("rank"))).alias("_dcg"))
    )
    return users.join(gained, "user_id", "left").select(
        "user_id",
        (F.coalesce("_dcg", F.lit(0.0)) / ideal_dcg(F.col("n_relevant"), k)).alias("ndcg"),
    )


def evaluate(
    hits: DataFrame, truth: DataFrame, names: Sequence[str], ks: Sequence[int] = DEFAULT_KS
) -> DataFrame:
    """(name, n_users, metric, value): macro averages over all holdout users.

    hits carry a `name` column; a name without any hit reports zeros.
    """
    spark = truth.sparkSession
    metrics = [*[f"recall@{k}" for k in ks], f"ndcg@{TOP_K}"]
    n_users = truth.agg(F.count_distinct("user_id").alias("n_users"))
    sums = (
        user_metrics(hits, truth, ks, ["name"])
        .groupBy("name")
        .agg(*[F.sum(m).alias(m) for m in metrics])
    )
    listed = spark.range(1).select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias("name"),
        n_users.scalar().alias("n_users"),
    )
    return (
        listed.join(sums, "name", "left")
        .unpivot(["name", "n_users"], metrics, "metric", "value")
        .withColumn(
            "value",
            F.coalesce(F.col("value") / F.nullif(F.col("n_users"), F.lit(0)), F.lit(0.0)),
        )
    )


def named_hits(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of several recommenders' hits, labelled by name."""
    labelled = [
        hits.select(F.lit(name).alias("name"), "user_id", "rank")
        for name, hits in parts.items()
    ]
    return reduce(DataFrame.unionByName, labelled)


def marginal_hits(first: DataFrame, second: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(source, pairs, share): which of two recommenders finds each target within k.

    Both inputs are hits (user_id, business_id, rank).
    """

    def mark(hits: DataFrame, name: str) -> DataFrame:
        return hits.filter(F.col("rank") <= k).select(
            "user_id", "business_id", F.lit(True).alias(name)
        )

    keys = ["user_id", "business_id"]
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    split = (
        truth.join(mark(first, "_a"), keys, "left")
        .join(mark(second, "_b"), keys, "left")
        .agg(
            F.count(F.lit(1)).alias("_all"),
            F.count_if(a & b).alias("both"),
            F.count_if(a & ~b).alias("first_only"),
            F.count_if(~a & b).alias("second_only"),
            F.count_if(~a & ~b).alias("neither"),
        )
    )
    return split.unpivot(
        ["_all"], ["both", "first_only", "second_only", "neither"], "source", "pairs"
    ).select(
        "source",
        "pairs",
        F.coalesce(F.col("pairs") / F.nullif(F.col("_all"), F.lit(0)), F.lit(0.0)).alias("share"),
    )


def repeat_hit_share(ranked: DataFrame, truth: DataFrame, reviewed: DataFrame, k: int = TOP_K) -> DataFrame:
    """One row (hits, repeats): top-k hits, and those among earlier reviews."""
    seen = reviewed.select("user_id", "business_id", F.lit(1).alias("_seen"))
    return (
        list_hits(ranked.filter(F.col("rank") <= k), truth)
        .join(seen, ["user_id", "business_id"], "left")
        .agg(F.count(F.lit(1)).alias("hits"), F.count("_seen").alias("repeats"))
    )


def closed_target_share(truth: DataFrame, dim: DataFrame) -> DataFrame:
    """One row (pairs, closed, share): targets that are closed or not in the catalog."""
    closed = ~F.coalesce("is_open", F.lit(False))
    return (
        truth.join(growing(dim.select("business_id", "is_open")), "business_id", "left")
        .agg(F.count(F.lit(1)).alias("pairs"), F.count_if(closed).alias("closed"))
        .withColumn("share", F.col("closed") / F.nullif(F.col("pairs"), F.lit(0)))
    )


def _bin(value: Column, resolution: int) -> Column:
    """An order-preserving coarse bin of any real number."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value)) * resolution)


def percentile_nearest_rank(
    samples: DataFrame,
    by: Sequence[str],
    value: str,
    percentiles: Sequence[float],
    resolution: int = 256,
) -> DataFrame:
    """(by..., percentile, value): the smallest sample that covers p percent of them.

    Exact selection in two steps, so no group is ever sorted whole. Counts per coarse
    bin locate the one bin that holds each wanted rank; only that bin's distinct values
    are then walked.
    """
    by = list(by)
    counted = (
        samples.filter(F.col(value).isNotNull())
        .groupBy(*by, value)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_bin", _bin(F.col(value), resolution))
    )
    upto = W.partitionBy(*by).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)
    bins = (
        counted.groupBy(*by, "_bin")
        .agg(F.sum("_n").alias("_n"))
        .withColumn("_cum", F.sum("_n").over(upto))
        .withColumn("_total", F.sum("_n").over(W.partitionBy(*by)))
        .withColumn("percentile", F.explode(F.array(*[F.lit(float(p)) for p in percentiles])))
        .withColumn(
            "_rank",
            F.greatest(F.lit(1), F.ceil(F.col("percentile") / 100.0 * F.col("_total"))),
        )
        .filter((F.col("_rank") <= F.col("_cum")) & (F.col("_rank") > F.col("_cum") - F.col("_n")))
        .select(
            *by, "_bin", "percentile", (F.col("_rank") - (F.col("_cum") - F.col("_n"))).alias("_rank")
        )
    )
    inside = W.partitionBy(*by, "percentile", "_bin").orderBy(value)
    walked = counted.join(bins, [*by, "_bin"]).withColumn(
        "_cum", F.sum("_n").over(inside.rowsBetween(W.unboundedPreceding, 0))
    )
    return walked.filter(
        (F.col("_cum") >= F.col("_rank")) & (F.col("_cum") - F.col("_n") < F.col("_rank"))
    ).select(*by, "percentile", value)
