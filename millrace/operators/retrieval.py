"""Exact inner-product retrieval and the popularity fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import within_size
from millrace.operators.blocks import ITEM_BLOCK, shared_lists
from millrace.operators.popularity import number_short_list
from millrace.schema import POOL_SIZE
from millrace.session import growing


def exact_topk(
    users: DataFrame,
    items: DataFrame,
    k: int = POOL_SIZE,
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """(user_id, business_id, score, rank): full-catalog inner product, id breaks ties."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return spread(*shared_lists(users, items, k, item_block))


def spread(members: DataFrame, lists: DataFrame) -> DataFrame:
    """(user_id, business_id, score, rank): every member with its list of bounded length."""
    packed = lists.groupBy("list_id").agg(F.collect_list(F.struct("business_id", "score", "rank")).alias("_list"))
    # Small rows grow here, so they are spread by number, which adaptive execution leaves alone.
    width = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(width, "list_id")
    return dealt.join(growing(packed.repartition(width, "list_id")), "list_id").select("user_id", F.inline("_list"))


def topk_hits(users: DataFrame, items: DataFrame, pairs: DataFrame, k: int = POOL_SIZE) -> DataFrame:
    """(user_id, business_id, rank) of the pairs that are on the users' exact top-k lists; no list is
    copied for the users that share it."""
    return on_lists(pairs, *shared_lists(users, items, k))


def on_lists(pairs: DataFrame, members: DataFrame, lists: DataFrame) -> DataFrame:
    listed = lists.select("list_id", "business_id", "rank")
    return (
        pairs.join(growing(members), "user_id")
        .join(growing(listed), ["list_id", "business_id"])
        .select("user_id", "business_id", "rank")
    )


def popularity_head(ranked_counts: DataFrame, size: int = POOL_SIZE) -> DataFrame:
    """(business_id, name, pre_t_reviews, rank): the first `size` of the catalog ranking,
    zero-count items included."""
    order = [F.desc("pre_t_reviews"), F.asc("business_id")]
    return number_short_list(
        ranked_counts.orderBy(*order).limit(size), order, "rank", size
    )


def per_user(users: DataFrame, short_list: DataFrame, size: int, position: str) -> DataFrame:
    """Every user with the shared list: slots 1..size matched to list positions.

    The list has at most `size` rows, a setting, so it may be broadcast; a position beyond it
    raises.
    """
    width = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = users.repartition(width, "user_id").withColumn(position, F.explode(F.sequence(F.lit(1), F.lit(size))))
    return slots.join(F.broadcast(within_size(short_list, size, position)), position)


def retrieve(
    users: DataFrame,
    user_vectors: DataFrame,
    item_vectors: DataFrame,
    head: DataFrame,
    k: int = POOL_SIZE,
) -> DataFrame:
    """(user_id, business_id, score, rank, cold): exact top-k, or popularity if unknown."""
    known = users.join(growing(user_vectors), "user_id")
    warm = exact_topk(known, item_vectors, k).withColumn("cold", F.lit(False))
    unknown = users.join(growing(user_vectors.select("user_id")), "user_id", "left_anti")
    cold = per_user(unknown, head, k, "rank").select(
        "user_id",
        "business_id",
        F.col("pre_t_reviews").cast("double").alias("score"),
        "rank",
        F.lit(True).alias("cold"),
    )
    return warm.unionByName(cold)
