"""Inputs of a two-tower retriever: examples, normalised inputs, sampler arithmetic."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions.expressions import dot, hashed_draw
from millrace.functions.order import in_order
from millrace.operators.features import Store, asof_features, current_features
from millrace.operators.popularity import before
from millrace.session import growing

# Fixed values of the sampler and the user-side inputs.
USER_INPUTS = ("u_reviews_to_date", "u_mean_stars_to_date", "u_days_since_last")
BATCH = 512
UNIFORM = 128
TEMPERATURE = 0.07
SEED = 42


def two_tower_examples(
    events: DataFrame, dim: DataFrame, store: Store, at: datetime
) -> DataFrame:
    """One row per pre-split review of a catalog item, with the user's as-of inputs."""
    asked = (
        before(events, at)
        .join(growing(dim.select("business_id")), "business_id", "left_semi")
        .groupBy("user_id", "business_id", "ts")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("query_id", F.concat_ws("|", "user_id", "business_id", "ts"))
    )
    read = asof_features(asked, store, USER_INPUTS)
    # Equal reviews are read once and repeated afterwards.
    repeated = read.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("user_id", "business_id", "ts", *USER_INPUTS)


def _filled_log(column: str) -> Column:
    return F.log1p(F.coalesce(F.col(column).cast("double"), F.lit(0.0)))


def _safe_std(values: Column) -> Column:
    spread = F.stddev_pop(values)
    return F.when(spread > 1e-8, spread).otherwise(1.0)


def user_normalization(examples: DataFrame) -> DataFrame:
    """One row: mean and population deviation of the two log-scaled inputs."""
    count, days = _filled_log("u_reviews_to_date"), _filled_log("u_days_since_last")
    return examples.agg(
        F.avg(count).alias("log_count_mean"),
        _safe_std(count).alias("log_count_std"),
        F.avg(days).alias("log_days_mean"),
        _safe_std(days).alias("log_days_std"),
    )


def normalized_user_inputs(values: DataFrame, fitted: DataFrame) -> DataFrame:
    """Five finite inputs: two standardised values, the rating and two presence flags."""

    def constant(name: str) -> Column:
        return fitted.select(name).scalar()

    stars, days = F.col("u_mean_stars_to_date"), F.col("u_days_since_last")
    return values.withColumns(
        {
            "count_z": (_filled_log("u_reviews_to_date") - constant("log_count_mean"))
            / constant("log_count_std"),
            "stars_fifth": F.coalesce(stars, F.lit(0.0)) / 5.0,
            "stars_present": stars.isNotNull().cast("double"),
            "days_z": (_filled_log("u_days_since_last") - constant("log_days_mean"))
            / constant("log_days_std"),
            "days_present": days.isNotNull().cast("double"),
        }
    )


def item_inputs(dim: DataFrame) -> DataFrame:
    """Long form (business_id, feature, value): place, price, presence, categories.

    Whether an item is open is a serving rule and deliberately not an input.
    """

    def z(column: str) -> Column:
        fitted = dim.agg(F.avg(column).alias("m"), _safe_std(F.col(column)).alias("s"))
        return (F.col(column) - fitted.select("m").scalar()) / fitted.select("s").scalar()

    dense = dim.select(
        "business_id",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(name).alias("feature"), value.alias("value"))
                    for name, value in {
                        "latitude_z": z("latitude"),
                        "longitude_z": z("longitude"),
                        "price_quarter": F.coalesce(F.col("price_tier") / 4.0, F.lit(0.0)),
                        "price_present": F.col("price_tier").isNotNull().cast("double"),
                    }.items()
                ]
            )
        ),
    )
    hot = dim.select(
        "business_id",
        F.explode(F.array_distinct("categories")).alias("category"),
    ).select(
        "business_id",
        F.concat(F.lit("category:"), F.col("category")).alias("feature"),
        F.lit(1.0).alias("value"),
    )
    return dense.unionByName(hot)


def sampling_probability(
    examples: DataFrame, dim: DataFrame, batch: int = BATCH, uniform: int = UNIFORM
) -> DataFrame:
    """(business_id, draws, q): how likely the batch sampler proposes each catalog item.

    A mixture by size of in-batch draws (the items' frequency) and uniform draws, which
    keep q above zero for an item that never was a positive.
    """
    drawn = examples.groupBy("business_id").agg(F.count(F.lit(1)).alias("draws"))
    total = examples.agg(F.count(F.lit(1))).scalar()
    catalog = dim.agg(F.count(F.lit(1))).scalar()
    n = F.coalesce("draws", F.lit(0))
    return (
        dim.select("business_id")
        .join(growing(drawn), "business_id", "left")
        .select(
            "business_id",
            n.alias("draws"),
            ((batch * n / total + uniform / catalog) / (batch + uniform)).alias("q"),
        )
    )


def batches(examples: DataFrame, batch: int = BATCH) -> DataFrame:
    """(batch_id, slot, user_id, business_id): examples in (user, time, item) order, cut
    into batches."""
    rows = examples.select("user_id", "business_id", "ts")
    ranked = in_order(rows, [F.asc("user_id"), F.asc("ts"), F.asc("business_id")], "_n")
    at = F.col("_n") - 1
    return ranked.select(
        F.floor(at / batch).alias("batch_id"),
        (at % batch).cast("int").alias("slot"),
        "user_id",
        "business_id",
    )


def batch_candidates(
    rows: DataFrame,
    items: DataFrame,
    batch: int = BATCH,
    uniform: int = UNIFORM,
    seed: int = SEED,
) -> DataFrame:
    """(batch_id, position, business_id): a batch's own positives, then uniform draws.

    items is (business_id, item_idx), the dense catalog index.
    """
    own = rows.select("batch_id", F.col("slot").alias("position"), "business_id")
    catalog = items.agg(F.count(F.lit(1))).scalar()
    drawn = (
        rows.select("batch_id")
        .distinct()
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(uniform - 1))))
        .withColumn(
            "item_idx",
            hashed_draw([F.lit(seed), F.col("batch_id"), F.col("_j")], catalog),
        )
        .join(growing(items), "item_idx")
        .select("batch_id", (F.col("_j") + batch).alias("position"), "business_id")
    )
    return own.unionByName(drawn)


def known_positive_mask(
    rows: DataFrame, candidates: DataFrame, interactions: DataFrame
) -> DataFrame:
    """The masked cells (batch_id, slot, position) of every batch's score matrix.

    Sparse: a cell exists only where the row's user has reviewed the candidate; the
    row's own target on the diagonal stays unmasked. Unlisted cells are unmasked. Users
    meet their candidates through their own history, batch by batch, so no full matrix
    is formed.
    """
    # One row per (batch, user): a user's rows in a batch share their observed items.
    users = rows.select("batch_id", "user_id").distinct()
    listed = candidates.groupBy("batch_id", "business_id").agg(
        # At most batch + uniform positions exist in a batch.
        F.collect_list("position").alias("positions")
    )
    seen = (
        users.join(growing(interactions.select("user_id", "business_id")), "user_id")
        .join(growing(listed), ["batch_id", "business_id"])
        .select("batch_id", "user_id", F.explode("positions").alias("position"))
    )
    return (
        seen.join(growing(rows.select("batch_id", "user_id", "slot")), ["batch_id", "user_id"])
        .filter(F.col("slot") != F.col("position"))
        .select("batch_id", "slot", "position")
    )


def logq_scores(
    pairs: DataFrame,
    user_vectors: DataFrame,
    item_vectors: DataFrame,
    probability: DataFrame,
    temperature: float = TEMPERATURE,
) -> DataFrame:
    """pairs plus (similarity, logit): similarity over temperature, then minus ln q.

    The correction applies to the scaled score; scaling it too would correct for another
    sampler.
    """
    return (
        pairs.join(growing(user_vectors.withColumnRenamed("value", "_u")), "user_id")
        .join(growing(item_vectors.withColumnRenamed("value", "_i")), "business_id")
        .withColumn("similarity", dot(F.col("_u"), F.col("_i")))
        .drop("_u", "_i")
        .join(growing(probability.select("business_id", "q")), "business_id")
        .withColumn("logit", F.col("similarity") / temperature - F.ln("q"))
        .drop("q")
    )


def export_user_inputs(users: DataFrame, store: Store, at: datetime) -> DataFrame:
    """Every known user's inputs at the split, through the one-instant path."""
    asked = users.select(
        "user_id", F.lit("").alias("business_id"), F.col("user_id").alias("query_id")
    )
    return current_features(asked, store, at, USER_INPUTS).select("user_id", *USER_INPUTS)
