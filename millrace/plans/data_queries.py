"""Registered queries: ingest, dimension, profiles, popularity, state, feature reads."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.registry import feature_names
from millrace.operators import audit, ingest, popularity, snapshot, state
from millrace.operators.asof import asof_join
from millrace.operators.features import asof_features, current_features, current_store
from millrace.plans.common import Query, fractional, full_store, rounded, split_store
from millrace.plans.oracle_base import (
    FEATURE_SQL,
    INTEGER_FEATURES,
    asof_relations,
    current_relations,
    with_relations,
)
from millrace.schema import SPLIT_T, USER_TOTALS
from millrace.session import materialized, scratch
from millrace.sources import tables

QUERIES: dict[str, Query] = {}
ANSWERS: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ANSWERS[name] = sql
        return query

    return keep


CAST_FEATURES = ", ".join(
    n if n in INTEGER_FEATURES else f"round({n}, 6) AS {n}" for n in FEATURE_SQL
)


@register(
    "ingest_events",
    with_relations("""
SELECT * FROM ev WHERE business_id IN
  (SELECT business_id FROM rawb WHERE trim(city) = 'Philadelphia' AND trim(state) = 'PA')"""),
)
def ingest_events(spark, sf):
    return ingest.ingest_events(
        tables.raw_reviews(spark, sf), tables.raw_businesses(spark, sf), *tables.METRO
    )


@register(
    "build_dim",
    with_relations("""
SELECT business_id, name, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
       array_to_string(categories, '|') AS categories, price_tier, is_open
FROM dm WHERE trim(city) = 'Philadelphia' AND trim(state) = 'PA'"""),
)
def build_dim(spark, sf):
    dim = ingest.build_dim(tables.raw_businesses(spark, sf), *tables.METRO)
    return rounded(dim, ["latitude", "longitude"]).withColumn(
        "categories", F.array_join("categories", "|")
    )


@register(
    "parse_categories",
    with_relations("""
SELECT business_id, CAST(len(categories) AS INTEGER) AS n,
       array_to_string(categories, '|') AS categories FROM dm"""),
)
def parse_categories(spark, sf):
    parsed = ingest.parse_categories(F.col("categories"))
    return tables.raw_businesses(spark, sf).select(
        "business_id", F.size(parsed).alias("n"), F.array_join(parsed, "|").alias("categories")
    )


@register("parse_price_tier", with_relations("SELECT business_id, price_tier FROM dm"))
def parse_price_tier(spark, sf):
    return tables.raw_businesses(spark, sf).select(
        "business_id", ingest.parse_price_tier(F.col("attributes")).alias("price_tier")
    )


@register(
    "event_profile",
    with_relations("""
SELECT event_type, year, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts
FROM ev GROUP BY GROUPING SETS ((event_type, year), (event_type))"""),
)
def event_profile(spark, sf):
    return ingest.event_profile(tables.events(spark, sf))


@register(
    "dim_coverage",
    with_relations("""
SELECT round(avg((latitude IS NOT NULL)::INT), 6) AS with_location,
       round(avg((len(categories) > 0)::INT), 6) AS with_categories,
       round(avg((price_tier IS NOT NULL)::INT), 6) AS with_price,
       round(avg(is_open::INT), 6) AS open_share,
       round(avg(len(categories)), 6) AS mean_categories FROM dm"""),
)
def dim_coverage(spark, sf):
    out = ingest.dim_coverage(tables.dim(spark, sf))
    return rounded(out, out.columns)


@register(
    "price_distribution",
    with_relations("SELECT price_tier, count(*) AS businesses FROM dm GROUP BY price_tier"),
)
def price_distribution(spark, sf):
    return ingest.price_distribution(tables.dim(spark, sf))


@register(
    "top_categories",
    with_relations("""
SELECT category, count(*) AS businesses FROM dcat GROUP BY category
ORDER BY businesses DESC, category LIMIT 10"""),
)
def top_categories(spark, sf):
    return ingest.top_categories(tables.dim(spark, sf))


@register("popularity_rank", with_relations("SELECT * FROM ranked"))
def popularity_rank(spark, sf):
    return popularity.popularity_rank(
        tables.events(spark, sf), tables.dim(spark, sf), SPLIT_T
    )


@register(
    "popularity_pool",
    with_relations("SELECT business_id, n AS reviews, pool_rank FROM pool"),
)
def popularity_pool(spark, sf):
    return popularity.popularity_pool(tables.events(spark, sf), SPLIT_T)


@register("user_state", with_relations("SELECT * FROM ust"))
def user_state(spark, sf):
    return state.user_state(tables.events(spark, sf), tables.dim(spark, sf))


@register("item_state", with_relations("SELECT * FROM ist"))
def item_state(spark, sf):
    return state.item_state(tables.events(spark, sf))


@register("user_category_state", with_relations("SELECT * FROM cst"))
def user_category_state(spark, sf):
    return state.user_category_state(tables.events(spark, sf), tables.dim(spark, sf))


@register(
    "materialize_state",
    with_relations("""
SELECT 'user' AS state_group, count(*) AS rows FROM ust
UNION ALL SELECT 'item', count(*) FROM ist
UNION ALL SELECT 'user_category', count(*) FROM cst"""),
)
def materialize_state(spark, sf):
    events, dim = tables.events(spark, sf), tables.dim(spark, sf)
    states = {
        "user": state.user_state(events, dim),
        "item": state.item_state(events),
        "user_category": state.user_category_state(events, dim),
    }
    return state.write_states(states, scratch(spark, "state"))


@register(
    "timeline_example",
    with_relations("""
SELECT user_id, ts, cum_count, round(cum_sum / cum_count, 6) AS mean_stars,
       round(cum_lat_e7 / (10000000.0::DOUBLE * nullif(cum_geo_n, 0)), 6) AS mean_lat,
       round(cum_lng_e7 / (10000000.0::DOUBLE * nullif(cum_geo_n, 0)), 6) AS mean_lng
FROM ust WHERE user_id = (SELECT min(user_id) FROM
  (SELECT user_id FROM ust GROUP BY user_id HAVING count(*) BETWEEN 4 AND 6))"""),
)
def timeline_example(spark, sf):
    users = state.user_state(tables.events(spark, sf), tables.dim(spark, sf))
    return rounded(state.timeline_example(users), ["mean_stars", "mean_lat", "mean_lng"])


@register(
    "asof_join",
    with_relations("""
SELECT q.query_id, q.user_id, q.business_id, q.ts, u.ts AS state_ts,
       u.cum_count, u.cum_sum, u.cum_lat_e7, u.cum_lng_e7, u.cum_geo_n, u.cum_price, u.cum_price_n
FROM qs q ASOF LEFT JOIN ust u ON q.user_id = u.user_id AND q.ts > u.ts"""),
)
def as_of_join(spark, sf):
    users = state.user_state(tables.events(spark, sf), tables.dim(spark, sf))
    return asof_join(tables.review_queries(spark, sf), users, ["user_id"], list(USER_TOTALS))


@register(
    "asof_features",
    with_relations(f"SELECT query_id, {CAST_FEATURES} FROM feat", *asof_relations("qs")),
)
def as_of_features(spark, sf):
    queries = materialized(tables.review_queries(spark, sf), "queries")
    out = asof_features(queries, full_store(spark, sf))
    return rounded(out.select("query_id", *feature_names()), fractional())


@register(
    "get_asof",
    with_relations(
        "SELECT round(ui_distance_km, 6) AS value FROM feat",
        (
            "one",
            "SELECT 1 AS query_id, 'u1' AS user_id, 'b7' AS business_id, TIMESTAMP '1999-07-01' AS ts",
        ),
        *asof_relations("one"),
    ),
)
def get_as_of(spark, sf):
    from datetime import datetime

    from millrace.operators.features import get_asof, pair_store

    store = pair_store(
        tables.events(spark, sf),
        tables.dim(spark, sf),
        "u1",
        "b7",
        tables.user_vectors(spark, sf),
        tables.item_vectors(spark, sf),
    )
    out = get_asof(spark, store, "ui_distance_km", "u1", "b7", datetime(1999, 7, 1))
    return rounded(out, ["value"])


@register(
    "current_features",
    with_relations(
        f"SELECT user_id, business_id, {CAST_FEATURES} FROM feat",
        ("pairs", "SELECT DISTINCT user_id, business_id FROM ev"),
        *current_relations("pairs"),
    ),
)
def current_feature_read(spark, sf):
    pairs = (
        tables.events(spark, sf)
        .select("user_id", "business_id")
        .distinct()
        .withColumn("query_id", F.concat_ws("|", "user_id", "business_id"))
    )
    out = current_features(pairs, split_store(spark, sf), SPLIT_T)
    return rounded(out.select("user_id", "business_id", *feature_names()), fractional())


@register(
    "current_state",
    with_relations("""
SELECT 'user' AS state_group, user_id AS entity, '' AS part, ts, cum_count AS n FROM
  (SELECT * FROM ust QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1)
UNION ALL SELECT 'item', business_id, '', ts, cum_count FROM
  (SELECT * FROM ist QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY ts DESC) = 1)
UNION ALL SELECT 'user_category', user_id, category, ts, cum_count FROM
  (SELECT * FROM cst QUALIFY row_number() OVER (PARTITION BY user_id, category ORDER BY ts DESC) = 1)
UNION ALL SELECT 'user_als', user_id, '', ts, len(value) FROM
  (SELECT * FROM uv QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1)
UNION ALL SELECT 'item_als', business_id, '', ts, len(value) FROM
  (SELECT * FROM iv QUALIFY row_number() OVER (PARTITION BY business_id ORDER BY ts DESC) = 1)"""),
)
def current_state(spark, sf):
    now = current_store(full_store(spark, sf))

    def part(group, frame, entity, extra, n):
        return frame.select(
            F.lit(group).alias("state_group"),
            F.col(entity).alias("entity"),
            extra.alias("part"),
            "ts",
            n.cast("bigint").alias("n"),
        )

    none = F.lit("")
    parts = [
        part("user", now.user, "user_id", none, F.col("cum_count")),
        part("item", now.item, "business_id", none, F.col("cum_count")),
        part("user_category", now.user_category, "user_id", F.col("category"), F.col("cum_count")),
        part("user_als", now.user_als, "user_id", none, F.size("value")),
        part("item_als", now.item_als, "business_id", none, F.size("value")),
    ]
    return reduce(DataFrame.unionByName, parts)


@register("reviewed_history", with_relations("SELECT user_id, business_id FROM reviewed"))
def reviewed_history(spark, sf):
    return snapshot.reviewed_history(tables.events(spark, sf), SPLIT_T)


@register(
    "publish_snapshot",
    with_relations(
        """
SELECT 'query-run' AS generation, 7 AS schema_version, max_ts AS source_max_ts,
       max_ts + INTERVAL 1 MICROSECOND AS as_of,
       (SELECT count(DISTINCT user_id) FROM ust) AS users,
       (SELECT count(DISTINCT business_id) FROM ist) AS items,
       (SELECT count(*) FROM (SELECT DISTINCT user_id, category FROM cst)) AS user_categories,
       (SELECT count(*) FROM dm) AS businesses,
       (SELECT count(DISTINCT user_id) FROM uv) AS user_als,
       (SELECT count(DISTINCT business_id) FROM iv) AS item_als,
       (SELECT count(DISTINCT user_id) FROM ev) AS user_reviewed,
       (SELECT count(*) FROM ue) AS user_embeddings
FROM (SELECT max(ts) AS max_ts FROM ev)"""
    ),
)
def publish_snapshot(spark, sf):
    root = scratch(spark, "online")
    snapshot.publish(
        root,
        full_store(spark, sf),
        tables.events(spark, sf),
        user_embedding=tables.user_embedding(spark, sf),
        generation="query-run",
    )
    return snapshot.manifest(spark, root).drop("definitions", "embeddings")


@register(
    "embedding_lookup",
    with_relations("""
SELECT 'u' || c_custkey AS user_id, value IS NOT NULL AS known, len(value)::INTEGER AS width,
       round(list_dot_product(value, value), 6) AS squared_norm
FROM customer LEFT JOIN ue ON ue.user_id = 'u' || c_custkey"""),
)
def embedding_lookup(spark, sf):
    from millrace.functions.expressions import dot

    found = snapshot.embedding_lookup(
        tables.users(spark, sf),
        tables.user_embedding(spark, sf),
        "user_embedding_behavioral_v1",
    )
    norm = dot(F.col("value"), F.col("value"))
    return found.select(
        "user_id",
        F.col("value").isNotNull().alias("known"),
        F.when(F.col("value").isNotNull(), F.size("value")).alias("width"),
        F.round(norm, 6).alias("squared_norm"),
    )


DAMAGED_ITEM = "b7"
_SAME = " AND ".join(
    f"(a.{n} IS NOT DISTINCT FROM b.{n} OR coalesce(abs(a.{n} - b.{n}) <= greatest(1e-12, 1e-12 * greatest(abs(a.{n}), abs(b.{n}))), false))"
    for n in FEATURE_SQL
)
_WRONG = " + ".join(f"(NOT {same})::BIGINT" for same in _SAME.split(" AND "))


@register(
    "skew_check",
    with_relations(
        f"""
SELECT generation, n AS sampled_pairs, 9 * n + components AS compared_values, mismatches, embedding_mismatches,
       generation <> 'stale' AS same_instant, generation = 'fresh' AS passed
FROM (SELECT count(*) AS n FROM pairs),
     (SELECT CAST(sum(len(value)) AS BIGINT) AS components FROM ue WHERE user_id IN (SELECT user_id FROM pairs)),
     (SELECT 'fresh' AS generation, 0::BIGINT AS mismatches, 0::BIGINT AS embedding_mismatches
      UNION ALL SELECT 'damaged', count(*), 1 FROM pairs WHERE business_id = '{DAMAGED_ITEM}'
      UNION ALL SELECT 'stale', CAST(sum({_WRONG}) AS BIGINT), 0
      FROM feat_now a JOIN feat_then b ON a.user_id = b.user_id AND a.business_id = b.business_id)""",
        ("pairs", "SELECT DISTINCT user_id, business_id FROM ev"),
        *current_relations("pairs", "(SELECT max(ts) + INTERVAL 1 MICROSECOND FROM ev)", "_now"),
        *current_relations("pairs", "(SELECT max(ts) + INTERVAL 1 MICROSECOND FROM pre)", "_then"),
    ),
)
def skew_check(spark, sf):
    """What three publications serve against the historical store: one as it should be, one with
    a changed item total and a changed vector component, one of the state at the split."""
    root = scratch(spark, "online")
    full, events = full_store(spark, sf), tables.events(spark, sf)
    vectors = materialized(tables.user_embedding(spark, sf), "vectors")
    pairs = materialized(events.select("user_id", "business_id").distinct(), "pairs")
    hit = F.when(F.col("business_id") == DAMAGED_ITEM, 1).otherwise(0)
    damaged = replace(full, item=full.item.withColumn("cum_sum", F.col("cum_sum") + hit))
    victim = vectors.join(pairs, "user_id", "left_semi").agg(F.min("user_id")).scalar()
    changed = F.transform(
        "value",
        lambda x, i: F.when((F.col("user_id") == F.col("_victim")) & (i == 3), x + 1).otherwise(x).cast("float"),
    )
    spoiled = vectors.withColumn("_victim", victim).select("user_id", changed.alias("value"))
    # A generation published from the reviews before the split.
    stale = (split_store(spark, sf), popularity.before(events, SPLIT_T))
    for name, (store, known, embedding) in {
        "fresh": (full, events, vectors),
        "damaged": (damaged, events, spoiled),
        "stale": (*stale, vectors),
    }.items():
        snapshot.publish(root, store, known, user_embedding=embedding, generation=name)
    reports = [
        snapshot.check_skew(spark, root, pairs, full, vectors, generation=name)
        for name in ("fresh", "damaged", "stale")
    ]
    return reduce(DataFrame.unionByName, reports)


@register(
    "vector_integrity",
    with_relations("""
SELECT 'user_als' AS state_group, count(*) AS vectors, count(*) - count(value) AS null_vectors,
       count(*) FILTER (WHERE len(list_filter(value, lambda x: x IS NULL)) > 0) AS with_null_element,
       count(DISTINCT len(value)) AS widths FROM uv
UNION ALL
SELECT 'item_als', count(*), count(*) - count(value),
       count(*) FILTER (WHERE len(list_filter(value, lambda x: x IS NULL)) > 0),
       count(DISTINCT len(value)) FROM iv"""),
)
def vector_integrity(spark, sf):
    return snapshot.vector_integrity(
        {"user_als": tables.user_vectors(spark, sf), "item_als": tables.item_vectors(spark, sf)}
    )


@register(
    "hash_sample",
    with_relations("""
SELECT p AS position, user_id FROM (SELECT unnest(range(2000)) AS p)
JOIN (SELECT user_id, row_number() OVER (ORDER BY sha256(user_id), user_id) - 1 AS i,
             count(*) OVER () AS m
      FROM (SELECT DISTINCT user_id FROM ust ORDER BY sha256(user_id), user_id LIMIT 2000))
ON p % m = i"""),
)
def hash_sample(spark, sf):
    users = tables.events(spark, sf).select("user_id").distinct()
    return snapshot.hash_sample(users, "user_id", 2000)


@register(
    "future_invariance_audit",
    with_relations("""
SELECT 'strict' AS variant, count(*) AS queries, 0::BIGINT AS changed FROM qs WHERE ts < TIMESTAMP '2000-01-01'
UNION ALL
SELECT 'leaky', count(*), count(*) FILTER (WHERE cum_count IS DISTINCT FROM total)
FROM (SELECT * FROM qs WHERE ts < TIMESTAMP '2000-01-01') q
LEFT JOIN (SELECT user_id, max(cum_count) AS total FROM ust GROUP BY user_id) f USING (user_id)
LEFT JOIN (SELECT user_id, cum_count FROM cur_u) c USING (user_id)"""),
)
def future_invariance_audit(spark, sf):
    return audit.future_invariance(
        tables.review_queries(spark, sf),
        tables.events(spark, sf),
        tables.dim(spark, sf),
        tables.user_vectors(spark, sf),
        tables.item_vectors(spark, sf),
        SPLIT_T,
    )
