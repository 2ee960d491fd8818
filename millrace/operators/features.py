"""Feature reads: the same definitions over historical or current state.

Only the state groups that the requested features read are joined. Joins on the same
key follow each other, so their exchanges are shared.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import registry
from millrace.functions.expressions import dot, within_size
from millrace.operators import state as st
from millrace.operators.asof import asof_sweep, latest_state
from millrace.operators.popularity import before, instant
from millrace.schema import ITEM_TOTALS, USER_TOTALS, VECTOR_WIDTH
from millrace.session import growing

_VALUES = {
    "user": (["user_id"], USER_TOTALS, "u"),
    "item": (["business_id"], ITEM_TOTALS, "i"),
    "user_category": (["user_id", "category"], ("cum_count",), "c"),
    "user_als": (["user_id"], ("value",), "uv"),
    "item_als": (["business_id"], ("value",), "iv"),
}


@dataclass(frozen=True)
class Store:
    """State timelines (or their last rows) plus the dimension."""

    user: DataFrame | None = None
    item: DataFrame | None = None
    user_category: DataFrame | None = None
    dim: DataFrame | None = None
    user_als: DataFrame | None = None
    item_als: DataFrame | None = None
    vector_width: int = VECTOR_WIDTH

    def group(self, name: str) -> DataFrame:
        found = self.dim if name == "business" else getattr(self, name)
        if found is None:
            raise ValueError(f"the store holds no {name!r} state")
        return found


def build_store(
    events: DataFrame,
    dim: DataFrame,
    user_als: DataFrame | None = None,
    item_als: DataFrame | None = None,
) -> Store:
    return Store(
        user=st.user_state(events, dim),
        item=st.item_state(events),
        user_category=st.user_category_state(events, dim),
        dim=dim,
        user_als=user_als,
        item_als=item_als,
    )


def current_store(store: Store, at: datetime | None = None) -> Store:
    """The last row per entity of every timeline, strictly before `at` when given."""

    def last(name: str) -> DataFrame | None:
        timeline = getattr(store, name)
        return None if timeline is None else latest_state(timeline, _VALUES[name][0], at)

    return Store(
        user=last("user"),
        item=last("item"),
        user_category=last("user_category"),
        dim=store.dim,
        user_als=last("user_als"),
        item_als=last("item_als"),
        vector_width=store.vector_width,
    )


def store_before(
    events: DataFrame,
    dim: DataFrame,
    at: datetime,
    user_als: DataFrame | None = None,
    item_als: DataFrame | None = None,
) -> Store:
    """Current state as of one instant, straight from the events.

    With a single instant the last row of a running total is a plain total, so no
    timeline is built: one partially aggregated group-by per entity.
    """
    past = before(events, at)
    return Store(
        user=st.user_totals(past, dim),
        item=st.item_totals(past),
        user_category=st.user_category_totals(past, dim),
        dim=dim,
        user_als=None if user_als is None else latest_state(user_als, ["user_id"], at),
        item_als=None if item_als is None else latest_state(item_als, ["business_id"], at),
    )


def _prefixed(found: DataFrame, keys: Sequence[str], stamp: str, group: str) -> DataFrame:
    _, values, prefix = _VALUES[group]
    return found.select(
        *keys,
        F.col(stamp).alias(f"{prefix}_ts"),
        *[F.col(v).alias(f"{prefix}_{v}") for v in values],
    )


def _scored(attached: DataFrame, width: int) -> DataFrame:
    """Replace the two vectors by their inner product; NULL if either is absent."""
    score = dot(F.col("uv_value"), F.col("iv_value"), width)
    return attached.withColumn("v_score", score).drop("uv_value", "iv_value")


def _static(dim: DataFrame, *extra: Column) -> DataFrame:
    return dim.select(
        "business_id",
        F.col("latitude").alias("b_latitude"),
        F.col("longitude").alias("b_longitude"),
        F.col("price_tier").alias("b_price_tier"),
        *extra,
    )


def _needs_vectors(groups: set[str]) -> bool:
    return bool(groups & {"user_als", "item_als"})


def _spread(found: DataFrame, columns: Sequence[str], groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """The groups' structs as prefixed columns."""
    out = list(columns)
    for group, values in groups.items():
        prefix = _VALUES[group][2] if group in _VALUES else "b"
        out += [F.col(f"{group}.{v}").alias(f"{prefix}_{v}") for v in values]
    return found.select(*out)


def _attach_asof(queries: DataFrame, store: Store, groups: set[str]) -> DataFrame:
    """State strictly before each query's own instant: one sweep by item, then one by user.

    What never changes of an item is its state since the beginning of time. Categories are swept
    by (user, category), narrow rows that return as one number for each query. Of a vector only
    the instant is swept; the vectors themselves meet in joins afterwards.
    """

    def sweep(asked: DataFrame, key: str, wanted: Mapping[str, tuple[DataFrame, list[str]]]) -> DataFrame:
        wanted = {g: held for g, held in wanted.items() if held is not None}
        if not wanted:
            return asked
        found = asof_sweep(asked, [key], {g: f.select(key, "ts", *values) for g, (f, values) in wanted.items()})
        return _spread(
            found,
            asked.columns,
            {g: (v if g == "business" else ["ts", *v]) for g, (_, v) in wanted.items()},
        )

    def held(group: str, needed: bool):
        values = [] if group.endswith("_als") else list(_VALUES[group][1])
        return (store.group(group), values) if needed else None

    static = None
    if "business" in groups:
        always = F.lit("0001-01-01 00:00:00").cast("timestamp_ntz").alias("ts")
        values = ["latitude", "longitude", "price_tier", *(["categories"] if "user_category" in groups else [])]
        static = (store.group("business").select("*", always), values)
    vectors = _needs_vectors(groups)
    by_user = {"user": held("user", "user" in groups), "user_als": held("user_als", vectors)}
    out = sweep(
        queries,
        "business_id",
        {"business": static, "item": held("item", "item" in groups), "item_als": held("item_als", vectors)},
    )
    if "user_category" in groups:
        asks = out.select("query_id", "user_id", "ts", F.explode("b_categories").alias("category"))
        state = store.group("user_category").select("user_id", "category", "ts", "cum_count")
        matched = (
            asof_sweep(asks, ["user_id", "category"], {"seen": state})
            .groupBy("query_id")
            .agg(F.sum(F.coalesce("seen.cum_count", F.lit(0))).alias("c_matched"))
        )
        out = out.drop("b_categories").join(growing(matched), "query_id", "left")
    out = sweep(out, "user_id", by_user)
    if not vectors:
        return out
    for group in ("user_als", "item_als"):
        (key,), _, prefix = _VALUES[group]
        state = store.group(group).select(key, F.col("ts").alias(f"{prefix}_ts"), F.col("value").alias(f"{prefix}_value"))
        out = out.join(growing(state), [key, f"{prefix}_ts"], "left")
    return _scored(out, store.vector_width)


def item_side(df: DataFrame, store: Store, groups: set[str]) -> DataFrame:
    """df plus everything the item side contributes at the current instant.

    All joins share the key, so a df that has to be shuffled is shuffled once.
    """
    if "business" in groups:
        static = _static(store.group("business"))
        if "user_category" in groups:
            listed = F.col("categories").alias("b_categories")
            static = _static(store.group("business"), listed)
        df = df.join(growing(static), "business_id", "left")
    for group in ("item", "item_als"):
        if group in groups or (group == "item_als" and _needs_vectors(groups)):
            found = _prefixed(store.group(group), ["business_id"], "ts", group)
            df = df.join(growing(found), "business_id", "left")
    return df.drop("iv_ts")


def user_side(df: DataFrame, store: Store, groups: set[str]) -> DataFrame:
    """df plus the user side: totals, vector and taste (category -> count).

    The taste map has one entry per category the user has touched, so it is bounded by
    the catalog's category vocabulary, however many events the user has.
    """
    for group in ("user", "user_als"):
        if group in groups or (group == "user_als" and _needs_vectors(groups)):
            found = _prefixed(store.group(group), ["user_id"], "ts", group)
            df = df.join(growing(found), "user_id", "left")
    if "user_category" in groups:
        entries = F.collect_list(F.struct("category", "cum_count"))
        taste = store.group("user_category").groupBy("user_id").agg(
            F.map_from_entries(entries).alias("c_counts")
        )
        df = df.join(growing(taste), "user_id", "left")
    return df.drop("uv_ts")


def _matched(groups: set[str], attached: DataFrame, store: Store) -> DataFrame:
    if _needs_vectors(groups):
        attached = _scored(attached, store.vector_width)
    if "user_category" in groups:
        total = F.aggregate(
            "b_categories",
            F.lit(0).cast("bigint"),
            lambda n, c: n + F.coalesce(F.try_element_at("c_counts", c), F.lit(0)),
        )
        attached = attached.withColumn("c_matched", F.when(F.size("b_categories") > 0, total))
    return attached


def project_features(attached: DataFrame, keep: Sequence[str | Column], names: Sequence[str] | None) -> DataFrame:
    return attached.select(
        *keep, *[f.build().alias(f.name) for f in registry.resolve(names)]
    )


def asof_features(
    queries: DataFrame,
    store: Store,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """queries (query_id, user_id, business_id, ts, ...) plus features as of each ts."""
    groups = registry.required_groups(names)
    return project_features(_attach_asof(queries, store, groups), queries.columns, names)


def current_features(
    queries: DataFrame,
    store: Store,
    as_of: Column | datetime,
    names: Sequence[str] | None = None,
) -> DataFrame:
    """queries (user_id, business_id, ...) plus the same features over current state, at
    one shared instant. Identity joins only: first by item, then by user."""
    names = registry.online_features() if names is None else names
    groups = registry.required_groups(names)
    out = queries.withColumn("ts", _instant(as_of))
    keep = out.columns
    out = user_side(item_side(out, store, groups), store, groups)
    return project_features(_matched(groups, out, store), keep, names)


def shared_list_features(
    users: DataFrame,
    short_list: DataFrame,
    size: int,
    position: str,
    store: Store,
    as_of: Column | datetime,
    names: Sequence[str] | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """(user_id, carried user columns, short_list columns, ts, features) of every user against one
    short list.

    The item side is joined to the list (at most `size` rows, a setting; a position beyond
    it raises) and the user side to the users, before the two meet. Slots 1..size then match list positions by a
    broadcast equi-join, so candidates are produced where the user already is: no
    candidate row is shuffled to obtain its features.
    """
    names = registry.online_features() if names is None else names
    groups = registry.required_groups(names)
    listed = item_side(short_list, store, groups)
    asked = user_side(users.select("user_id", *carry), store, groups)
    # Few, small user rows grow `size`-fold here, so they are spread by number, which
    # adaptive execution leaves alone; the later per-user ordering reuses the layout.
    width = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.repartition(width, "user_id")
    slots = asked.withColumn(position, F.explode(F.sequence(F.lit(1), F.lit(size))))
    bounded = F.broadcast(within_size(listed, size, position))
    out = slots.join(bounded, position).withColumn("ts", _instant(as_of))
    keep = ["user_id", *carry, *short_list.columns, "ts"]
    return project_features(_matched(groups, out, store), keep, names)


def _instant(as_of: Column | datetime) -> Column:
    return instant(as_of) if isinstance(as_of, datetime) else as_of


def get_asof(
    spark: SparkSession,
    store: Store,
    name: str,
    user_id: str,
    business_id: str,
    ts: datetime,
) -> DataFrame:
    """One value for one (user, item, instant), through the bulk path over their own state."""
    query = spark.range(1).select(
        F.lit(1).cast("bigint").alias("query_id"),
        F.lit(user_id).alias("user_id"),
        F.lit(business_id).alias("business_id"),
        instant(ts).alias("ts"),
    )
    return asof_features(query, store_of(store, user_id, business_id), [name]).select(F.col(name).alias("value"))


def store_of(store: Store, user_id: str, business_id: str) -> Store:
    """The part of a store that one (user, item) pair reads. Over a written store the bounds reach
    the scan; over timelines that are still to be built they reach the events."""
    ids = {"user_id": user_id, "business_id": business_id}

    def part(frame: DataFrame | None) -> DataFrame | None:
        if frame is None:
            return None
        key = "user_id" if "user_id" in frame.columns else "business_id"
        return frame.filter(F.col(key) == ids[key])

    groups = ("user", "item", "user_category", "dim", "user_als", "item_als")
    return replace(store, **{g: part(getattr(store, g)) for g in groups})


def pair_store(
    events: DataFrame,
    dim: DataFrame,
    user_id: str,
    business_id: str,
    user_als: DataFrame | None = None,
    item_als: DataFrame | None = None,
) -> Store:
    """The state of one (user, item) pair, built from the events of either alone."""
    own = events.filter(F.col("user_id") == user_id)
    whole = Store(
        user=st.user_state(own, dim),
        item=st.item_state(events.filter(F.col("business_id") == business_id)),
        user_category=st.user_category_state(own, dim),
        dim=dim,
        user_als=user_als,
        item_als=item_als,
    )
    return store_of(whole, user_id, business_id)
