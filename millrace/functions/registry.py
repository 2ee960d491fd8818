"""The feature registry: one definition per feature, read by every path.

A definition is metadata plus a Column over the attached state columns:

    ts                   the query's instant
    u_ts, u_cum_*        the user's state row
    i_ts, i_cum_*        the item's state row
    c_matched            the user's counts summed over the item's categories
    b_*                  the item's static attributes
    v_score              inner product of the two vector slices

Columns of an entity without history are NULL, so every expression must survive NULL.
Definitions hold builders, not Columns: a Column needs a running session.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.expressions import great_circle_km
from millrace.schema import GEO_SCALE, VECTOR_WIDTH


@dataclass(frozen=True)
class Feature:
    name: str
    entity: str
    dtype: str
    version: int
    reads: tuple[str, ...]
    build: Callable[[], Column]
    leakage: str  # why the value cannot contain the future


@dataclass(frozen=True)
class Embedding:
    name: str
    entity: str
    width: int
    version: int
    leakage: str


def _ratio(top: str, bottom: str) -> Column:
    return F.col(top) / F.nullif(F.col(bottom), F.lit(0))


def _centroid(axis: str) -> Column:
    # The mean of whole numbers first: the rounding of the SQL answers.
    return _ratio(f"u_cum_{axis}_e7", "u_cum_geo_n") / F.lit(float(GEO_SCALE))


_FEATURES = (
    Feature(
        "u_reviews_to_date",
        "user",
        "bigint",
        1,
        ("user",),
        lambda: F.coalesce(F.col("u_cum_count"), F.lit(0)),
        "the state row lies strictly before the query instant",
    ),
    Feature(
        "u_mean_stars_to_date",
        "user",
        "double",
        1,
        ("user",),
        lambda: _ratio("u_cum_sum", "u_cum_count"),
        "sum and count come from one earlier state row",
    ),
    Feature(
        "u_days_since_last",
        "user",
        "bigint",
        1,
        ("user",),
        # Calendar-day boundaries crossed, not elapsed 24-hour periods.
        lambda: F.datediff(F.col("ts"), F.col("u_ts")).cast("bigint"),
        "counts back from the query to an earlier event",
    ),
    Feature(
        "i_reviews_to_date",
        "item",
        "bigint",
        1,
        ("item",),
        lambda: F.coalesce(F.col("i_cum_count"), F.lit(0)),
        "the item's state row lies strictly before the query, so the labelled review is out",
    ),
    Feature(
        "i_mean_stars_to_date",
        "item",
        "double",
        1,
        ("item",),
        lambda: _ratio("i_cum_sum", "i_cum_count"),
        "the mean spans only reviews earlier than the one being predicted",
    ),
    Feature(
        "ui_distance_km",
        "user x item",
        "double",
        1,
        ("user", "business"),
        lambda: great_circle_km(
            _centroid("lat"), _centroid("lng"), F.col("b_latitude"), F.col("b_longitude")
        ),
        "centroid of earlier events; an item's place does not change with reviews",
    ),
    Feature(
        "ui_category_affinity",
        "user x item",
        "double",
        1,
        ("user", "user_category", "business"),
        lambda: F.col("c_matched")
        / F.nullif(F.coalesce(F.col("u_cum_count"), F.lit(0)), F.lit(0)),
        "both counts are earlier state; categories are set when an item is listed",
    ),
    Feature(
        "ui_als_score",
        "user x item",
        "double",
        1,
        ("user_als", "item_als"),
        lambda: F.col("v_score"),
        "each vector slice was fitted on events before its boundary, itself before the query",
    ),
    Feature(
        "ui_price_delta",
        "user x item",
        "double",
        1,
        ("user", "business"),
        lambda: F.abs(F.col("b_price_tier") - _ratio("u_cum_price", "u_cum_price_n")),
        "mean tier of earlier events against a quasi-static attribute",
    ),
)

# Insertion order is the order of the ranker's inputs.
FEATURES = {f.name: f for f in _FEATURES}

_BEHAVIORAL = "fitted on events strictly before the split"
_TOWER = "labels and user inputs lie strictly before the split; item inputs are static"
EMBEDDINGS = {
    e.name: e
    for e in (
        Embedding("user_embedding_behavioral_v1", "user", VECTOR_WIDTH, 1, _BEHAVIORAL),
        Embedding("item_embedding_behavioral_v1", "item", VECTOR_WIDTH, 1, _BEHAVIORAL),
        Embedding("user_embedding_two_tower_v1", "user", VECTOR_WIDTH, 1, _TOWER),
        Embedding("item_embedding_two_tower_v1", "item", VECTOR_WIDTH, 1, _TOWER),
    )
}

STATE_GROUPS = ("user", "item", "user_category", "business", "user_als", "item_als")
PUBLISHED_GROUPS = STATE_GROUPS


def feature_names() -> tuple[str, ...]:
    return tuple(FEATURES)


def get(name: str) -> Feature:
    if name not in FEATURES:
        raise KeyError(f"no feature {name!r}; registered: {', '.join(FEATURES)}")
    return FEATURES[name]


def get_embedding(name: str) -> Embedding:
    if name not in EMBEDDINGS:
        raise KeyError(f"no embedding {name!r}; registered: {', '.join(EMBEDDINGS)}")
    return EMBEDDINGS[name]


def online_features() -> tuple[str, ...]:
    """Features whose every input is published, derived from the registry."""
    return tuple(n for n, f in FEATURES.items() if set(f.reads) <= set(PUBLISHED_GROUPS))


def resolve(names: Sequence[str] | None) -> list[Feature]:
    """Definitions by name; an unknown name fails before any plan is built."""
    return [get(n) for n in (feature_names() if names is None else names)]


def required_groups(names: Sequence[str] | None = None) -> set[str]:
    return {group for feature in resolve(names) for group in feature.reads}
