"""Shared relations of the SQL answers: the inputs, written independently in SQL.

An answer gets the relations that it names, and those that they name, as CTEs in this order.
Relations that several parts of an answer read are marked for one evaluation.
"""

from __future__ import annotations

import re

USER_TOTALS = """count(h.user_id)::BIGINT AS cum_count, sum(h.stars)::BIGINT AS cum_sum,
       sum(h.lat_e7)::BIGINT AS cum_lat_e7, sum(h.lng_e7)::BIGINT AS cum_lng_e7,
       count(h.lat_e7)::BIGINT AS cum_geo_n, sum(h.price_tier)::BIGINT AS cum_price,
       count(h.price_tier)::BIGINT AS cum_price_n"""
# What the earlier reviews of a user say of that user, and of an item of that item.
USER_PAST = """count(h.user_id) AS n, max(h.ts) AS last_ts, avg(h.stars) AS stars, avg(h.price_tier) AS tier,
       avg(h.lat_e7) / 10000000.0::DOUBLE AS lat, avg(h.lng_e7) / 10000000.0::DOUBLE AS lng"""
ITEM_PAST = "count(h.business_id) AS n, avg(h.stars) AS stars"
ITEM_TOTALS = "count(h.business_id)::BIGINT AS cum_count, sum(h.stars)::BIGINT AS cum_sum"

RELATIONS: dict[str, str] = {
    "ev": """
SELECT 'u' || o_custkey AS user_id, 'b' || l_partkey AS business_id, 'review' AS event_type,
       o_orderdate AS ts, CAST(1 + floor((l_quantity - 1) / 10) AS SMALLINT) AS stars,
       CAST(year(o_orderdate) AS INTEGER) AS year
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "rawb": """
SELECT 'b' || p_partkey AS business_id, p_name AS name,
       CASE WHEN p_brand = 'Brand#13' THEN 'Pittsburgh' ELSE ' Philadelphia ' END AS city,
       'PA ' AS state, 39.8::DOUBLE + (p_partkey % 97) * 0.004::DOUBLE AS latitude,
       -75.3::DOUBLE + (p_partkey % 89) * 0.004::DOUBLE AS longitude,
       CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE 1 END AS is_open,
       CASE WHEN p_size < 50 THEN p_type || ' , ' || p_brand || ',, '
            || replace(p_name, ' ', ', ') END AS categories,
       CASE p_size % 10
            WHEN 0 THEN '{"RestaurantsPriceRange2": null}'
            WHEN 1 THEN '{"RestaurantsPriceRange2": "None"}'
            WHEN 2 THEN '{"RestaurantsPriceRange2": "9"}'
            WHEN 3 THEN NULL
            ELSE '{"WiFi": "free", "RestaurantsPriceRange2": "' || (1 + p_size % 4) || '"}'
       END AS attributes
FROM part""",
    "dm": """
SELECT business_id, name, latitude, longitude,
       coalesce(list_filter(list_transform(string_split(categories, ','), lambda x: trim(x)),
                            lambda x: x <> ''), []) AS categories,
       CASE WHEN TRY_CAST(json_extract_string(attributes, '$.RestaurantsPriceRange2') AS SMALLINT)
                 BETWEEN 1 AND 4
            THEN TRY_CAST(json_extract_string(attributes, '$.RestaurantsPriceRange2') AS SMALLINT)
       END AS price_tier,
       is_open = 1 AS is_open, city, state
FROM rawb""",
    "dcat": "SELECT business_id, unnest(categories) AS category FROM dm",
    # A review with what its place adds to the reviewer's totals.
    "hist": """
SELECT e.user_id, e.business_id, e.ts, e.stars, d.price_tier,
       CAST(round(d.latitude * 10000000) AS BIGINT) AS lat_e7,
       CAST(round(d.longitude * 10000000) AS BIGINT) AS lng_e7
FROM ev e LEFT JOIN dm d ON d.business_id = e.business_id""",
    "liked": "SELECT h.user_id, h.ts, x.category FROM ev h JOIN dcat x ON x.business_id = h.business_id",
    # Timelines: the totals of everything up to each instant at which the entity had a review.
    "ust": f"""
SELECT m.user_id, m.ts, {USER_TOTALS}
FROM (SELECT DISTINCT user_id, ts FROM hist) m
JOIN hist h ON h.user_id = m.user_id AND h.ts <= m.ts
GROUP BY m.user_id, m.ts""",
    "ist": f"""
SELECT m.business_id, m.ts, {ITEM_TOTALS}
FROM (SELECT DISTINCT business_id, ts FROM hist) m
JOIN hist h ON h.business_id = m.business_id AND h.ts <= m.ts
GROUP BY m.business_id, m.ts""",
    "cst": """
SELECT m.user_id, m.category, m.ts, count(*)::BIGINT AS cum_count
FROM (SELECT DISTINCT user_id, category, ts FROM liked) m
JOIN liked h ON h.user_id = m.user_id AND h.category = m.category AND h.ts <= m.ts
GROUP BY m.user_id, m.category, m.ts""",
    "years": "SELECT unnest([1996, 1997, 1998, 1999, 2000, 2001])::BIGINT AS y",
    "uv": """
SELECT 'u' || c_custkey AS user_id, make_timestamp(y, 1, 1, 0, 0, 0) AS ts,
       embedding::DOUBLE[] AS value
FROM customer CROSS JOIN years
JOIN embeddings ON vec_id = (c_custkey * 7 + y) % (SELECT count(*) FROM embeddings)
WHERE c_mktsegment <> 'BUILDING'""",
    "iv": """
SELECT 'b' || p_partkey AS business_id, make_timestamp(y, 1, 1, 0, 0, 0) AS ts,
       embedding::DOUBLE[] AS value
FROM part CROSS JOIN years
JOIN embeddings ON vec_id = (p_partkey * 11 + y * 3) % (SELECT count(*) FROM embeddings)""",
    "ue": "SELECT user_id, value FROM uv WHERE ts = TIMESTAMP '2000-01-01'",
    "ie": "SELECT business_id, value FROM iv WHERE ts = TIMESTAMP '2000-01-01'",
    "qs": """
SELECT user_id, business_id, ts,
       user_id || '|' || business_id || '|' || strftime(ts, '%Y%m%d') AS query_id
FROM (SELECT DISTINCT user_id, business_id, ts FROM ev)""",
    "pre": "SELECT * FROM ev WHERE ts < TIMESTAMP '2000-01-01'",
    "counted": """
SELECT d.business_id, d.name, count(p.user_id) AS n
FROM dm d LEFT JOIN pre p USING (business_id) GROUP BY ALL""",
    "ranked": """
SELECT business_id, name, n AS pre_t_reviews,
       row_number() OVER (ORDER BY n DESC, business_id) AS rank
FROM counted""",
    # Fixed value: the pool holds 500 places. A place's rank is one more than the number of places
    # with more reviews, or as many and a smaller id.
    "visited": "SELECT business_id, count(*) AS n FROM pre GROUP BY business_id",
    "pool": """
SELECT a.business_id, a.n, count(b.business_id) + 1 AS pool_rank
FROM visited a LEFT JOIN visited b ON b.n > a.n OR (b.n = a.n AND b.business_id < a.business_id)
GROUP BY a.business_id, a.n HAVING count(b.business_id) < 500""",
    "truth": """
SELECT DISTINCT user_id, business_id FROM ev
WHERE ts >= TIMESTAMP '2000-01-01' AND user_id IN (SELECT user_id FROM pre)""",
    "n_rel": "SELECT user_id, count(*) AS n_rel FROM truth GROUP BY user_id",
    "reviewed": "SELECT DISTINCT user_id, business_id FROM pre",
    # What was known of each entity at the split: totals of its earlier reviews, latest vector.
    "cur_u": f"""
SELECT user_id, max(ts) AS ts, {USER_TOTALS}
FROM hist h WHERE ts < TIMESTAMP '2000-01-01' GROUP BY user_id""",
    "cur_i": f"""
SELECT business_id, max(ts) AS ts, {ITEM_TOTALS}
FROM hist h WHERE ts < TIMESTAMP '2000-01-01' GROUP BY business_id""",
    "cur_c": """
SELECT user_id, category, max(ts) AS ts, count(*)::BIGINT AS cum_count
FROM liked WHERE ts < TIMESTAMP '2000-01-01' GROUP BY user_id, category""",
    "cur_uv": """
SELECT user_id, max(ts) AS ts, max_by(value, ts) AS value
FROM uv WHERE ts < TIMESTAMP '2000-01-01' GROUP BY user_id""",
    "cur_iv": """
SELECT business_id, max(ts) AS ts, max_by(value, ts) AS value
FROM iv WHERE ts < TIMESTAMP '2000-01-01' GROUP BY business_id""",
}

def _chord_km(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    """Distance on the sphere from the straight line between two points of the unit sphere."""

    def point(lat: str, lng: str) -> list[str]:
        lat, lng = f"radians({lat})", f"radians({lng})"
        return [f"cos({lat}) * cos({lng})", f"cos({lat}) * sin({lng})", f"sin({lat})"]

    gaps = [f"power({x} - {y}, 2)" for x, y in zip(point(lat1, lng1), point(lat2, lng2), strict=True)]
    # Fixed value: a sphere of 6371 km.
    return f"2 * 6371.0::DOUBLE * asin(sqrt({' + '.join(gaps)}) / 2)"


#: u, i: the user's and the item's past; b: the item; c, v: shared categories and vector product.
FEATURE_SQL: dict[str, str] = {
    "u_reviews_to_date": "coalesce(u.n, 0)",
    "u_mean_stars_to_date": "u.stars",
    "u_days_since_last": "CAST(q.ts AS DATE) - CAST(u.last_ts AS DATE)",
    "i_reviews_to_date": "coalesce(i.n, 0)",
    "i_mean_stars_to_date": "i.stars",
    "ui_distance_km": _chord_km("u.lat", "u.lng", "b.latitude", "b.longitude"),
    "ui_category_affinity": "CASE WHEN u.n > 0 THEN c.matched / u.n END",
    "ui_als_score": "v.score",
    "ui_price_delta": "CASE WHEN u.tier > b.price_tier THEN u.tier - b.price_tier ELSE b.price_tier - u.tier END",
}
INTEGER_FEATURES = ("u_reviews_to_date", "u_days_since_last", "i_reviews_to_date")


def rounded(name: str) -> str:
    expr = FEATURE_SQL[name]
    return expr if name in INTEGER_FEATURES else f"round({expr}, 6)"


#: Read by several parts of an answer, or under an inequality join: evaluated once.
ONCE = {"ev", "dm", "dcat", "hist", "liked", "qs", "pos", "cand", "examples", "fitted", "user_vector", "topk", "retrieved", "visited", "uv", "iv"}


def with_relations(sql: str, *extra: tuple[str, str]) -> str:
    """Prepend to a query the relations, shared ones and then extra ones, that it leads to."""
    known = {**RELATIONS, **dict(extra)}
    needed: set[str] = set()
    open_ = [sql]
    while open_:
        named = set(re.findall(r"[A-Za-z_]+\w*", open_.pop())) & (known.keys() - needed)
        needed |= named
        open_ += [known[name] for name in named]
    parts = [
        f"{name} AS {'MATERIALIZED ' if name in ONCE else ''}({body})" for name, body in known.items() if name in needed
    ]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + sql


def asof_relations(queries: str) -> list[tuple[str, str]]:
    """Raw feature rows `feat` of a relation of queries, each from the reviews before its instant."""
    columns = ", ".join(f"{expr} AS {name}" for name, expr in FEATURE_SQL.items())
    return [
        (
            "by_user",
            f"""
SELECT q.query_id, {USER_PAST}
FROM {queries} q LEFT JOIN hist h ON h.user_id = q.user_id AND h.ts < q.ts
GROUP BY q.query_id""",
        ),
        (
            "by_item",
            f"""
SELECT q.query_id, {ITEM_PAST}
FROM {queries} q LEFT JOIN hist h ON h.business_id = q.business_id AND h.ts < q.ts
GROUP BY q.query_id""",
        ),
        # Earlier reviews of the user, once for each category they share with the item asked about.
        (
            "by_category",
            f"""
SELECT q.query_id, count(h.user_id) AS matched
FROM {queries} q JOIN dcat x ON x.business_id = q.business_id
LEFT JOIN liked h ON h.user_id = q.user_id AND h.category = x.category AND h.ts < q.ts
GROUP BY q.query_id""",
        ),
        (
            "user_vector",
            f"""
SELECT q.query_id, max_by(p.value, p.ts) AS value
FROM {queries} q JOIN uv p ON p.user_id = q.user_id AND p.ts < q.ts GROUP BY q.query_id""",
        ),
        (
            "by_vector",
            f"""
SELECT q.query_id, list_dot_product(any_value(a.value), max_by(p.value, p.ts)) AS score
FROM {queries} q JOIN user_vector a ON a.query_id = q.query_id
JOIN iv p ON p.business_id = q.business_id AND p.ts < q.ts GROUP BY q.query_id""",
        ),
        (
            "feat",
            f"""
SELECT query_id, {columns}
FROM {queries} q
LEFT JOIN by_user u USING (query_id) LEFT JOIN by_item i USING (query_id)
LEFT JOIN by_category c USING (query_id) LEFT JOIN by_vector v USING (query_id)
LEFT JOIN dm b ON b.business_id = q.business_id""",
        ),
    ]


def current_relations(queries: str, at: str = "TIMESTAMP '2000-01-01'", mark: str = "") -> list[tuple[str, str]]:
    """`feat` (user_id, business_id, features) of distinct pairs, all at one instant. A mark is
    appended to the relations' names, so that an answer may have them for several instants."""
    relations = _at_instant(queries, at)
    own = "|".join(name for name, _ in relations)
    return [(name + mark, re.sub(rf"\b({own})\b", rf"\g<1>{mark}", body)) for name, body in relations]


def _at_instant(queries: str, at: str) -> list[tuple[str, str]]:
    columns = ", ".join(f"{expr.replace('q.ts', at)} AS {name}" for name, expr in FEATURE_SQL.items())
    return [
        ("past_u", f"SELECT h.user_id, {USER_PAST} FROM hist h WHERE h.ts < {at} GROUP BY h.user_id"),
        ("past_i", f"SELECT h.business_id, {ITEM_PAST} FROM hist h WHERE h.ts < {at} GROUP BY h.business_id"),
        ("past_c", f"SELECT h.user_id, h.category, count(*) AS n FROM liked h WHERE h.ts < {at} GROUP BY h.user_id, h.category"),
        ("last_uv", f"SELECT user_id, max_by(value, ts) AS value FROM uv WHERE ts < {at} GROUP BY user_id"),
        ("last_iv", f"SELECT business_id, max_by(value, ts) AS value FROM iv WHERE ts < {at} GROUP BY business_id"),
        (
            "by_category",
            f"""
SELECT q.user_id, q.business_id, coalesce(sum(h.n), 0) AS matched
FROM {queries} q JOIN dcat x ON x.business_id = q.business_id
LEFT JOIN past_c h ON h.user_id = q.user_id AND h.category = x.category
GROUP BY q.user_id, q.business_id""",
        ),
        (
            "feat",
            f"""
SELECT q.user_id, q.business_id, {columns}
FROM {queries} q
LEFT JOIN by_category c ON (c.user_id, c.business_id) = (q.user_id, q.business_id)
LEFT JOIN past_u u ON u.user_id = q.user_id
LEFT JOIN past_i i ON i.business_id = q.business_id
LEFT JOIN dm b ON b.business_id = q.business_id
LEFT JOIN (SELECT p.user_id, p.business_id, list_dot_product(x.value, y.value) AS score
           FROM {queries} p JOIN last_uv x ON x.user_id = p.user_id
           JOIN last_iv y ON y.business_id = p.business_id) v
     ON (v.user_id, v.business_id) = (q.user_id, q.business_id)""",
        ),
    ]
