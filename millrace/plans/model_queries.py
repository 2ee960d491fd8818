"""Registered queries: retrieval, training, ranking, rerank, funnel, evaluation."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.expressions import dot
from millrace.functions.registry import feature_names
from millrace.operators import als, evaluation, ledger, models, ranking, rerank, retrieval, slo, tower
from millrace.operators import interactions as ix
from millrace.operators import popularity as pop
from millrace.operators import training as tr
from millrace.operators.features import Store
from millrace.operators.scoring import FIXED_SCORER, train_ranker
from millrace.operators.snapshot import reviewed_history
from millrace.operators.state import user_state
from millrace.plans import funnel
from millrace.plans.common import Query, fractional, full_store, rounded, split_store
from millrace.plans.oracle_base import (
    FEATURE_SQL,
    INTEGER_FEATURES,
    USER_PAST,
    asof_relations,
    current_relations,
    with_relations,
)
from millrace.schema import POOL_SIZE, SLICE_YEARS, SPLIT_T, TOP_K, VALIDATION_START
from millrace.session import growing, materialized, scratch
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

# --- shared SQL relations ---------------------------------------------------------

TOPK = (
    "topk",
    """
SELECT user_id, business_id, score, rank FROM (
  SELECT user_id, business_id, score,
         row_number() OVER (PARTITION BY user_id ORDER BY score DESC, business_id) AS rank
  FROM (SELECT ue.user_id, ie.business_id,
               list_dot_product(ue.value, ie.value) + 0.0 AS score
        FROM ue CROSS JOIN ie))
WHERE rank <= 500""",
)
HEAD = ("head", "SELECT * FROM ranked WHERE rank <= 500")
RETRIEVED = (
    "retrieved",
    """
SELECT user_id, business_id, score, rank, false AS cold FROM topk
UNION ALL
SELECT 'u' || c_custkey, business_id, pre_t_reviews::DOUBLE, rank, true
FROM customer CROSS JOIN head WHERE 'u' || c_custkey NOT IN (SELECT user_id FROM ue)""",
)
SCORE = """(
  coalesce(ui_als_score, 0) * 1.0::DOUBLE + 0.2::DOUBLE * coalesce(ui_category_affinity, 0)
  + 0.1::DOUBLE * ln(1 + i_reviews_to_date) + 0.05::DOUBLE * coalesce(i_mean_stars_to_date, 3)
  - 0.02::DOUBLE * coalesce(ui_distance_km, 10) - 0.05::DOUBLE * coalesce(ui_price_delta, 1))"""


def scored_relations(candidates: str) -> list[tuple[str, str]]:
    """`ordered`: candidates (user_id, business_id, pool_rank) scored and ranked."""
    return [
        *current_relations(candidates),
        (
            "ordered",
            f"""
SELECT user_id, business_id, pool_rank, score,
       row_number() OVER (PARTITION BY user_id ORDER BY score DESC, pool_rank) AS rank
FROM (SELECT f.user_id, f.business_id, k.pool_rank, {SCORE} AS score
      FROM feat f JOIN {candidates} k ON f.user_id = k.user_id AND f.business_id = k.business_id)""",
        ),
    ]


EVAL_USERS = ("eval_users", "SELECT DISTINCT user_id FROM truth")
SHARED = (
    "shared",
    "SELECT user_id, business_id, rank AS pool_rank FROM eval_users CROSS JOIN head",
)
PERSONAL = (
    "personal",
    """
SELECT user_id, business_id, rank AS pool_rank FROM retrieved
WHERE user_id IN (SELECT user_id FROM eval_users)""",
)
ORDERED = [TOPK, HEAD, RETRIEVED, EVAL_USERS, PERSONAL, *scored_relations("personal")]

INPUTS = (
    "inputs",
    """
SELECT o.*, coalesce(d.is_open, false) AS is_open, d.categories[1] AS primary_category,
       r.user_id IS NOT NULL AS repeat
FROM ordered o LEFT JOIN dm d ON o.business_id = d.business_id
LEFT JOIN reviewed r ON o.user_id = r.user_id AND o.business_id = r.business_id""",
)


def reranked_sql(source: str, where: str, cap: int | str, k: int) -> str:
    return f"""
SELECT * EXCLUDE (deferred, rank, final), rank AS previous_rank, final AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY deferred, rank) AS final FROM (
    SELECT *, primary_category IS NOT NULL AND coalesce(
             row_number() OVER (PARTITION BY user_id, primary_category ORDER BY rank) > {cap}, false)
           AS deferred
    FROM {source} WHERE {where}))
WHERE final <= {k}"""


SERVED = ("served", reranked_sql("inputs", "NOT repeat AND is_open", 2, TOP_K))


def metric_sql(hits: str, names: list[str], ks: tuple[int, ...]) -> str:
    """(name, n_users, metric, value) from hits (name, user_id, rank)."""
    values = ", ".join(f"('{n}')" for n in names)
    recalls = ", ".join(
        f"""count(*) FILTER (WHERE rank <= {k}) / any_value(n_rel) AS "recall@{k}" """ for k in ks
    )
    sums = ", ".join([*[f'sum("recall@{k}") AS "recall@{k}"' for k in ks], 'sum("ndcg@10") AS "ndcg@10"'])
    metrics = ", ".join([*[f'"recall@{k}"' for k in ks], '"ndcg@10"'])
    filled = ", ".join(
        f'coalesce({m.strip()} / n_users, 0.0::DOUBLE) AS {m.strip()}' for m in metrics.split(",")
    )
    return f"""
SELECT name, n_users, metric, value FROM (
  UNPIVOT (
    SELECT n.name, u.n_users, {filled}
    FROM (VALUES {values}) n(name)
    CROSS JOIN (SELECT count(DISTINCT user_id) AS n_users FROM truth) u
    LEFT JOIN (SELECT name, {sums} FROM (
        SELECT h.name, h.user_id, {recalls},
               coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 10), 0)
               / any_value(list_sum(list_transform(range(1, least(n_rel, 10) + 1),
                                                   lambda i: 1 / log2(i + 1)))) AS "ndcg@10"
        FROM {hits} h JOIN n_rel USING (user_id) GROUP BY h.name, h.user_id)
      GROUP BY name) s ON s.name = n.name)
  ON {metrics} INTO NAME metric VALUE value)"""


POP_HITS = (
    "pop_hits",
    "SELECT user_id, business_id, rank FROM truth JOIN head USING (business_id)",
)
VEC_HITS = (
    "vec_hits",
    "SELECT user_id, business_id, rank FROM truth JOIN topk USING (user_id, business_id)",
)
NAMED_HITS = (
    "named_hits",
    """
SELECT 'popularity' AS name, user_id, rank FROM pop_hits
UNION ALL SELECT 'vectors', user_id, rank FROM vec_hits""",
)
METRICS = (
    "metrics",
    metric_sql("named_hits", ["popularity", "vectors"], (10, 50, 100, 500)),
)
EVALUATED = [TOPK, HEAD, POP_HITS, VEC_HITS, NAMED_HITS, METRICS]

# --- shared DataFrames ------------------------------------------------------------


def _truth(spark, sf):
    return evaluation.holdout(tables.events(spark, sf), tables.dim(spark, sf), SPLIT_T)


def _counts(spark, sf):
    return pop.catalog_counts(tables.events(spark, sf), tables.dim(spark, sf), SPLIT_T)


def _head(spark, sf):
    return retrieval.popularity_head(_counts(spark, sf))


def _topk(spark, sf):
    return retrieval.exact_topk(tables.user_embedding(spark, sf), tables.item_embedding(spark, sf))


def _vector_hits(spark, sf, truth):
    return retrieval.topk_hits(tables.user_embedding(spark, sf), tables.item_embedding(spark, sf), truth)


def _reviewed(spark, sf):
    return reviewed_history(tables.events(spark, sf), SPLIT_T)


def _pool(spark, sf):
    return pop.popularity_pool(tables.events(spark, sf), SPLIT_T)


def _pairs(spark, sf):
    return ix.interactions(tables.events(spark, sf), tables.dim(spark, sf), SPLIT_T)


def _lists(spark, sf, users):
    """A full list for every user: retrieved, or the popularity head without a vector."""
    return retrieval.retrieve(
        users,
        tables.user_embedding(spark, sf),
        tables.item_embedding(spark, sf),
        _head(spark, sf),
    )


def _scored(spark, sf, reviewed=None):
    return ranking.score_retrieved(
        _truth(spark, sf).select("user_id").distinct(),
        tables.user_embedding(spark, sf),
        tables.item_embedding(spark, sf),
        _head(spark, sf),
        split_store(spark, sf),
        SPLIT_T,
        FIXED_SCORER,
        reviewed=reviewed,
    )


def _ordered(spark, sf):
    scored = _scored(spark, sf).select("user_id", "business_id", "pool_rank", "score")
    return ranking.ranked_in_place(scored)


def _shown(df):
    """Scores at the precision that answers are compared at; ranks come from the full ones."""
    return df.withColumn("score", F.round("score", 6) + F.lit(0.0))


def _rerank_inputs(spark, sf, k=None, variants=()):
    return ranking.ranked_in_place(_scored(spark, sf, _reviewed(spark, sf)).drop("cold"), k, variants)


def _evaluated(spark, sf):
    truth = materialized(_truth(spark, sf), "truth")
    hits = evaluation.named_hits(
        {
            "popularity": evaluation.shared_list_hits(_head(spark, sf), truth),
            "vectors": _vector_hits(spark, sf, truth),
        }
    )
    return evaluation.evaluate(hits, truth, ["popularity", "vectors"])


# --- retrieval --------------------------------------------------------------------

PAIRS_SQL = (
    "pairs",
    "SELECT user_id, business_id, CAST(count(*) AS INTEGER) AS confidence FROM pre "
    "WHERE business_id IN (SELECT business_id FROM dm) GROUP BY ALL",
)


@register("interactions", with_relations("SELECT * FROM pairs", PAIRS_SQL))
def interactions(spark, sf):
    return _pairs(spark, sf)


@register(
    "index_ids",
    with_relations(
        """
SELECT user_idx, item_idx, confidence FROM pairs
JOIN (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS user_idx
      FROM (SELECT DISTINCT user_id FROM pairs)) USING (user_id)
JOIN (SELECT business_id, row_number() OVER (ORDER BY business_id) - 1 AS item_idx
      FROM dm) USING (business_id)""",
        PAIRS_SQL,
    ),
)
def index_ids(spark, sf):
    pairs = _pairs(spark, sf)
    return ix.indexed(pairs, ix.user_index(pairs), ix.item_index(tables.dim(spark, sf)))


@register("als_fit")
def als_fit(spark, sf):
    users, items = als.fit_factors(_pairs(spark, sf), tables.dim(spark, sf))
    return users.select(F.lit("user").alias("side"), F.col("user_id").alias("id"), "value").unionByName(
        items.select(F.lit("item").alias("side"), F.col("business_id").alias("id"), "value")
    )


@register(
    "als_fit_contract",
    with_relations(
        """
SELECT 'user' AS side, user_id AS id, 64 AS width, false AS zero
FROM (SELECT DISTINCT user_id FROM pairs)
UNION ALL SELECT 'item', business_id, 64, business_id NOT IN (SELECT business_id FROM pairs)
FROM dm""",
        PAIRS_SQL,
    ),
)
def als_fit_contract(spark, sf):
    """What the learned factors promise whatever their values: who has one, its width,
    and that exactly the untouched items are zero."""
    return als_fit(spark, sf).select(
        "side",
        "id",
        F.size("value").alias("width"),
        F.forall("value", lambda x: x == 0).alias("zero"),
    )


@register("als_slices")
def als_slices(spark, sf):
    boundaries = [datetime(y, 1, 1) for y in SLICE_YEARS]
    users, items = als.als_slices(
        tables.events(spark, sf), tables.dim(spark, sf), boundaries
    )
    return users.select(
        F.lit("user").alias("side"), F.col("user_id").alias("id"), "ts", "value"
    ).unionByName(
        items.select(F.lit("item").alias("side"), F.col("business_id").alias("id"), "ts", "value")
    )


@register(
    "als_slices_contract",
    with_relations(
        """
SELECT 'user' AS side, user_id AS id, make_timestamp(y, 1, 1, 0, 0, 0) AS ts, 64 AS width, false AS zero
FROM years JOIN (SELECT user_id, min(ts) AS first FROM ev SEMI JOIN dm USING (business_id) GROUP BY user_id)
  ON first < make_timestamp(y, 1, 1, 0, 0, 0)
UNION ALL
SELECT 'item', d.business_id, make_timestamp(y, 1, 1, 0, 0, 0), 64, first IS NULL OR first >= make_timestamp(y, 1, 1, 0, 0, 0)
FROM years CROSS JOIN dm d LEFT JOIN (SELECT business_id, min(ts) AS first FROM ev GROUP BY business_id) USING (business_id)
WHERE make_timestamp(y, 1, 1, 0, 0, 0) > (SELECT min(ts) FROM ev SEMI JOIN dm USING (business_id))"""
    ),
)
def als_slices_contract(spark, sf):
    """Who has a vector at which boundary, its width, and that exactly the items without an earlier
    review are zero."""
    return als_slices(spark, sf).select(
        "side",
        "id",
        "ts",
        F.size("value").alias("width"),
        F.forall("value", lambda x: x == 0).alias("zero"),
    )


@register(
    "exact_topk",
    with_relations("SELECT user_id, business_id, round(score, 6) + 0.0 AS score, rank FROM topk", TOPK),
)
def exact_topk(spark, sf):
    return _shown(_topk(spark, sf))


@register(
    "retrieve",
    with_relations(
        "SELECT user_id, business_id, round(score, 6) + 0.0 AS score, rank, cold FROM retrieved",
        TOPK,
        HEAD,
        RETRIEVED,
    ),
)
def retrieve(spark, sf):
    return _shown(_lists(spark, sf, tables.users(spark, sf)))


# --- two-tower inputs -------------------------------------------------------------

EXAMPLES = [
    (
        "asked",
        """
SELECT user_id, business_id, ts, user_id || '|' || business_id || '|' || ts AS query_id, count(*) AS copies
FROM pre WHERE business_id IN (SELECT business_id FROM dm) GROUP BY ALL""",
    ),
    # The past of each asked (user, instant), once for each review of it.
    (
        "past",
        f"""
SELECT q.user_id, q.ts, {USER_PAST}
FROM (SELECT DISTINCT user_id, ts FROM asked) q LEFT JOIN hist h ON h.user_id = q.user_id AND h.ts < q.ts
GROUP BY q.user_id, q.ts""",
    ),
    (
        "examples",
        f"""
SELECT q.user_id, q.business_id, q.ts, {FEATURE_SQL['u_reviews_to_date']} AS u_reviews_to_date,
       {FEATURE_SQL['u_mean_stars_to_date']} AS u_mean_stars_to_date,
       {FEATURE_SQL['u_days_since_last']} AS u_days_since_last
FROM pre q JOIN past u ON u.user_id = q.user_id AND u.ts = q.ts
WHERE q.business_id IN (SELECT business_id FROM dm)""",
    ),
    (
        "fitted",
        """
SELECT avg(ln(1 + u_reviews_to_date)) AS log_count_mean,
       CASE WHEN stddev_pop(ln(1 + u_reviews_to_date)) > 1e-8
            THEN stddev_pop(ln(1 + u_reviews_to_date)) ELSE 1 END AS log_count_std,
       avg(ln(1 + coalesce(u_days_since_last, 0))) AS log_days_mean,
       CASE WHEN stddev_pop(ln(1 + coalesce(u_days_since_last, 0))) > 1e-8
            THEN stddev_pop(ln(1 + coalesce(u_days_since_last, 0))) ELSE 1 END AS log_days_std
FROM examples""",
    ),
]


def _examples(spark, sf):
    events, dim = tables.events(spark, sf), tables.dim(spark, sf)
    # The tower's inputs read the user timeline only.
    users = Store(user=materialized(user_state(events, dim), "user"))
    return tower.two_tower_examples(events, dim, users, SPLIT_T)


@register(
    "two_tower_examples",
    with_relations(
        """
SELECT user_id, business_id, ts, u_reviews_to_date,
       round(u_mean_stars_to_date, 6) AS u_mean_stars_to_date, u_days_since_last FROM examples""",
        *EXAMPLES,
    ),
)
def two_tower_examples(spark, sf):
    return rounded(_examples(spark, sf), ["u_mean_stars_to_date"])


NORMALIZED = ["count_z", "stars_fifth", "stars_present", "days_z", "days_present"]


@register(
    "user_normalization",
    with_relations(
        """
SELECT user_id, business_id, ts,
       round((ln(1 + u_reviews_to_date) - log_count_mean) / log_count_std, 6) AS count_z,
       round(coalesce(u_mean_stars_to_date, 0) / 5, 6) AS stars_fifth,
       (u_mean_stars_to_date IS NOT NULL)::INT::DOUBLE AS stars_present,
       round((ln(1 + coalesce(u_days_since_last, 0)) - log_days_mean) / log_days_std, 6) AS days_z,
       (u_days_since_last IS NOT NULL)::INT::DOUBLE AS days_present
FROM examples CROSS JOIN fitted""",
        *EXAMPLES,
    ),
)
def user_normalization(spark, sf):
    examples = materialized(_examples(spark, sf), "examples")
    out = tower.normalized_user_inputs(examples, tower.user_normalization(examples))
    return rounded(out.select("user_id", "business_id", "ts", *NORMALIZED), NORMALIZED)


@register(
    "item_inputs",
    with_relations("""
SELECT business_id, 'latitude_z' AS feature,
       round((latitude - avg(latitude) OVER ()) / stddev_pop(latitude) OVER (), 6) AS value FROM dm
UNION ALL SELECT business_id, 'longitude_z',
       round((longitude - avg(longitude) OVER ()) / stddev_pop(longitude) OVER (), 6) FROM dm
UNION ALL SELECT business_id, 'price_quarter', coalesce(price_tier / 4, 0) FROM dm
UNION ALL SELECT business_id, 'price_present', (price_tier IS NOT NULL)::INT FROM dm
UNION ALL SELECT DISTINCT business_id, 'category:' || category, 1 FROM dcat"""),
)
def item_inputs(spark, sf):
    return rounded(tower.item_inputs(tables.dim(spark, sf)), ["value"])


PROBABILITY = (
    "probability",
    """
SELECT business_id, n AS draws,
       (512 * n / (SELECT count(*) FROM pre WHERE business_id IN (SELECT business_id FROM dm))
        + 128 / (SELECT count(*) FROM dm)) / 640 AS q FROM counted""",
)


def _example_rows(spark, sf):
    """The examples without their inputs."""
    return pop.before(tables.events(spark, sf), SPLIT_T).join(
        growing(tables.dim(spark, sf).select("business_id")), "business_id", "left_semi"
    )


@register(
    "sampling_probability",
    with_relations("SELECT business_id, draws, round(q, 9) AS q FROM probability", PROBABILITY),
)
def sampling_probability(spark, sf):
    out = tower.sampling_probability(_example_rows(spark, sf), tables.dim(spark, sf))
    return rounded(out, ["q"], 9)


@register(
    "known_positive_mask",
    with_relations(
        """
SELECT b.batch_id, b.slot, c.position
FROM batch b JOIN pairs p ON b.user_id = p.user_id
JOIN candidates c ON c.batch_id = b.batch_id AND c.business_id = p.business_id
WHERE b.slot <> c.position""",
        PAIRS_SQL,
        (
            "batch",
            """
SELECT n // 512 AS batch_id, CAST(n % 512 AS INTEGER) AS slot, user_id, business_id FROM (
  SELECT user_id, business_id, row_number() OVER (ORDER BY user_id, ts, business_id) - 1 AS n
  FROM pre WHERE business_id IN (SELECT business_id FROM dm))""",
        ),
        (
            "candidates",
            """
SELECT batch_id, slot AS position, business_id FROM batch
UNION ALL
SELECT batch_id, CAST(512 + j AS INTEGER), business_id FROM (
  SELECT batch_id, j, ('0x' || substr(md5('42:' || batch_id || ':' || j), 1, 8))::BIGINT
                      % (SELECT count(*) FROM dm) AS item_idx
  FROM (SELECT DISTINCT batch_id FROM batch) CROSS JOIN (SELECT unnest(range(128)) AS j))
JOIN (SELECT business_id, row_number() OVER (ORDER BY business_id) - 1 AS item_idx FROM dm)
USING (item_idx)""",
        ),
    ),
)
def known_positive_mask(spark, sf):
    rows = materialized(tower.batches(_example_rows(spark, sf)), "batches")
    items = ix.item_index(tables.dim(spark, sf))
    return tower.known_positive_mask(
        rows, tower.batch_candidates(rows, items), _pairs(spark, sf)
    )


@register(
    "logq_scores",
    with_relations(
        """
SELECT user_id, business_id, round(s, 6) AS similarity, round(s / 0.07::DOUBLE - ln(q), 6) AS logit
FROM (SELECT p.user_id, p.business_id, list_dot_product(ue.value, ie.value) AS s
      FROM pairs p JOIN ue USING (user_id) JOIN ie USING (business_id))
JOIN probability USING (business_id)""",
        PAIRS_SQL,
        PROBABILITY,
    ),
)
def logq_scores(spark, sf):
    probability = tower.sampling_probability(_example_rows(spark, sf), tables.dim(spark, sf))
    out = tower.logq_scores(
        _pairs(spark, sf).select("user_id", "business_id"),
        tables.user_embedding(spark, sf),
        tables.item_embedding(spark, sf),
        probability,
    )
    return rounded(out, ["similarity", "logit"])


@register(
    "export_user_inputs",
    with_relations("""
SELECT user_id, count(*) AS u_reviews_to_date, round(avg(stars), 6) AS u_mean_stars_to_date,
       DATE '2000-01-01' - CAST(max(ts) AS DATE) AS u_days_since_last FROM pre GROUP BY user_id"""),
)
def export_user_inputs(spark, sf):
    known = _pairs(spark, sf).select("user_id").distinct()
    out = tower.export_user_inputs(known, split_store(spark, sf), SPLIT_T)
    return rounded(out, ["u_mean_stars_to_date"])


# --- training ---------------------------------------------------------------------


def draw_sql(groups: str, reviewed: str, pool: str, size: str) -> str:
    """Negatives: first 4 distinct eligible draws among 80, by attempt."""
    return f"""
SELECT group_id, user_id, ts, business_id FROM (
  SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY attempt) AS n FROM (
    SELECT g.group_id, g.user_id, g.ts, p.business_id, min(g.attempt) AS attempt
    FROM (SELECT *, ('0x' || substr(md5('20260722:' || group_id || ':' || attempt), 1, 8))::BIGINT
                    % {size} AS pick
          FROM {groups} CROSS JOIN (SELECT unnest(range(80)) AS attempt)) g
    JOIN {pool} p ON {pool_match(pool)}
    WHERE p.business_id <> g.business_id
      AND NOT EXISTS (SELECT 1 FROM {reviewed} r
                      WHERE r.user_id = g.user_id AND r.business_id = p.business_id)
    GROUP BY ALL))
WHERE n <= 4"""


def pool_match(pool: str) -> str:
    same = "p.rank - 1 = g.pick AND p.user_id = g.user_id"
    return "p.pool_rank - 1 = g.pick" if pool == "pool" else same


# A group's number: the reviews of smaller users, and the user's own up to the review.
POSITIVES = (
    "pos",
    """
SELECT (earlier + row_number() OVER (PARTITION BY p.user_id ORDER BY p.ts, p.business_id))::BIGINT AS group_id,
       p.user_id, p.business_id, p.ts
FROM pre p JOIN pool s ON s.business_id = p.business_id
JOIN (SELECT a.user_id, coalesce(sum(count(*)) OVER (ORDER BY a.user_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
      FROM pre a JOIN pool b ON b.business_id = a.business_id GROUP BY a.user_id) o ON o.user_id = p.user_id""",
)
NEGATIVES_SQL = (
    "neg",
    draw_sql("pos", "reviewed", "pool", "(SELECT count(*) FROM pool)"),
)
CANDIDATES = (
    "cand",
    """
SELECT group_id || '|' || business_id AS query_id, * FROM (
  SELECT group_id, user_id, business_id, ts, 1 AS label FROM pos
  UNION ALL SELECT group_id, user_id, business_id, ts, 0 FROM neg)""",
)
TRAINING = [
    POSITIVES,
    NEGATIVES_SQL,
    CANDIDATES,
    *asof_relations("cand"),
    (
        "rows_t",
        "SELECT c.group_id, c.user_id, c.business_id, c.ts, c.label, f.* EXCLUDE (query_id) "
        "FROM cand c JOIN feat f USING (query_id)",
    ),
]


def _training(spark, sf):
    return tr.training_set(
        tables.events(spark, sf), full_store(spark, sf), _pool(spark, sf), SPLIT_T
    )


@register("positives", with_relations("SELECT * FROM pos", POSITIVES))
def positives(spark, sf):
    return tr.positives(tables.events(spark, sf), _pool(spark, sf), SPLIT_T).drop("slot")


@register("sample_negatives", with_relations("SELECT * FROM neg", POSITIVES, NEGATIVES_SQL))
def sample_negatives(spark, sf):
    pool = materialized(_pool(spark, sf), "pool")
    groups = materialized(tr.positives(tables.events(spark, sf), pool, SPLIT_T), "groups")
    return tr.pool_negatives(groups, pool)


@register(
    "training_set",
    with_relations(
        f"SELECT group_id, user_id, business_id, ts, label, {CAST_FEATURES} FROM rows_t", *TRAINING
    ),
)
def training_set(spark, sf):
    return rounded(_training(spark, sf), fractional())


PERSONAL_TRAINING = [
    TOPK,
    HEAD,
    RETRIEVED,
    (
        "pos",
        """
SELECT row_number() OVER (ORDER BY user_id, ts, business_id) AS group_id, user_id, business_id, ts
FROM pre JOIN retrieved USING (user_id, business_id)""",
    ),
    (
        "neg",
        draw_sql("pos", "reviewed", "retrieved", "(SELECT least(500, count(*)) FROM dm)"),
    ),
    CANDIDATES,
    *asof_relations("cand"),
]


@register(
    "training_set_personalized",
    with_relations(
        f"SELECT c.group_id, c.user_id, c.business_id, c.ts, c.label, {CAST_FEATURES} "
        "FROM cand c JOIN feat f USING (query_id)",
        *PERSONAL_TRAINING,
    ),
)
def training_set_personalized(spark, sf):
    # Lists are shorter than the pool size only where the whole catalog is.
    catalog = min(POOL_SIZE, tables.dim(spark, sf).count())
    lists = materialized(_lists(spark, sf, tables.users(spark, sf)), "lists")
    out = tr.training_set_personalized(
        tables.events(spark, sf), full_store(spark, sf), lists, SPLIT_T, catalog
    )
    return rounded(out, fractional())


@register(
    "training_profile",
    with_relations(
        "SELECT metric, round(value, 6) AS value FROM (UNPIVOT (SELECT "
        "sum(label)::DOUBLE AS positives, sum(1 - label)::DOUBLE AS negatives, "
        "count(DISTINCT group_id)::DOUBLE AS groups, count(*)::DOUBLE AS rows, "
        + ", ".join(f'avg(({n} IS NOT NULL)::INT)::DOUBLE AS "coverage:{n}"' for n in FEATURE_SQL)
        + ", count(*)::DOUBLE / count(DISTINCT group_id) AS rows_per_group FROM rows_t) "
        "ON COLUMNS(*) INTO NAME metric VALUE value)",
        *TRAINING,
    ),
)
def training_profile(spark, sf):
    return rounded(tr.training_profile(_training(spark, sf)), ["value"])


@register(
    "temporal_split",
    with_relations(
        """
SELECT CASE WHEN ts < TIMESTAMP '1999-01-01' THEN 'train' ELSE 'validation' END AS split,
       group_id, count(*) AS group_size FROM cand WHERE ts < TIMESTAMP '2000-01-01' GROUP BY ALL""",
        POSITIVES,
        NEGATIVES_SQL,
        CANDIDATES,
    ),
)
def temporal_split(spark, sf):
    pool = materialized(_pool(spark, sf), "pool")
    groups = materialized(tr.positives(tables.events(spark, sf), pool, SPLIT_T), "groups")
    columns = ["group_id", "ts"]
    rows = groups.select(*columns).unionByName(tr.pool_negatives(groups, pool).select(*columns))
    return tr.temporal_split(rows, VALIDATION_START, SPLIT_T)


@register("train_ranker")
def train_ranking_model(spark, sf):
    fitted = train_ranker(_training(spark, sf), VALIDATION_START, SPLIT_T)
    return fitted.importance.withColumns(
        {
            "validation_ndcg": F.lit(fitted.validation_ndcg),
            "popularity_ndcg": F.lit(fitted.popularity_ndcg),
        }
    )


@register(
    "train_ranker_contract",
    " UNION ALL ".join(f"SELECT '{n}' AS feature, true AS finite, true AS learned" for n in FEATURE_SQL),
)
def train_ranker_contract(spark, sf):
    """What the fitted ranker promises whatever its numbers: a finite weight for every feature and
    a validation NDCG above that of popularity."""
    finite = F.col("weight").isNotNull() & ~F.isnan("weight") & (F.abs("weight") < float("inf"))
    return train_ranking_model(spark, sf).select(
        "feature", finite.alias("finite"), (F.col("validation_ndcg") > F.col("popularity_ndcg")).alias("learned")
    )


@register(
    "stored_models",
    with_relations(
        """
SELECT name, metric, n_users, true AS in_range, 'NEW' AS first_run, 'OK' AS second_run, 1::BIGINT AS versions
FROM (SELECT unnest(['factor order', 'ranked order']) AS name)
CROSS JOIN (SELECT unnest(['recall@10', 'recall@50', 'ndcg@10']) AS metric)
CROSS JOIN (SELECT count(DISTINCT user_id) AS n_users FROM truth)"""
    ),
)
def stored_models(spark, sf):
    """Factors and a ranker are fitted, stored and loaded; the holdout is scored with what was
    loaded, the order of the factors against that of the ranker, and the report goes to the ledger
    twice: new, then unchanged."""
    root = scratch(spark, "models")
    users, items = als.fit_factors(_pairs(spark, sf), tables.dim(spark, sf))
    models.store_factors(root, users, items, SPLIT_T)
    models.store_ranker(spark, root, train_ranker(_training(spark, sf), VALIDATION_START, SPLIT_T), SPLIT_T)
    loaded, learned = models.factors(spark, root), models.ranker(spark, root)
    truth = materialized(_truth(spark, sf), "truth")
    store = split_store(spark, sf)
    store = replace(store, user_als=_as_of_split(loaded.users), item_als=_as_of_split(loaded.items))
    scored = materialized(
        ranking.score_retrieved(
            truth.select("user_id").distinct(), loaded.users, loaded.items, _head(spark, sf), store, SPLIT_T, learned.scorer
        ),
        "scored",
    )
    by_factors = scored.withColumn("rank", F.col("pool_rank"))
    by_ranker = ranking.rank_candidates(scored)
    hits = evaluation.named_hits(
        {
            "factor order": evaluation.list_hits(by_factors, truth),
            "ranked order": evaluation.list_hits(by_ranker, truth),
        }
    )
    report = materialized(evaluation.evaluate(hits, truth, ["factor order", "ranked order"], (10, 50)), "report")
    first, _ = ledger.check(spark, root, report)
    runs = {"first_run": materialized(first, "first")}
    second, _ = ledger.check(spark, root, report)
    runs["second_run"] = second
    recorded = ledger.history(spark, root).groupBy("name").agg(F.min("version").alias("versions"))
    out = report.select("name", "metric", "n_users", F.col("value").between(0, 1).alias("in_range"))
    for column, run in runs.items():
        out = out.join(run.select("name", "metric", F.col("status").alias(column)), ["name", "metric"])
    return out.join(recorded, "name").select(
        "name", "metric", "n_users", "in_range", "first_run", "second_run", "versions"
    )


def _as_of_split(vectors):
    return vectors.withColumn("ts", F.lit(SPLIT_T.isoformat(" ")).cast("timestamp_ntz"))


# --- ranking and rerank -----------------------------------------------------------


@register(
    "score_shared_pool",
    with_relations(
        "SELECT user_id, business_id, pool_rank, round(score, 6) + 0.0 AS score, rank FROM ordered",
        HEAD,
        EVAL_USERS,
        SHARED,
        *scored_relations("shared"),
    ),
)
def score_shared_pool(spark, sf):
    users = _truth(spark, sf).select("user_id").distinct()
    head = _head(spark, sf).withColumnRenamed("rank", "pool_rank")
    return _shown(
        ranking.score_shared_pool(
            users, head, POOL_SIZE, split_store(spark, sf), SPLIT_T, FIXED_SCORER
        )
    )


@register(
    "score_personal_pool",
    with_relations(
        "SELECT user_id, business_id, pool_rank, round(score, 6) + 0.0 AS score, rank FROM ordered",
        *ORDERED,
    ),
)
def score_personal_pool(spark, sf):
    return _shown(_ordered(spark, sf))


@register(
    "ordering_resolution",
    with_relations(
        """
SELECT count(*) AS users, count(DISTINCT whole) AS distinct_orderings,
       count(DISTINCT head) AS distinct_heads
FROM (SELECT user_id, string_agg(business_id, '|' ORDER BY rank) AS whole,
             string_agg(business_id, '|' ORDER BY rank) FILTER (WHERE rank <= 10) AS head
      FROM ordered GROUP BY user_id)""",
        *ORDERED,
    ),
)
def ordering_resolution(spark, sf):
    return ranking.orderings_in_place(_scored(spark, sf))


@register(
    "rerank_inputs",
    with_relations(
        """
SELECT user_id, business_id, pool_rank, round(score, 6) + 0.0 AS score, rank, is_open,
       primary_category, repeat FROM inputs""",
        *ORDERED,
        INPUTS,
    ),
)
def rerank_inputs(spark, sf):
    return _shown(_rerank_inputs(spark, sf))


@register(
    "rerank",
    with_relations(
        "SELECT user_id, business_id, previous_rank, rank FROM served", *ORDERED, INPUTS, SERVED
    ),
)
def rerank_lists(spark, sf):
    out = rerank.rerank(_rerank_inputs(spark, sf, TOP_K, [rerank.SERVING]), TOP_K)
    return out.select("user_id", "business_id", "previous_rank", "rank")


VARIANT_SQL = {
    "no rerank": ("true", "NULL"),
    "diversity cap only": ("true", 2),
    "closed filter only": ("is_open", "NULL"),
    "repeats filter only": ("NOT repeat", "NULL"),
    "all three": ("NOT repeat AND is_open", 2),
}


@register(
    "rerank_ablation",
    with_relations(
        """
SELECT name, n_users, metric, round(value, 6) AS value,
       round(100 * (value / nullif(base, 0) - 1), 4) AS delta_percent
FROM metrics JOIN (SELECT metric, value AS base FROM metrics WHERE name = 'no rerank')
USING (metric)""",
        *ORDERED,
        INPUTS,
        (
            "variants",
            " UNION ALL ".join(
                f"SELECT '{name}' AS name, user_id, business_id, rank FROM ("
                + reranked_sql("inputs", where, cap, 50)
                + ")"
                for name, (where, cap) in VARIANT_SQL.items()
            ),
        ),
        (
            "variant_hits",
            "SELECT v.name, v.user_id, v.rank FROM variants v JOIN truth USING (user_id, business_id)",
        ),
        ("metrics", metric_sql("variant_hits", list(VARIANT_SQL), (10, 50))),
    ),
)
def rerank_ablation(spark, sf):
    truth = materialized(_truth(spark, sf), "truth")
    lists = rerank.rerank_variants(_rerank_inputs(spark, sf, 50, rerank.ABLATION), 50, rerank.ABLATION)
    hits = evaluation.list_hits(
        lists.withColumnRenamed("variant", "name"), truth, ["name"]
    )
    names = [v.name for v in rerank.ABLATION]
    report = evaluation.evaluate(hits, truth, names, (10, 50))
    return rounded(rerank_delta(report, names[0]), ["value"])


def rerank_delta(report: DataFrame, baseline: str) -> DataFrame:
    """report plus each metric's change against the baseline run, in percent."""
    from pyspark.sql import Window as W

    base = F.max(F.when(F.col("name") == baseline, F.col("value"))).over(
        W.partitionBy("metric")
    )
    change = 100 * (F.col("value") / F.nullif(base, F.lit(0.0)) - 1)
    return report.withColumn("delta_percent", F.round(change, 4))


@register(
    "repeat_hit_share",
    with_relations(
        """
SELECT count(*) AS hits, count(*) FILTER (WHERE repeat) AS repeats
FROM inputs JOIN truth USING (user_id, business_id) WHERE rank <= 10""",
        *ORDERED,
        INPUTS,
    ),
)
def repeat_hit_share(spark, sf):
    return evaluation.repeat_hit_share(
        _ordered(spark, sf), _truth(spark, sf), _reviewed(spark, sf)
    )


@register(
    "closed_target_share",
    with_relations("""
SELECT count(*) AS pairs, count(*) FILTER (WHERE NOT coalesce(is_open, false)) AS closed,
       round(avg((NOT coalesce(is_open, false))::INT), 6) AS share
FROM truth LEFT JOIN dm USING (business_id)"""),
)
def closed_target_share(spark, sf):
    return rounded(
        evaluation.closed_target_share(_truth(spark, sf), tables.dim(spark, sf)), ["share"]
    )


@register(
    "recommend_batch",
    with_relations(
        """
SELECT user_id, rank, business_id, name, pre_t_reviews, round(score, 6) + 0.0 AS score,
       10 AS requested_k, count(business_id) OVER (PARTITION BY user_id) AS returned_k,
       10 - count(business_id) OVER (PARTITION BY user_id) AS shortfall
FROM (SELECT 'u' || c_custkey AS user_id FROM customer)
LEFT JOIN (SELECT s.user_id, s.business_id, s.rank, s.score, r.name, r.pre_t_reviews
           FROM served s LEFT JOIN ranked r USING (business_id)) USING (user_id)""",
        TOPK,
        HEAD,
        RETRIEVED,
        (
            "warm",
            "SELECT user_id, business_id, rank AS pool_rank FROM retrieved WHERE NOT cold",
        ),
        *scored_relations("warm"),
        (
            "inputs",
            """
SELECT o.*, coalesce(d.is_open, false) AS is_open, d.categories[1] AS primary_category,
       r.user_id IS NOT NULL AS repeat
FROM (SELECT user_id, business_id, score, rank FROM ordered
      UNION ALL SELECT user_id, business_id, score, rank FROM retrieved WHERE cold) o
LEFT JOIN dm d ON o.business_id = d.business_id
LEFT JOIN reviewed r ON o.user_id = r.user_id AND o.business_id = r.business_id""",
        ),
        SERVED,
    ),
)
def recommend_batch(spark, sf):
    return _shown(
        funnel.recommend_batch(
            tables.users(spark, sf),
            split_store(spark, sf),
            _counts(spark, sf),
            tables.user_embedding(spark, sf),
            tables.item_embedding(spark, sf),
            _reviewed(spark, sf),
            SPLIT_T,
            FIXED_SCORER,
        )
    )


@register(
    "recommend_popularity",
    with_relations(
        """
SELECT user_id, rank, business_id, name, pre_t_reviews, round(score, 6) + 0.0 AS score,
       10 AS requested_k, count(business_id) OVER (PARTITION BY user_id) AS returned_k,
       10 - count(business_id) OVER (PARTITION BY user_id) AS shortfall
FROM (SELECT 'u' || c_custkey AS user_id FROM customer)
LEFT JOIN (SELECT o.user_id, o.business_id, o.rank, o.score, r.name, r.pre_t_reviews
           FROM ordered o LEFT JOIN ranked r USING (business_id) WHERE o.rank <= 10)
USING (user_id)""",
        HEAD,
        (
            "shared",
            "SELECT 'u' || c_custkey AS user_id, business_id, rank AS pool_rank "
            "FROM customer CROSS JOIN head",
        ),
        *scored_relations("shared"),
    ),
)
def recommend_popularity(spark, sf):
    return _shown(
        funnel.recommend_popularity(
            tables.users(spark, sf), split_store(spark, sf), _counts(spark, sf), SPLIT_T, FIXED_SCORER
        )
    )


# --- evaluation -------------------------------------------------------------------


@register("holdout", with_relations("SELECT * FROM truth"))
def holdout(spark, sf):
    return _truth(spark, sf)


@register(
    "recall_at_k",
    with_relations(
        """
SELECT user_id, round(count(*) FILTER (WHERE rank <= 100) / any_value(n_rel), 6) AS recall
FROM n_rel LEFT JOIN pop_hits USING (user_id) GROUP BY user_id""",
        HEAD,
        POP_HITS,
    ),
)
def recall_at_k(spark, sf):
    truth = _truth(spark, sf)
    hits = evaluation.shared_list_hits(_head(spark, sf), truth)
    return rounded(evaluation.recall_at_k(hits, truth, 100), ["recall"])


@register(
    "ndcg_at_k",
    with_relations(
        """
SELECT user_id, round(coalesce(sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 10), 0)
       / any_value(list_sum(list_transform(range(1, least(n_rel, 10) + 1),
                                           lambda i: 1 / log2(i + 1)))), 6) AS ndcg
FROM n_rel LEFT JOIN pop_hits USING (user_id) GROUP BY user_id""",
        HEAD,
        POP_HITS,
    ),
)
def ndcg_at_k(spark, sf):
    truth = _truth(spark, sf)
    hits = evaluation.shared_list_hits(_head(spark, sf), truth)
    return rounded(evaluation.ndcg_at_k(hits, truth), ["ndcg"])


@register(
    "evaluate",
    with_relations(
        "SELECT name, n_users, metric, round(value, 6) AS value FROM metrics", *EVALUATED
    ),
)
def evaluate(spark, sf):
    return rounded(_evaluated(spark, sf), ["value"])


@register(
    "percentile_nearest_rank",
    """
SELECT event_type, p AS percentile, l[greatest(1, ceil(p / 100 * len(l)))::BIGINT] AS value
FROM (SELECT event_type, list_sort(list(value)) AS l FROM events GROUP BY event_type)
CROSS JOIN (SELECT unnest([50.0, 95.0, 99.0])::DOUBLE AS p)""",
)
def percentile_nearest_rank(spark, sf):
    log = tables.table(spark, sf, "events").select("event_type", "value")
    return evaluation.percentile_nearest_rank(log, ["event_type"], "value", slo.PERCENTILES)


@register(
    "marginal_hits",
    with_relations(
        """
SELECT source, pairs, round(pairs / (SELECT count(*) FROM truth), 6) AS share FROM (
  UNPIVOT (SELECT count(*) FILTER (WHERE a AND b) AS "both",
                  count(*) FILTER (WHERE a AND NOT b) AS first_only,
                  count(*) FILTER (WHERE b AND NOT a) AS second_only,
                  count(*) FILTER (WHERE NOT a AND NOT b) AS neither
           FROM (SELECT (user_id, business_id) IN (SELECT (user_id, business_id) FROM vec_hits) AS a,
                        (user_id, business_id) IN (SELECT (user_id, business_id) FROM pop_hits) AS b
                 FROM truth))
  ON "both", first_only, second_only, neither INTO NAME source VALUE pairs)""",
        *EVALUATED[:4],
    ),
)
def marginal_hits(spark, sf):
    truth = materialized(_truth(spark, sf), "truth")
    vectors = _vector_hits(spark, sf, truth)
    popular = evaluation.shared_list_hits(_head(spark, sf), truth)
    return rounded(
        evaluation.marginal_hits(vectors, popular, truth, POOL_SIZE), ["share"]
    )


@register(
    "eval_ledger",
    with_relations(
        """
SELECT coalesce(c.name, b.name) AS name, coalesce(c.metric, b.metric) AS metric,
       round(b.value, 6) AS baseline, round(c.value, 6) AS current,
       round(c.value - b.value, 6) AS delta,
       CASE WHEN c.value IS NULL THEN 'ABSENT' WHEN b.value IS NULL THEN 'NEW'
            WHEN b.n_users <> c.n_users THEN 'INVALID'
            WHEN c.value < b.value - 1e-6 THEN 'REGRESSION' ELSE 'OK' END AS status
FROM current_runs c FULL JOIN baseline_runs b ON c.name = b.name AND c.metric = b.metric""",
        *EVALUATED,
        (
            "current_runs",
            """
SELECT * FROM metrics
UNION ALL SELECT 'vectors as popularity', n_users, metric, value FROM metrics WHERE name = 'vectors'
UNION ALL SELECT 'moved holdout', n_users + 1, metric, value FROM metrics WHERE name = 'vectors'""",
        ),
        (
            "baseline_runs",
            """
SELECT * FROM metrics WHERE name = 'popularity'
UNION ALL SELECT 'vectors as popularity', n_users, metric, value FROM metrics WHERE name = 'popularity'
UNION ALL SELECT 'moved holdout', n_users, metric, value FROM metrics WHERE name = 'vectors'
UNION ALL SELECT 'retired run', n_users, metric, value FROM metrics WHERE name = 'popularity'""",
        ),
    ),
)
def eval_ledger(spark, sf):
    measured = materialized(_evaluated(spark, sf), "measured")
    columns = ["name", "n_users", "metric", "value"]

    def run(source: str, name: str, shift: int = 0) -> DataFrame:
        return measured.filter(F.col("name") == source).select(
            F.lit(name).alias("name"), (F.col("n_users") + shift).alias("n_users"), "metric", "value"
        )

    def union(*parts: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])

    current = union(
        measured, run("vectors", "vectors as popularity"), run("vectors", "moved holdout", 1)
    )
    baseline = union(
        run("popularity", "popularity"),
        run("popularity", "vectors as popularity"),
        run("vectors", "moved holdout"),
        run("popularity", "retired run"),
    )
    return rounded(ledger.compare(current, baseline), ["baseline", "current", "delta"])


CLOCK_SQL = """
SELECT user_id || '|' || strftime(ts, '%Y%m%d') AS request_id,
       CASE event_type WHEN 'signup' THEN 'retrieval_ms' WHEN 'error' THEN 'ranking_ms'
            WHEN 'view' THEN 'total_ms' WHEN 'click' THEN 'server_ms'
            WHEN 'purchase' THEN 'client_wall_ms' END AS clock, max(value) AS value
FROM events GROUP BY ALL"""


@register(
    "slo_report",
    with_relations(
        """
SELECT clock, count(*) AS samples,
       list_sort(list(value))[ceil(0.50 * count(*))::BIGINT] AS p50,
       list_sort(list(value))[ceil(0.95 * count(*))::BIGINT] AS p95,
       list_sort(list(value))[ceil(0.99 * count(*))::BIGINT] AS p99,
       any_value(budget)::DOUBLE AS budget_ms,
       count(*) FILTER (WHERE value > budget) AS over_budget,
       CASE WHEN any_value(budget) IS NULL THEN 'NONE' WHEN count(*) < 1000 THEN 'SHORT'
            WHEN list_sort(list(value))[ceil(0.99 * count(*))::BIGINT] <= any_value(budget)
            THEN 'PASS' ELSE 'MISS' END AS verdict
FROM (SELECT *, CASE clock WHEN 'retrieval_ms' THEN 10.0 WHEN 'ranking_ms' THEN 15.0
                     WHEN 'total_ms' THEN 100.0 WHEN 'server_ms' THEN 100.0 END AS budget
      FROM (SELECT clock, value FROM samples
            UNION ALL SELECT 'framework_ms', greatest(0, s.value - t.value)
              FROM samples s JOIN samples t USING (request_id)
              WHERE s.clock = 'server_ms' AND t.clock = 'total_ms'
            UNION ALL SELECT 'transport_ms', greatest(0, c.value - s.value)
              FROM samples c JOIN samples s USING (request_id)
              WHERE c.clock = 'client_wall_ms' AND s.clock = 'server_ms'))
GROUP BY clock""",
        ("samples", CLOCK_SQL),
    ),
)
def slo_report(spark, sf):
    points = ["p50", "p95", "p99"]
    return slo.slo_report(tables.request_samples(spark, sf)).select(
        "clock", "samples", *points, "budget_ms", "over_budget", "verdict"
    )
