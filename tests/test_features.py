"""Right-exclusive reads, current reads, the snapshot and the audits."""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime

import pytest
from conftest import ASKED, FUTURE, PAST, PLACES, golden_store, make_dim, make_events, make_queries, rows
from pyspark.sql import functions as F
from test_data import random_dim, random_events

from millrace.functions import registry
from millrace.operators import snapshot
from millrace.operators.asof import asof_join, asof_times
from millrace.operators.audit import changed_rows, leaky_counts
from millrace.operators.features import asof_features, current_features, current_store, get_asof
from millrace.operators.state import user_state


def read(spark, store):
    out = asof_features(make_queries(spark, ASKED), store)
    return {r.query_id: r for r in out.collect()}


def test_golden_rows(spark):
    got = read(spark, golden_store(spark))
    # Two reviews of 4 and 1 stars, the last one 27 + 31 + 30 + 2 days ago; the item has 4 and 2.
    # The user's centre is 0.1 degrees from the item. Two earlier Books and one Maps over two reviews;
    # 2 * 1 + 1 * 4; tier 3 against a mean of 2.
    first = got[1]
    assert (first.u_reviews_to_date, first.u_mean_stars_to_date, first.u_days_since_last) == (2, 2.5, 90)
    assert (first.i_reviews_to_date, first.i_mean_stars_to_date) == (2, 3.0)
    assert first.ui_distance_km == pytest.approx(11.1195, abs=1e-3)
    assert (first.ui_category_affinity, first.ui_als_score, first.ui_price_delta) == (1.5, 6.0, 1.0)
    own = got[2]  # exactly at its own event: that event is not history
    assert (own.u_reviews_to_date, own.u_mean_stars_to_date, own.u_days_since_last) == (1, 4.0, 85)
    assert (own.i_reviews_to_date, own.i_mean_stars_to_date) == (0, None)
    assert own.ui_distance_km == pytest.approx(22.2390, abs=1e-3)
    assert (own.ui_category_affinity, own.ui_als_score, own.ui_price_delta) == (1.0, 3.0, 2.0)
    cold = got[3]
    assert cold.u_reviews_to_date == 0 and cold.i_reviews_to_date == 2
    assert cold.u_mean_stars_to_date is None and cold.u_days_since_last is None
    assert cold.ui_distance_km is None and cold.ui_category_affinity is None
    assert cold.ui_als_score is None and cold.ui_price_delta is None
    unknown = got[4]
    assert unknown.ui_distance_km is None and unknown.ui_category_affinity is None
    assert unknown.ui_price_delta is None


def test_later_events_change_nothing_and_a_leak_is_caught(spark):
    queries = make_queries(spark, ASKED)
    past, full = make_events(spark, PAST), make_events(spark, PAST + FUTURE)
    then = asof_features(queries, golden_store(spark, PAST))
    now = asof_features(queries, golden_store(spark, PAST + FUTURE))
    assert changed_rows(then, now).count() == 0
    leak = changed_rows(leaky_counts(queries, past), leaky_counts(queries, full))
    assert leak.count() > 0


def test_one_value_uses_the_bulk_path(spark):
    at = datetime(2017, 10, 2)
    out = get_asof(spark, golden_store(spark), "ui_price_delta", "ana", "north", at)
    assert [r.value for r in out.collect()] == [1.0]


def test_unknown_feature_names_the_alternatives(spark):
    with pytest.raises(KeyError, match="u_reviews_to_date"):
        registry.get("nope")
    with pytest.raises(KeyError, match="user_embedding_behavioral_v1"):
        registry.get_embedding("nope")
    assert all(f.leakage.strip() for f in registry.FEATURES.values())
    assert registry.required_groups(["u_reviews_to_date"]) == {"user"}
    assert registry.online_features() == registry.feature_names()


def test_only_needed_groups_are_joined(spark):
    store = replace(golden_store(spark), item=None, user_category=None, user_als=None, item_als=None)
    out = asof_features(make_queries(spark, ASKED), store, ["u_reviews_to_date"])
    assert [r.u_reviews_to_date for r in out.orderBy("query_id").collect()] == [2, 1, 0, 2]
    with pytest.raises(ValueError, match="user_als"):
        asof_features(make_queries(spark, ASKED), store, ["ui_als_score"])


def brute_force(probes, timeline):
    found = {}
    for user, ts in probes:
        earlier = [s for u, s in timeline if u == user and s < ts]
        found[(user, ts)] = max(earlier) if earlier else None
    return found


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_asof_equals_brute_force(spark, ranges):
    """With 40 ranges a key's history is cut several times, and some ranges hold no state."""
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5 if ranges == 7 else 10000)
    try:
        check_asof(spark)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def check_asof(spark):
    events, dim = random_events(spark, 400), random_dim(spark)
    state = user_state(events, dim)
    probes = events.select("user_id", "ts").union(
        events.select("user_id", (F.col("ts") + F.expr("INTERVAL 40 DAYS")).alias("ts"))
    )
    got = asof_times(probes, state, ["user_id"]).collect()
    wanted = brute_force(
        {(r.user_id, r.ts) for r in probes.collect()},
        [(r.user_id, r.ts) for r in state.select("user_id", "ts").collect()],
    )
    assert {(r.user_id, r.ts): r.state_ts for r in got} == wanted
    assert len(got) == len(wanted)


def test_inner_asof_drops_unmatched(spark):
    store = golden_store(spark)
    queries = make_queries(spark, ASKED)
    left = asof_join(queries, store.user, ["user_id"], ["cum_count"])
    inner = asof_join(queries, store.user, ["user_id"], ["cum_count"], "inner")
    assert left.count() == 4
    assert rows(inner, "query_id") == [(1,), (2,), (4,)]


def embedding_of(spark, *users):
    return spark.createDataFrame([(u, [0.5] * 64) for u in users], "user_id string, value array<float>")


def test_snapshot_round_trip_and_refusals(spark, tmp_path):
    root = str(tmp_path / "online")
    with pytest.raises(snapshot.SnapshotUnavailable):
        snapshot.active_generation(spark, root)
    store, events = golden_store(spark), make_events(spark, PAST)
    snapshot.publish(root, store, events, generation="one")
    row = snapshot.manifest(spark, root).first()
    assert (row["users"], row["items"], row["businesses"], row["user_reviewed"]) == (2, 2, 3, 2)
    assert row["as_of"] == datetime(2017, 7, 4, 0, 0, 0, 1)
    pinned = snapshot.open_snapshot(spark, root)
    current = replace(pinned.store, vector_width=3)
    assert rows(pinned.reviewed) == [("ana", "north"), ("ana", "south"), ("ben", "north")]
    with pytest.raises(snapshot.SnapshotUnavailable, match="publish again"):
        pinned.embedding()
    pairs = make_queries(spark, ASKED).select("user_id", "business_id").distinct()
    at = snapshot.as_of(store)
    clean = snapshot.skew_summary(pairs, store, current, at, F.lit(row["as_of"]).cast("timestamp_ntz"))
    assert clean.first().asDict() == {
        "sampled_pairs": 4, "compared_values": 36, "mismatches": 0, "same_instant": True}
    wrong = replace(
        current, item=current.item.withColumn("cum_sum", F.col("cum_sum") + F.when(F.col("business_id") == "south", 1).otherwise(0))
    )
    offline, online = snapshot.compared_reads(pairs, store, wrong, at, at)
    bad = snapshot.skew_mismatches(offline, online)
    assert {(r.query_id, r.feature) for r in bad.collect()} == {("ana|south", "i_mean_stars_to_date")}
    # A failed publication is never seen, leaves nothing behind and may be repeated.
    broken = replace(store, user=store.user.withColumn("cum_sum", F.raise_error(F.lit("boom")).cast("bigint")))
    with pytest.raises(Exception, match="boom"):
        snapshot.publish(root, broken, events, generation="two")
    assert snapshot.active_generation(spark, root) == "one" and not (tmp_path / "online" / "gen=two").exists()
    # A name that exists is refused, and what it names stays as it is.
    with pytest.raises(ValueError, match="exists"):
        snapshot.publish(root, store, events, generation="one")
    assert pinned.reviewed.count() == 3
    snapshot.publish(root, store, events, generation="two")
    assert snapshot.active_generation(spark, root) == "two"
    newer = snapshot.generations(spark, root).filter("generation = 'two'").withColumn("version", F.lit(3).cast("bigint"))
    newer.withColumn("generation", F.lit("other layout")).withColumn("schema_version", F.lit(6)).coalesce(1).write.mode(
        "append").parquet(f"{root}/generations")
    with pytest.raises(snapshot.SnapshotUnavailable, match="layout"):
        snapshot.manifest(spark, root)
    assert snapshot.manifest(spark, root, "two").count() == 1


def test_readers_keep_the_generation_that_they_pinned(spark, tmp_path):
    root = str(tmp_path / "online")
    store, events = golden_store(spark), make_events(spark, PAST)
    snapshot.publish(root, store, events, embedding_of(spark, "ana"), generation="old")
    pinned = snapshot.open_snapshot(spark, root)
    later = golden_store(spark, PAST + FUTURE)
    snapshot.publish(root, later, make_events(spark, PAST + FUTURE), embedding_of(spark, "ana", "ben"), generation="new")
    assert snapshot.active_generation(spark, root) == "new"
    assert (pinned.generation, rows(pinned.embedding(), "user_id")) == ("old", [("ana",)])
    assert rows(snapshot.open_snapshot(spark, root).embedding(), "user_id") == [("ana",), ("ben",)]
    assert rows(snapshot.open_snapshot(spark, root, "old").reviewed) == rows(pinned.reviewed)
    # Nothing is retired within the grace; then all but the active one, for good.
    assert snapshot.retire(spark, root) == []
    due = datetime(2100, 1, 1)
    assert snapshot.retire(spark, root, now=due) == ["old"] and snapshot.retire(spark, root, now=due) == []
    assert not (tmp_path / "online" / "gen=old").exists()
    with pytest.raises(snapshot.SnapshotUnavailable, match="retired"):
        snapshot.open_snapshot(spark, root, "old")
    with pytest.raises(ValueError, match="exists"):
        snapshot.publish(root, store, events, generation="old")
    assert snapshot.open_snapshot(spark, root).reviewed.count() > 3


@pytest.mark.parametrize("vector", [None, [1.0, None, 2.0], [1.0, 2.0]])
def test_broken_vectors_are_not_published(spark, tmp_path, vector):
    root = str(tmp_path / "online")
    store, events = golden_store(spark), make_events(spark, PAST)
    odd = spark.createDataFrame([("east", datetime(2017, 1, 1), vector)], store.item_als.schema)
    with pytest.raises(ValueError, match="item_als is unusable"):
        snapshot.publish(root, replace(store, item_als=store.item_als.unionByName(odd)), events)
    with pytest.raises(snapshot.SnapshotUnavailable):
        snapshot.active_generation(spark, root)


def test_skew_check_reads_the_publication(spark, tmp_path):
    root = str(tmp_path / "online")
    events = make_events(spark, PAST + FUTURE)
    store = golden_store(spark, PAST + FUTURE)
    vectors = embedding_of(spark, "ana", "ben")
    pairs = events.select("user_id", "business_id").distinct()
    snapshot.publish(root, store, events, vectors, generation="fresh")
    stale = golden_store(spark, PAST)
    lacks = vectors.filter("user_id = 'ana'")
    snapshot.publish(root, stale, make_events(spark, PAST), lacks, generation="stale")
    clean, late = (
        snapshot.check_skew(spark, root, pairs, store, vectors, generation=g).first().asDict() for g in ("fresh", "stale")
    )
    n = pairs.count()
    assert clean == {"generation": "fresh", "sampled_pairs": n, "compared_values": 9 * n + 128, "mismatches": 0,
                     "embedding_mismatches": 0, "same_instant": True, "passed": True}
    assert late["mismatches"] > 0 and late["embedding_mismatches"] == 64
    assert not late["same_instant"] and not late["passed"]


def test_embedding_width_and_cold_users(spark):
    users = spark.createDataFrame([("u1",), ("u2",)], "user_id string")
    good = spark.createDataFrame([("u1", [0.5] * 64)], "user_id string, value array<float>")
    found = snapshot.embedding_lookup(users, good, "user_embedding_behavioral_v1")
    assert {r.user_id: r.value is None for r in found.collect()} == {"u1": False, "u2": True}
    bad = spark.createDataFrame([("u1", [0.5] * 3)], "user_id string, value array<float>")
    with pytest.raises(Exception, match="vector width"):
        snapshot.embedding_lookup(users, bad, "user_embedding_behavioral_v1").collect()
    changed = good.withColumn("value", F.transform("value", lambda x, i: F.when(i == 7, 9.0).otherwise(x).cast("float")))
    assert rows(snapshot.embedding_mismatches(good, changed), "user_id", "position") == [("u1", 7)]


def test_vector_integrity_counts_what_is_absent(spark):
    data = [("a", [1.0, 2.0]), ("b", [1.0, None]), ("c", None), ("d", [1.0])]
    table = spark.createDataFrame(data, "user_id string, value array<float>")
    assert rows(snapshot.vector_integrity({"user_als": table})) == [("user_als", 4, 1, 1, 2)]


def test_sampling_is_repeatable_and_cycles(spark):
    ids = spark.createDataFrame([(f"u{i}",) for i in range(5)], "user_id string")
    first = rows(snapshot.hash_sample(ids, "user_id", 12), "position", "user_id")
    again = rows(snapshot.hash_sample(ids.repartition(3), "user_id", 12), "position", "user_id")
    assert first == again and len(first) == 12 and len({u for _, u in first}) == 5
    items = ids.withColumnRenamed("user_id", "business_id")
    assert snapshot.sample_pairs(ids, items, 3).count() == 3


def test_current_read_equals_asof_now(spark):
    store = golden_store(spark, PAST + FUTURE)
    at = datetime(2020, 1, 1)
    pairs = make_queries(spark, ASKED)
    left = asof_features(pairs.withColumn("ts", F.lit(at).cast("timestamp_ntz")), store)
    right = current_features(pairs.drop("ts"), current_store(store), at)
    assert rows(left.select(*right.columns)) == rows(right)
    assert make_dim(spark, PLACES).count() == 3
