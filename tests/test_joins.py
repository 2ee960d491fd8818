"""Tables that grow with the input are merged, however small their files look."""

from __future__ import annotations

import pytest

from millrace.operators import evaluation, interactions, state
from millrace.operators.features import current_features, store_before
from millrace.schema import SPLIT_T
from millrace.sources import tables

SF = "/root/testdata/sf0.001"


def _inputs(spark):
    return tables.events(spark, SF), tables.dim(spark, SF)


def _current(spark):
    events, dim = _inputs(spark)
    store = store_before(events, dim, SPLIT_T, tables.user_vectors(spark, SF), tables.item_vectors(spark, SF))
    return current_features(events.select("user_id", "business_id").distinct(), store, SPLIT_T)


PLANS = {
    "events": lambda spark: tables.events(spark, SF),
    "raw reviews": lambda spark: tables.raw_reviews(spark, SF),
    "user": lambda spark: state.user_state(*_inputs(spark)),
    "user_category": lambda spark: state.user_category_state(*_inputs(spark)),
    "interactions": lambda spark: interactions.interactions(*_inputs(spark), SPLIT_T),
    "holdout": lambda spark: evaluation.holdout(*_inputs(spark), SPLIT_T),
    "current": _current,
}


@pytest.mark.parametrize("name", PLANS)
def test_no_growing_table_is_sent_to_every_task(spark, name):
    plan = PLANS[name](spark)._jdf.queryExecution().executedPlan().toString()
    sent = [line.strip() for line in plan.splitlines() if "BroadcastHashJoin" in line]
    # Only the keys with too many rows for one task are sent: a bounded list, on the left anti and
    # left semi sides of the running totals.
    hot = [line for line in sent if "[user_id" in line and ("LeftAnti" in line or "LeftSemi" in line)]
    assert "SortMergeJoin" in plan
    assert sent == (hot if name in ("user", "user_category") else [])
