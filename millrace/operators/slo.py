"""Latency report over a request log."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.evaluation import percentile_nearest_rank

# Budgets in milliseconds and the sample size below which p99 is noise.
STAGE_BUDGET_MS = {
    "retrieval_ms": 10.0,
    "feature_lookup_ms": 30.0,
    "ranking_ms": 15.0,
    "rerank_ms": 8.0,
    "overhead_ms": 5.0,
}
CONTRACT_MS = 100.0
CONTRACT_CLOCKS = ("total_ms", "server_ms")
MIN_SAMPLES = 1_000
PERCENTILES = (50.0, 95.0, 99.0)


def derived_clocks(samples: DataFrame) -> DataFrame:
    """samples (request_id, clock, value) plus the gaps between clocks.

    framework = server - total, transport = client - server, floored at zero, and only
    where both clocks of a request are present.
    """

    def reading(clock: str):
        return F.max(F.when(F.col("clock") == clock, F.col("value")))

    wide = samples.groupBy("request_id").agg(
        reading("total_ms").alias("total"),
        reading("server_ms").alias("server"),
        reading("client_wall_ms").alias("client"),
    )
    pairs = {"framework_ms": ("server", "total"), "transport_ms": ("client", "server")}
    cells = [
        F.struct(
            F.lit(name).alias("clock"),
            F.greatest(F.lit(0.0), F.col(outer) - F.col(inner)).alias("value"),
            (F.col(outer).isNotNull() & F.col(inner).isNotNull()).alias("_have"),
        )
        for name, (outer, inner) in pairs.items()
    ]
    gaps = wide.select("request_id", F.inline(F.array(*cells))).filter("_have")
    return samples.select("request_id", "clock", "value").unionByName(gaps.drop("_have"))


def slo_report(
    samples: DataFrame, budgets: Mapping[str, float] = STAGE_BUDGET_MS
) -> DataFrame:
    """(clock, samples, p50, p95, p99, budget_ms, over_budget, verdict) per clock.

    PASS / MISS compares p99 with the budget; SHORT means too few samples to say, NONE
    that the clock has no budget.
    """
    limits = {**budgets, **{c: CONTRACT_MS for c in CONTRACT_CLOCKS}}
    budget = reduce(
        lambda acc, kv: acc.when(F.col("clock") == kv[0], F.lit(kv[1])), limits.items(), F
    )
    readings = derived_clocks(samples).withColumn("budget_ms", budget)
    totals = readings.groupBy("clock", "budget_ms").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("value") > F.col("budget_ms")).alias("over_budget"),
    )
    points = percentile_nearest_rank(readings, ["clock"], "value", PERCENTILES)
    wide = points.groupBy("clock").agg(
        *[
            F.max(F.when(F.col("percentile") == p, F.col("value"))).alias(f"p{p:.0f}")
            for p in PERCENTILES
        ]
    )
    verdict = (
        F.when(F.col("budget_ms").isNull(), "NONE")
        .when(F.col("samples") < MIN_SAMPLES, "SHORT")
        .when(F.col("p99") <= F.col("budget_ms"), "PASS")
        .otherwise("MISS")
    )
    return totals.join(wide, "clock").select(
        "clock", "samples", "p50", "p95", "p99", "budget_ms", "over_budget", verdict.alias("verdict")
    )
