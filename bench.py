"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from millrace.plans import catalog
from millrace.session import local_session

HEADLINE = (
    "ingest_events",
    "event_profile",
    "popularity_rank",
    "user_state",
    "item_state",
    "user_category_state",
    "asof_join",
    "asof_features",
    "current_features",
    "interactions",
    "index_ids",
    "exact_topk",
    "sample_negatives",
    "training_set",
    "score_shared_pool",
    "rerank_ablation",
    "recommend_batch",
    "evaluate",
    "marginal_hits",
    "slo_report",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = local_session(cores, shuffle_partitions=cores, memory="16g")
    # One untimed query starts the JVM's and the readers' machinery.
    catalog.QUERIES["popularity_pool"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "funnel_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
