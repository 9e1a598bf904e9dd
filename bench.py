"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidelog import plans
from tidelog.plans import search

HEADLINE = (
    "hybrid_recall", "bm25_search", "vector_search", "filtered_vector_search", "adjusted_relevance", "events_in_range", "sampled_events_between",
    "episode_segmentation", "session_split", "segments", "day_breakdown", "focus_blocks", "app_switches", "newest_screenshot_as_of", "counts_in_segment",
    "near_in_time_pairs", "claims_as_of", "claim_supersessions", "episode_consolidation", "picture_thinning", "retrieval_scores", "stats",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = plans.queries(), {}
    queries["stats"](spark, sf_dir).collect()  # starts the executor threads and code generation
    began = time.perf_counter()
    search.index(spark, sf_dir)  # built once for a table, then stored
    seconds["index_build"] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
