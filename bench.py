"""Seconds of the headline queries, after a warm-up: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from wakeline.plans import registry  # noqa: E402

HEADLINE = (
    "topology_edges", "topology_nodes", "edge_series", "channel_graph", "co_access", "transmission_states", "thread_prefix",
    "seen_elsewhere", "winnow_fingerprints", "copied_runs", "text_search", "hybrid_search", "ctfidf_terms", "topic_assign",
    "alert_triage", "detection_quality", "postings_lookup", "output_segments", "action_effects", "stream_correlator",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = {n: registry.QUERIES[n] for n in HEADLINE}
    try:
        from wakeline.llm.queries import QUERIES as llm
    except ModuleNotFoundError:
        llm = {}
    chosen |= llm
    # Start-up of the session, its code and Python workers is no query's.
    for name in ("topology_nodes", "shingle_df"):
        registry.QUERIES[name](spark, sf_dir.replace("sf0.1", "sf0.001")).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, query in chosen.items():
        began = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
