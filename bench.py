"""Time the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "silver_dedup", "episodes", "anomaly_flag", "subtask_median_mad", "episode_boundaries",
    "bpm_context", "activity_interval_join", "cross_station_pairs", "range_count", "golden_set",
    "text_vectors", "knn_topk", "knn_filtered", "ann_partitioned", "ann_trained", "retrieve_filtered",
    "retrieval_ablation", "bm25_corpus_stats", "bm25_score", "rrf_fuse", "report_rows",
    "metrics_report", "bootstrap_ci", "paired_bootstrap", "foreign_context", "stream_silver",
    "statistic_bootstrap", "metric_compare", "perturb_report", "rank_changes",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from millrace.plans import fixtures
    from millrace.plans.registry import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES")
    names = names.split(",") if names else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    start = time.time()
    fixtures.gold(spark, sf_dir)  # the stored episode table that most queries read
    times["gold_table"] = round(time.time() - start, 3)
    # the stored indexes that retrieval queries read; queries on them, as on the episode table, time none of their making
    for name in ("index_store", "hit_texts", "document_texts", "list_index"):
        start = time.time()
        getattr(fixtures, name)(spark, sf_dir)
        times[name] = round(time.time() - start, 3)
    for name in names:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
