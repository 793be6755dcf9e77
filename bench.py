"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from assayer.plans.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "run_and_category_summary",
    "run_summary",
    "error_list",
    "benchmark_summary",
    "validated_responses",
    "baseline_comparison",
    "variant_paired_deltas",
    "ab_win_rate",
    "quality_delta",
    "latency_percentiles_by_run",
    "judge_scores",
    "daily_ranking",
    "route_attributes",
    "platform_stats_by_team",
    "rule_http_request_rate",
    "rule_http_error_ratio",
    "rule_http_latency_p95",
    "rule_variant_tokens_per_second",
    "overview_queue_depth",
    "in_flight_requests",
    "service_edges",
    "logs_with_traces",
    "formatted_error_lines",
    "deduplicated_prompts",
    "quota_split",
    "content_digests",
    "stream_sliding_requests",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(HEADLINE[0])  # starts the JVM's compilers; not timed
    seconds = {name: round(run(name), 3) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
