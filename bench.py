"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
local threads. Every query runs to its end into a sink that discards the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "trends_by_category",
    "trends_totals",
    "trends_timeseries_weekly",
    "category_summary",
    "top_keywords",
    "kpis",
    "pareto",
    "local_insights",
    "import_and_score",
    "normalise_products",
    "upsert_products",
    "filter_products",
    "low_quality_text",
    "serve_products",
    "latest_score",
    "extract_pages",
    "export_table",
    "export_analysis",
    "winner_score",
    "metric_score",
    "pct_rank",
    "exact_quantiles",
    "apportion",
    "classify_terciles",
    "enforce_min_shares",
    "demand_baseline",
    "name_similarity",
    "competition_baseline",
    "profile_metrics",
    "weights_from_profile",
    "weights_by_correlation",
    "cache_lookup",
    "propagate_variants",
    "plan_batches",
    "budget_admission",
    "apply_results",
    "validate_responses",
    "normalise_responses",
    "failure_summary",
    "stream_ingest",
    "stream_import",
    "stream_trends_daily",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")

    from merchlens.plans import QUERIES
    from merchlens.session import build_session

    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    run(HEADLINE[0])  # start-up of the JVM and the Python gateway is not a query's cost
    times, failed = {}, []
    for name in HEADLINE:
        try:
            times[name] = round(run(name), 3)
        except Exception as exc:  # a broken query must not hide the others
            failed.append(name)
            print(f"{name}: {exc}", file=sys.stderr)
    result = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": folder.rsplit("sf", 1)[-1],
    }
    if failed:
        result["failed"] = failed
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
