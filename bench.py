"""Headline queries, timed: prints one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "len_stats_linear", "len_stats_floor", "split_stratified", "dist_by_split", "ingest_errors", "usage_totals",
    "row_verdict", "project_prune", "validate_enum_const", "flatten_leaves", "leaf_f1_counts", "micro_f1",
    "path_accuracy_total", "worst_k", "diffs_by_path", "wide_projection",
)


def main() -> None:
    from marginalia.catalog import all_queries
    from marginalia.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "20g",
           "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    # start-up and class loading are not part of any query
    spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy("toxic").count().collect()
    seconds = {}
    for name in names:
        started = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
