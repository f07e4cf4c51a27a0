"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion with the ``noop`` sink (no driver
collection).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "risk_scoring", "clean_loans", "overdue_pattern", "woe_apply", "geo_risk", "target_encoding",
    "client_history", "client_history_asof", "split_chronological", "split_stratified", "threshold_search",
    "auc", "model_comparison", "prediction_summary", "client_quantile_bins", "stream_overdue_features",
    "stream_scoring", "knn_impute", "knn_impute_columns", "smote",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    from obol.session import local_session
    from obol.plans.queries import QUERIES
    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus.isdigit() else 16, app="obol-bench")
    # warm the JVM (class loading, codegen caches) outside the timings
    QUERIES["label_m1"](spark, sf_dir).write.mode("overwrite").format("noop").save()
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.mode("overwrite").format("noop").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
