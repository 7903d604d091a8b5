"""Wall time of the headline queries; prints one JSON line.

Each query runs once to warm up, then up to three times; the median counts.
Results go to Spark's ``noop`` sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ringwarden.plans.catalog import CATALOG  # noqa: E402
from ringwarden.session import build_session  # noqa: E402

HEADLINE = [
    "txn_scan", "edge_features", "tabular_features", "temporal_features", "edge_collapse", "degree",
    "pagerank", "k_core", "clustering_coefficient", "feature_matrix", "champion_score", "counterfactual", "alert_queue",
    "identifier_components", "ring_report", "ring_eval", "hetero_edges", "neighbor_topk_cap",
    "rolling_velocity", "multi_velocity", "nearline_asof_score", "evaluate_model", "psi_features", "gcn_propagate", "chebyshev_filter",
]
SLOW_SECONDS = 8.0


def timed(run, spark, folder) -> float:
    start = time.perf_counter()
    run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run = CATALOG[name].run
        first = timed(run, spark, folder)
        repeats = 1 if first > SLOW_SECONDS else 3
        times[name] = round(statistics.median(timed(run, spark, folder) for _ in range(repeats)), 3)
        print(f"{name}: {times[name]} (first {first:.2f})", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
