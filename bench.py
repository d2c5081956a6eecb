"""Benchmark the headline queries; print ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3; the median is reported after one warm-up run).

Each run executes the query's full plan into Spark's ``noop`` sink, so every
row is computed but nothing is shipped to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from salesops.registry import REGISTRY  # noqa: E402
from salesops.session import build_session  # noqa: E402

HEADLINE = [
    "revenue_trend_month",
    "payment_vs_category",
    "order_volume",
    "top_selling_items",
    "market_basket",
    "day_wise_pattern",
    "is_business_query",
    "debounce_scans",
    "chart_totals",
    "validation_report",
    "record_sales",
    "inventory_conflicts",
    "stream_sales",
]


def run_once(spark, name: str, sf_dir: str) -> float:
    fn, _ = REGISTRY[name]
    t0 = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "salesops-bench",
        master=f"local[{cpus}]",
        shuffle_partitions=cpus,
        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")},
    )
    results = {}
    for name in names:
        run_once(spark, name, sf_dir)  # warm-up
        results[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(runs)), 4)
    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "sum of median query seconds",
                "value": round(sum(results.values()), 4),
                "unit": "sec",
                "queries": results,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
                "runs": runs,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
