"""Benchmark the headline keys.

Runs each key on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``: one warm-up, then the median of ``$BENCH_REPS`` (3)
timed runs. A run executes the whole plan into Spark's ``noop`` sink, so
nothing is collected to the driver. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "sales_daily", "sales_by_seller", "sales_detail", "sales_day_lines", "challan_document",
    "stock_levels", "product_stock_status", "stock_running_balance", "latest_movements_per_product",
    "stock_reconciliation", "challan_list", "challan_search", "challan_page", "challan_export",
    "customer_timeline", "customer_query_threads", "stock_requests_list", "dashboard_metrics",
    "alerts_merge", "inbox", "dq_customers", "dq_orphans", "dq_unique", "challan_item_snapshot",
    "challan_numbers", "confirm_drafts", "apply_adjustments", "stream_stock_levels", "rate_violations",
]


def main() -> None:
    from ledgerloom.plans.registry import queries
    from ledgerloom.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    reps = int(os.environ.get("BENCH_REPS", "3"))
    keys = [k for k in os.environ.get("BENCH_KEYS", "").split(",") if k] or HEADLINE
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE", "16")))
    qs = queries()
    times: dict[str, float] = {}
    for key in keys:
        def once() -> float:
            t0 = time.perf_counter()
            qs[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0
        try:
            once()  # warm-up
            times[key] = round(statistics.median(once() for _ in range(reps)), 3)
        except Exception as e:  # noqa: BLE001 — record and continue
            print(f"{key} failed: {e}", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "sum_of_median_wall_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus),
           "spark": spark.version, "reps": reps}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
