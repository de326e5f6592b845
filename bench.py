"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR is the folder of parquet tables, BENCH_CPUS the number of local cores. Every
query runs to the end over its whole tables; the rows go to Spark's `noop` sink. The first runs
(`queries`) hold compile time, the second ones (`warm_queries`) do not.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from demandloom.plans.star_queries import QUERIES
from demandloom.session import get_session

HEADLINE = [
    "daily_demand", "location_fallback", "daily_demand_repeated_signals", "sales_with_signals", "signals_filled",
    "baseline_forecast", "requested_forecast", "holdout_split", "naive_scores", "model_select",
    "auto_forecast", "auto_forecast_parts", "auto_metrics", "auto_plan", "supply_plan", "plan_kpis",
    "scenario_base_plan", "scenario_narrative", "drivers_by_sku", "signal_summary", "top_skus", "demand_pivot", "demand_long", "fallback_forecast",
    "naive_mape", "guess_columns", "dataset_kind", "column_roles", "harmonized_sales", "published_events",
]


def run(spark, name: str, folder: str) -> float:
    began = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = get_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM's and the Python workers' engines before timing.
    run(spark, "auto_metrics", folder)
    names = sys.argv[1:] or HEADLINE
    times = {name: run(spark, name, folder) for name in names}
    warm = {name: run(spark, name, folder) for name in names}
    found = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "warm_value": round(sum(warm.values()), 3),
                "warm_queries": warm,
                "sf": float(found.group(1)) if found else None,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
