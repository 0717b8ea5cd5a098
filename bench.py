"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the cores.
Every query is run twice: the first run, with class loading and code generation in it, is printed
under "cold", the second one under "queries". Their sum over the second runs is the headline value.
Queries that fit boosted trees at their full rounds take minutes and are run once.
"""

from __future__ import annotations

import json
import os
import time

from checks.compare import local_session
from checks.queries import queries
from salesops.plans.lineage import release

HEADLINE = [
    "sales_summary",
    "region_summary",
    "monthly_trend",
    "top_products",
    "sales_summary_stats",
    "price_change_mom",
    "rolling_qty",
    "sales_distribution",
    "sales_value_counts",
    "time_coverage",
    "price_qty_corr",
    "product_value_counts",
    "text_quality_documents",
    "market_tree",
    "hierarchy_orphans",
    "hierarchy_closure",
    "scope_series_territory",
    "training_features",
    "trend_forecast",
    "forecast_views",
    "evaluate_trend",
    "compare_models",
    "sequence_forecast",
]
TREES = ["trees_a_forecast", "trees_b_forecast", "evaluate_trees_a", "evaluate_trees_b", "compare_stored_models"]


def seconds(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    timings, cold = {}, {}
    for name in HEADLINE + TREES:
        cold[name] = round(seconds(known[name], spark, folder), 3)
        timings[name] = cold[name] if name in TREES else round(seconds(known[name], spark, folder), 3)
        release(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "cold": cold,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
