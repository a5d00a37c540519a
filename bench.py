"""Headline queries at one scale: prints one JSON line.

``BENCH_SF_DIR`` names the folder of given tables, ``BENCH_CPUS`` the local threads. Every query is
timed to its last row through the ``noop`` sink. Tables that several queries read are written by
the first one that needs them and timed there, as a warehouse build would; ``build`` is the sum of
those first uses.
"""

from __future__ import annotations

import json
import os
import time
import warnings

HEADLINE = [
    "stg_pos__orders", "stg_pos__order_lines", "dim_product", "dim_product_snapshot", "fct_order_item", "fct_order",
    "fct_inventory_movement", "fct_inventory_batch", "fct_availability_hour", "fct_price_history", "agg_intraday_arrival_curve",
    "agg_store_sku_day", "mart_order_daily", "mart_customer_360", "mart_cohort_retention", "dq_source_coverage",
    "q01_running_inventory_balance", "q02_fefo_allocation", "q03_cohort_retention_pivot", "q04_browse_bursts", "q05_stockout_runs",
    "q06_market_basket", "q07_abc_xyz", "q08_month_over_month", "q09_availability_funnel", "q10_top_n_per_store", "q11_current_price",
    "q12_point_in_time_margin", "q14_naive_promotion_lift", "q15_inventory_reconciliation", "metric_gm_awm", "metric_fill_rate",
    "metric_retention_90d", "n02_backtest", "n04_feature_frame", "n10_expiry_risk", "n12_elasticity_panel", "n17_markdown_grid",
    "n24_deal_slots", "n27_shelf_life_gate", "n33_itt_effects", "n35_event_summary", "n36_retention_effects", "n38_uplift_panel",
    "n20_elastic_plan", "n28_transfer_bound", "n42_qini", "n45_did_estimate", "g_raw_gate_figures", "n52_headline",
]


def session(cpus: str):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("larder-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )


def main() -> None:
    from suite.registry import all_queries

    warnings.simplefilter("ignore")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    registered = all_queries()
    only = os.environ.get("BENCH_ONLY")
    names = only.split(",") if only else HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        registered[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "retail warehouse and showcase, total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
