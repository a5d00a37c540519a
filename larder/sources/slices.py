"""A consistent slice of the warehouse: some stores, some days, every table cut the same way."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.ordered import top_per_group

BY_DAY = [
    "fct_order", "fct_order_item", "fct_inventory_movement", "fct_availability_hour", "fct_clickstream", "agg_store_sku_day", "mart_order_daily",
]
BY_STORE = ["mart_expiry_risk", "rec_markdown", "rec_deal_slot", "rec_purchase_order"]
WHOLE = [
    "dim_product", "dim_product_snapshot", "dim_date", "dim_dte_band", "dim_promotion", "dim_supplier", "agg_intraday_arrival_curve",
    "dq_source_coverage", "mart_price_elasticity", "mart_cohort_retention",
]


def pick_stores(stores: DataFrame, orders: DataFrame, n: int) -> DataFrame:
    """The busiest store of every tier, then the next busiest of every tier, until ``n``."""
    busy = orders.groupBy("store_id").agg(F.count("*").alias("orders"))
    ranked = top_per_group(
        stores.select("store_id", "catchment_tier").join(busy, "store_id"), ["catchment_tier"],
        [F.desc("orders"), F.asc("store_id")], n, "rank_in_tier",
    )
    return ranked.orderBy("rank_in_tier", F.desc("orders"), "store_id").limit(n)


def slice_tables(wh, stores: DataFrame, start: date, end: date, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """Each table under its own rule: by day, by interval overlap, by key, or whole."""
    chosen = stores.select("store_id").distinct()
    first, last = F.lit(start), F.lit(end)

    def in_stores(df: DataFrame, column: str = "store_id") -> DataFrame:
        return df.join(chosen.withColumnRenamed("store_id", column), column, "left_semi")

    def overlapping(df: DataFrame, begins: str, ends: str) -> DataFrame:
        return df.filter((F.col(begins) <= last) & (F.col(ends) > first))

    rules = {name: lambda t, name=name: in_stores(wh(t)).filter(F.col("date_day").between(first, last)) for name in BY_DAY}
    rules |= {name: lambda t: in_stores(wh(t)) for name in BY_STORE}
    rules |= {name: wh for name in WHOLE}
    rules |= {
        "dim_store": lambda t: in_stores(wh(t)),
        "fct_price_history": lambda t: overlapping(in_stores(wh(t)), "effective_from_date", "effective_to_date"),
        "fct_inventory_batch": lambda t: overlapping(in_stores(wh(t)), "received_date", "expiry_date"),
        "dim_customer": lambda t: in_stores(wh(t), "home_store_id"),
        "mart_customer_360": lambda t: in_stores(wh(t)),
        "mart_forecast_accuracy": lambda t: in_stores(wh(t)).filter(F.col("date_day").between(first, last)),
        "mart_demand_forecast": lambda t: in_stores(wh(t)).filter(F.col("date_day").between(first, last)),
        "rec_transfer_order": lambda t: in_stores(in_stores(wh(t), "from_store"), "to_store"),
    }
    return {name: rules[name](name) for name in tables or rules}
