"""Raw feeds: a declared schema each, read from and appended to arrival-day partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared rather than inferred: day-one files hold all-null columns whose type cannot be guessed.
FEED_COLUMNS = {
    "pos_orders": "order_id string, store_id string, customer_id string, order_ts timestamp_ntz, promised_ts timestamp_ntz, "
    "delivered_ts timestamp_ntz, is_late boolean, payment_mode string, n_units bigint",
    "pos_order_items": "order_id string, sku_id string, batch_id string, qty int, unit_base_price double, unit_realized_price double, "
    "discount_amt double, unit_cogs double, dte_at_sale int, promo_id string, is_substitution boolean",
    "pos_returns": "order_id string, sku_id string, batch_id string, qty int, reason string, return_date date",
    "wms_inventory_batch": "batch_id string, sku_id string, store_id string, supplier_id string, po_id string, qty_received bigint, "
    "unit_landed_cost double, usable_days int, mfg_date date, received_date date, expiry_date date",
    "wms_inventory_movement": "movement_seq bigint, batch_id string, event_type string, qty_delta bigint, event_date date",
    "wms_purchase_orders": "po_id string, store_id string, sku_id string, supplier_id string, ordered_qty bigint, received_qty bigint, "
    "inbound_freshness_pct double, ordered_date date, expected_date date, received_date date, is_short boolean, is_late boolean",
    "wms_stockout_interval": "store_id string, sku_id string, event_date date, hour_out int",
    "catalog_snapshot": "sku_id string, sku_name string, brand string, is_private_label boolean, l1_category string, l2_subcategory string, "
    "temp_zone string, uom string, pack_qty double, shelf_life_days int, mrp double, base_price double, landed_cost double, gst_rate double, "
    "deal_eligible boolean, snapshot_date date",
    "price_history": "store_id string, sku_id string, effective_date date, base_price double, realized_price double, promo_id string",
    "clickstream": "store_id string, sku_id string, event_type string, was_in_stock boolean, event_ts_utc timestamp_ntz, event_date date",
    "customer_snapshot": "customer_id string, home_store_id string, acquisition_channel string, device string, is_member boolean, "
    "signup_date date, churn_date date",
    "ref_stores": "store_id string, store_name string, locality string, pincode string, catchment_tier string, lat double, lon double, "
    "demand_index double, serviceable_radius_km double, chilled_capacity_units int, ambient_capacity_units int, frozen_capacity_units int, "
    "daily_operating_hours int, category_affinity map<string,double>, opened_date date",
    "ref_suppliers": "supplier_id string, supplier_name string, categories string, lead_time_mean_days double, lead_time_sd_days double, "
    "otif_rate double, monsoon_otif_penalty double, inbound_freshness_pct array<double>, cost_index double, private_label_only boolean",
}
# Written as one file, without arrival partitions.
FILE_COLUMNS = {
    "crm_deal_exposure": "customer_id string, deal_arm string, assigned_date date, holdout_share double",
    "deal_readout": "page string, metric string, label string, value double, ci_low double, ci_high double, unit string, source string, note string",
    "experiment_readout": "metric string, unit string, policy_a double, policy_b double, delta double, ci_low double, ci_high double, "
    "significant boolean, seeds bigint, not_applicable_reason string",
}


def feed_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(FEED_COLUMNS[name] + ", dt date")


def read_feed(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A partitioned feed under its declared schema; a column some files lack is null there."""
    path = f"{root}/{name}"
    return spark.read.schema(feed_schema(name)).option("basePath", path).parquet(path)


def read_feed_merged(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The same feed with the union of the files' own schemas, for feeds nobody declared."""
    path = f"{root}/{name}"
    return spark.read.option("basePath", path).option("mergeSchema", True).parquet(path)


def read_file(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(FILE_COLUMNS[name]).parquet(path)


def read_feeds(spark: SparkSession, root: str):
    """``feed(name)`` over a folder of feeds, as the warehouse wants it."""

    def feed(name: str) -> DataFrame:
        if name in FILE_COLUMNS:
            return read_file(spark, f"{root}/{name}.parquet", name)
        return read_feed(spark, root, name)

    return feed


def append_feed(df: DataFrame, root: str, name: str) -> None:
    """Append rows to their ``dt=`` folders; a day larger than the advisory partition size goes to several tasks."""
    df.hint("rebalance", "dt").write.partitionBy("dt").mode("append").parquet(f"{root}/{name}")
