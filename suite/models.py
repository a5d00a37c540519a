"""Registered queries: staging, dimensions, facts and marts, each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.ctes_feeds import FEEDS
from suite.ctes_models import MODELS
from suite.tpch import open_tpch
from suite.spec import Query, columns, shape_spark, shape_sql, with_ctes

LIBRARY = {**FEEDS, **MODELS}


def over_library(library: dict[str, str], build, cols: str, sql: str | None) -> Query:
    """A query whose Spark side takes the warehouse and whose SQL side reads a CTE library."""
    spec = columns(cols)

    def run(spark, folder):
        return shape_spark(build(open_tpch(spark, folder)), spec)

    return Query(run, spec, with_ctes(shape_sql(sql, spec), library) if sql else None)


def over_warehouse(build, cols: str, sql: str | None) -> Query:
    return over_library(LIBRARY, build, cols, sql)


#: (CTE, columns) of every table that one CTE states.
TABLES: dict[str, tuple[str, str]] = {}


def table(name: str, cte: str, cols: str) -> Query:
    TABLES[name] = cte, cols
    return over_warehouse(lambda wh: wh(name), cols, f"select * from {cte}")


def model_queries() -> dict[str, Query]:
    q = {
        "stg_pos__orders": table(
            "stg_pos__orders", "stg_orders",
            "order_id:s store_id:s customer_id:s payment_mode:s n_units:i is_late:b order_ts_ist:t promised_ts_ist:t "
            "delivered_ts_ist:t order_date_ist:d delivery_slack_minutes:i arrival_date:d arrival_lag_days:i",
        ),
        "stg_pos__order_items": table(
            "stg_pos__order_items", "stg_items",
            "order_id:s sku_id:s batch_id:s promo_id:s qty:i unit_base_price:2 unit_realized_price:2 discount_amt:2 "
            "unit_cogs:2 dte_at_sale:i is_substitution:b is_promoted:b is_return_encoded_as_negative:b arrival_date:d",
        ),
        "stg_pos__order_lines": table(
            "stg_pos__order_lines", "stg_lines",
            "order_id:s sku_id:s batch_id:s promo_id:s line_type:s source_feed:s signed_qty:i units:i unit_base_price:2 "
            "unit_realized_price:2 discount_amt:2 unit_cogs:2 dte_at_sale:i is_substitution:b is_promoted:b "
            "return_reason:s return_date:d arrival_date:d",
        ),
        "stg_pos__returns": table(
            "stg_pos__returns", "stg_returns",
            "order_id:s sku_id:s batch_id:s returned_qty:i return_reason:s return_date:d arrival_date:d",
        ),
        "stg_quarantine": over_warehouse(
            lambda wh: wh("stg_quarantine").withColumns(
                {
                    "payload_seq": F.get_json_object("payload", "$.movement_seq"),
                    "payload_reason": F.get_json_object("payload", "$.return_reason"),
                }
            ),
            "source_name:s reason_code:s record_key:s event_date:d arrival_date:d impact_units:2 payload_seq:i payload_reason:s",
            "select * from quarantine",
        ),
        "stg_catalog__products": table(
            "stg_catalog__products", "stg_products",
            "sku_id:s sku_name:s brand:s is_private_label:b l1_category:s l2_subcategory:s temp_zone:s uom:s pack_qty:2 "
            "pack_qty_was_repaired:b base_uom:s pack_size_base_units:2 shelf_life_days:i mrp:2 base_price:2 landed_cost:2 "
            "unit_margin:2 gross_margin_pct:6 gst_rate:2 deal_eligible:b snapshot_date:d arrival_date:d",
        ),
        "stg_catalog__price_history": table(
            "stg_catalog__price_history", "stg_prices",
            "store_id:s sku_id:s effective_date:d base_price:2 realized_price:2 discount_amt:2 discount_pct:6 promo_id:s "
            "is_promoted:b arrival_date:d",
        ),
        "stg_web__clickstream": table(
            "stg_web__clickstream", "stg_clicks",
            "store_id:s sku_id:s event_type:s was_in_stock:b is_censored_demand:b event_ts_ist:t event_date_ist:d "
            "event_hour_ist:i event_ts_utc:t event_date_utc:d sku_id_was_conformed:b arrival_date:d",
        ),
        "stg_wms__inventory_movements": table(
            "stg_wms__inventory_movements", "stg_moves",
            "movement_seq:i batch_id:s event_type:s qty_delta:i units:i direction:i event_date:d arrival_date:d",
        ),
        "stg_wms__inventory_batches": table(
            "stg_wms__inventory_batches", "stg_batches",
            "batch_id:s sku_id:s store_id:s supplier_id:s po_id:s qty_received:i unit_landed_cost:2 landed_cost_value:2 "
            "usable_days:i shelf_life_remaining_days:i mfg_date:d received_date:d expiry_date:d is_opening_balance:b arrival_date:d",
        ),
        "stg_wms__purchase_orders": table(
            "stg_wms__purchase_orders", "stg_purchases",
            "po_id:s store_id:s sku_id:s supplier_id:s ordered_qty:i received_qty:i fill_rate:6 shortfall_qty:i "
            "inbound_freshness_pct:4 ordered_date:d expected_date:d received_date:d lead_time_days:i days_late:i is_short:b is_late:b",
        ),
        "stg_wms__stockout_intervals": table(
            "stg_wms__stockout_intervals", "stg_stockouts",
            "store_id:s sku_id:s stockout_date:d stockout_hour_ist:i stockout_hour_ts_ist:t arrival_date:d",
        ),
        "stg_crm__customers": over_warehouse(
            lambda wh: wh("stg_crm__customers"),
            "customer_id:s home_store_id:s acquisition_channel:s device:s is_member:b signup_date:d churn_date:d snapshot_date:d",
            "select *, dt as snapshot_date from customer_snapshot",
        ),
        "stg_crm__deal_exposure": over_warehouse(
            lambda wh: wh("stg_crm__deal_exposure"),
            "customer_id:s deal_arm:s is_deal_exposed:b assigned_date:d holdout_share:2",
            "select *, deal_arm = 'exposed' as is_deal_exposed from crm_deal_exposure",
        ),
        "int_product_sales_profile": table(
            "int_product_sales_profile", "sales_profile",
            "sku_id:s net_revenue:2 net_units:i selling_days:i has_sales:b demand_cv:6 cumulative_revenue_share:5 abc_class:s xyz_class:s",
        ),
        "dim_product": table(
            "dim_product", "products",
            "sku_id:s sku_name:s brand:s is_private_label:b l1_category:s l2_subcategory:s base_uom:s pack_qty:2 "
            "pack_size_base_units:2 shelf_life_days:i base_price:2 landed_cost:2 gross_margin_pct:6 deal_eligible_flag:b abc_class:s "
            "xyz_class:s abc_xyz_class:s has_sales:b net_revenue_ltd:2 net_units_ltd:i selling_days:i demand_cv:6",
        ),
        "dim_product_snapshot": table(
            "dim_product_snapshot", "product_versions",
            "sku_id:s version_no:i valid_from_date:d valid_to_date:d last_seen_date:d is_current:b days_effective:i "
            "landed_cost:2 base_price:2 landed_cost_delta:2 base_price_delta:2",
        ),
        "dim_customer": table(
            "dim_customer", "customers",
            "customer_id:s home_store_id:s acquisition_channel:s device:s is_member:b signup_date:d signup_cohort_month:d "
            "churn_date:d is_churned:b days_to_churn:i attributes_as_of_date:d",
        ),
        "dim_date": table(
            "dim_date", "calendar",
            "date_day:d day_name:s day_of_week:i day_of_month:i week_start_date:d month_start_date:d month_name:s "
            "quarter_of_year:i calendar_year:i is_weekend:b is_salary_week:b is_month_end:b is_monsoon:b is_ipl_window:b "
            "is_festival:b festival_name:s festivals_in_progress:i",
        ),
        "dim_promotion": table(
            "dim_promotion", "promos",
            "promo_id:s promo_type:s funding_source:s contracted_depth_pct:2 observed_depth_pct:3 observed_depth_pct_min:3 "
            "observed_depth_pct_max:3 priced_store_sku_days:i first_seen_date:d last_seen_date:d was_ever_run:b",
        ),
        "dim_store": table(
            "dim_store", "stores",
            "store_id:s store_name:s locality:s pincode:s catchment_tier:s lat:4 lon:4 demand_index:4 total_capacity_units:i "
            "chilled_capacity_share:6 affinity_dairy_eggs:4 affinity_fruits_vegetables:4 affinity_ready_to_eat:4 opened_date:d",
        ),
        "dim_supplier": table(
            "dim_supplier", "suppliers",
            "supplier_id:s supplier_name:s lead_time_mean_days:2 otif_rate:4 is_private_label_only:b "
            "inbound_freshness_pct_mean:4 inbound_freshness_pct_min:4 inbound_freshness_pct_max:4 is_unknown_member:b",
        ),
        "fct_order_item": table(
            "fct_order_item", "order_item",
            "order_id:s sku_id:s batch_id:s promo_id:s store_id:s date_day:d customer_id:s order_ts_ist:t line_type:s "
            "source_feed:s signed_qty:i units:i net_revenue:2 gross_revenue:2 discount_value:2 cogs:2 gross_margin:2 "
            "dte_at_sale:i is_substitution:b is_promoted:b return_reason:s return_date:d arrival_date:d "
            "order_arrival_date:d order_arrival_lag_days:i",
        ),
        "fct_order": table(
            "fct_order", "order_fact",
            "order_id:s store_id:s customer_id:s date_day:d order_ts_ist:t delivery_slack_minutes:i is_late:b payment_mode:s "
            "net_units:i gross_units:i returned_units:i line_count:i distinct_skus:i distinct_batches:i gmv:2 discount_total:2 "
            "cogs:2 gross_margin:2 has_promotion:b has_substitution:b has_return:b min_dte_at_sale:i requested_units:i "
            "unfulfilled_units:i fill_rate:6 is_short_filled:b arrival_date:d arrival_lag_days:i",
        ),
        "fct_inventory_movement": table(
            "fct_inventory_movement", "movement",
            "movement_seq:i batch_id:s sku_id:s store_id:s supplier_id:s event_type:s qty_delta:i units:i direction:i "
            "movement_cost_value:2 date_day:d expiry_date:d days_to_expiry:i running_balance:i arrival_date:d",
        ),
        "fct_inventory_batch": table(
            "fct_inventory_batch", "batch",
            "batch_id:s sku_id:s store_id:s supplier_id:s po_id:s received_date:d expiry_date:d qty_received:i qty_sold:i "
            "qty_written_off:i qty_remaining:i writeoff_value:2 sell_through_rate:6 is_reconciled:b movement_count:i "
            "first_movement_date:d last_movement_date:d is_opening_balance:b",
        ),
        "fct_availability_hour": table(
            "fct_availability_hour", "shelf_hours",
            "store_id:s sku_id:s hour_ts_ist:t valid_to_hour_ts_ist:t date_day:d from_hour_ist:i to_hour_ist:i "
            "hours_in_state:i is_in_stock:b on_hand_units:i ran_out_at_hour:i",
        ),
        "fct_clickstream": table(
            "fct_clickstream", "clicks",
            "store_id:s sku_id:s event_type:s was_in_stock:b hour_ts_ist:t date_day:d event_hour_ist:i event_count:i "
            "censored_event_count:i is_censored_demand:b event_ts_utc:t sku_id_was_conformed:b arrival_date:d",
        ),
        "fct_price_history": over_warehouse(
            lambda wh: wh("fct_price_history").withColumn("stacked_promo_ids", F.array_join("stacked_promo_ids", ",")),
            "store_id:s sku_id:s interval_no:i effective_from_date:d effective_to_date:d duration_days:i base_price:2 "
            "realized_price:2 discount_amt:2 discount_pct:6 promo_id:s is_promo_stacked:b max_promos_active:i "
            "stacked_promo_ids:s is_open_at_window_end:b",
            "select * from price_spans",
        ),
        "agg_intraday_arrival_curve": table(
            "agg_intraday_arrival_curve", "curve",
            "l1_category:s hour_ist:i events:i category_events:i category_share:6 global_share:6 signal_weight:6 "
            "arrival_share:6 cumulative_share_before:6",
        ),
        "agg_store_sku_day": table(
            "agg_store_sku_day", "cells",
            "store_id:s sku_id:s date_day:d is_private_label:b l1_category:s units_sold:i gross_units:i returned_units:i "
            "order_count:i net_revenue:2 gross_revenue:2 discount_value:2 cogs:2 gross_margin:2 opening_units:i received_units:i "
            "received_value:2 closing_units:i writeoff_units:i writeoff_value:2 markdown_units:i markdown_subsidy_platform:2 "
            "markdown_subsidy_brand:2 base_price_avg:3 realized_price_avg:3 hours_carried:i hours_in_stock:i in_stock_pct:6 "
            "is_censored:b browse_events:i censored_browse_events:i min_dte_at_sale:i avg_dte_at_sale:6 trailing_7d_avg_units:6 "
            "ran_out_at_hour:i demand_share_before_stockout:6 units_demanded_imputed:2 demand_imputation_method:s",
        ),
        "mart_order_daily": table(
            "mart_order_daily", "order_daily",
            "store_id:s date_day:d orders_count:i placed_orders:i unfulfilled_orders:i customers_count:i net_revenue:2 "
            "discount_total:2 cogs:2 gross_margin:2 net_units:i gross_units:i returned_units:i basket_skus:i late_orders:i "
            "short_filled_orders:i requested_units:i unfulfilled_units:i promoted_orders:i orders_with_return:i",
        ),
        "mart_customer_360": table(
            "mart_customer_360", "customer_360",
            "customer_id:s store_id:s cohort_month:d as_of_date:d acquisition_channel:s is_member:b signup_date:d "
            "first_order_date:d last_order_date:d recency_days:i orders_lifetime:i gmv_lifetime:2 orders_90d:i "
            "orders_prev_90d:i promo_orders_90d:i gmv_90d:2 gross_margin_90d:2 subsidy_90d:2 delivery_cost_90d:2 "
            "contribution_90d:2 active_curr_90d:b active_prev_90d:b ordered_m1:b r_score:i f_score:i m_score:i rfm_segment:s "
            "m1_observable:b discount_dependency_index:6 ddi_band:s customer_segment:s",
        ),
        "mart_cohort_retention": table(
            "mart_cohort_retention", "cohort_retention",
            "cohort_month:d month_index:i cohort_size:i months_observed:i active_customers:i retention_rate:6",
        ),
        "dq_source_coverage": table(
            "dq_source_coverage", "coverage",
            "source_name:s date_day:d expects_daily:b first_seen_date:d last_seen_date:d row_count:i is_present:b "
            "is_missing_partition:b is_stale:b",
        ),
    }
    return q
