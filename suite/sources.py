"""Registered queries: reading, writing, slicing and streaming the feeds."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.decisions import forecast
from larder.functions.ranges import band_of
from larder.plans import jobs
from larder.quality import gate
from larder.sources import feeds, seeds, slices, tables
from larder.streaming import live
from larder.workspace import freed_shuffles
from suite.ctes_feeds import FEEDS
from suite.ctes_jobs import JOBS
from suite.ctes_models import MODELS
from suite.models import over_library
from suite.spec import Query

LIBRARY = {**FEEDS, **MODELS, **JOBS}
CUTOFF = date(2025, 11, 30)
SLICE = (date(2025, 6, 1), date(2025, 8, 31))


CONSTANT_ROWS = """
('newsvendor', 'review_period_days', null, 1), ('newsvendor', 'lead_time_quantile', null, 0.9), ('newsvendor', 'shelf_life_cap_quantile', null, 0.95),
('markdown', 'budget_per_store_day', null, 1000), ('markdown', 'disposal_cost_per_unit', null, 0), ('markdown', 'depth_grid', '0', 0), ('markdown', 'depth_grid', '1', 0.05),
('markdown', 'depth_grid', '2', 0.1), ('markdown', 'depth_grid', '3', 0.15), ('markdown', 'depth_grid', '4', 0.2), ('markdown', 'depth_grid', '5', 0.25),
('markdown', 'depth_grid', '6', 0.3), ('markdown', 'depth_grid', '7', 0.35), ('markdown', 'depth_grid', '8', 0.4), ('markdown', 'depth_grid', '9', 0.45),
('markdown', 'depth_grid', '10', 0.5), ('markdown', 'depth_grid', '11', 0.55), ('markdown', 'depth_grid', '12', 0.6),
('deal_slot', 'deal_price', null, 11), ('deal_slot', 'slots_per_store_day', null, 3), ('deal_slot', 'private_label_floor', null, 0.3), ('deal_slot', 'uplift_multiplier', null, 3.57),
('deal_slot', 'incremental_basket_margin', null, 4.33), ('deal_slot', 'reactivation_rate', null, 0.0283), ('deal_slot', 'min_on_hand_units', null, 12), ('deal_slot', 'min_days_to_expiry', null, 1),
('transfers', 'speed_kmh', null, 18), ('transfers', 'handling_hours', null, 2), ('transfers', 'cost_per_km', null, 15), ('transfers', 'fixed_trip_cost', null, 300),
('transfers', 'min_transfer_units', null, 6)"""


def _landed(wh, name: str) -> str:
    """The root under which a feed has been appended, by arrival day, once per application."""
    root = wh.workspace.path("landed")
    wh.derive(f"landed_{name}", lambda: (feeds.append_feed(wh.feed(name), root, name), wh.feed(name))[1], keep=False)
    return root


def _fresh(wh, name: str) -> str:
    return wh.workspace.path(f"{name}-{uuid.uuid4().hex[:8]}")


def read_back(wh) -> DataFrame:
    return feeds.read_feed(wh.spark, _landed(wh, "pos_orders"), "pos_orders")


def incremental(wh) -> DataFrame:
    """The daily table as of a cutoff, then brought up to date by the incremental rebuild."""
    path = _fresh(wh, "daily")
    tables.incremental_store_sku_day(wh, path, cutoff=CUTOFF)
    return tables.incremental_store_sku_day(wh, path)


def streamed(wh, name: str, transform) -> DataFrame:
    source = live.stream_feed(wh.spark, _landed(wh, name), name)
    out = _fresh(wh, "stream")
    live.to_folder(transform(source), f"{out}/data", f"{out}/log").awaitTermination()
    return wh.spark.read.parquet(f"{out}/data")


def streamed_upsert(wh) -> DataFrame:
    """What a rebuild reads of the items lies in folders by day, so the semi-join reads the touched days only (dynamic partition pruning)."""
    path = _fresh(wh, "upsert")
    read = wh.unwritten("fct_order_item").select("store_id", "sku_id", "date_day", "signed_qty", "net_revenue")
    with freed_shuffles(wh.spark):
        tables.replace_days(read, f"{path}/items")
    items = wh.spark.read.schema(read.schema).parquet(f"{path}/items")

    def rebuild(days: DataFrame) -> DataFrame:
        rows = items.join(days, "date_day", "left_semi")
        return rows.groupBy("store_id", "sku_id", "date_day").agg(F.sum("signed_qty").alias("units_sold"), F.sum("net_revenue").alias("net_revenue"))

    source = live.stream_feed(wh.spark, _landed(wh, "pos_orders"), "pos_orders")
    live.upsert_days(source, f"{path}/log", rebuild, lambda df: tables.replace_days(df, f"{path}/data")).awaitTermination()
    return wh.spark.read.parquet(f"{path}/data")


def streamed_sales(wh) -> DataFrame:
    path = _fresh(wh, "sales")
    lines = live.lines_with_orders(*[live.stream_feed(wh.spark, _landed(wh, f), f) for f in ("pos_orders", "pos_order_items")])
    live.upsert_sold_days(lines, f"{path}/lines", f"{path}/log", lambda df: tables.replace_days(df, f"{path}/days")).awaitTermination()
    return wh.spark.read.parquet(f"{path}/days")


def clustered(wh) -> DataFrame:
    path = _fresh(wh, "clustered")
    tables.write_clustered(wh("fct_order_item"), path, ["store_id", "sku_id", "date_day"])
    return wh.spark.read.parquet(path).groupBy("store_id").agg(F.count("*").alias("n"), F.sum("signed_qty").alias("units"))


def pruned(wh) -> DataFrame:
    path = _fresh(wh, "pruned")
    tables.write_pruned(wh("fct_order"), path, ["promised_ts_ist", "delivered_ts_ist", "discount_total", "cogs", "gross_margin"])
    return wh.spark.read.parquet(path)


#: Every table with a slicing rule and a statement of its rows; the fitted ones (prices, plans, recommendations) have none.
BY_DAY = {
    "fct_order": "order_fact", "fct_order_item": "order_item", "agg_store_sku_day": "cells", "fct_inventory_movement": "movement", "fct_availability_hour": "shelf_hours",
    "fct_clickstream": "clicks", "mart_order_daily": "order_daily", "mart_forecast_accuracy": "accuracy", "mart_demand_forecast": "forecast",
}
BY_STORE = {"mart_expiry_risk": "risk", "dim_store": "stores", "mart_customer_360": "customer_360"}
WHOLE = {
    "dim_product": "products", "dim_product_snapshot": "product_versions", "dim_date": "calendar", "dim_dte_band": "dte_bands", "dim_promotion": "promos",
    "dim_supplier": "suppliers", "agg_intraday_arrival_curve": "curve", "dq_source_coverage": "coverage", "mart_cohort_retention": "cohort_retention",
}
SLICED = [*BY_DAY, *BY_STORE, *WHOLE, "fct_price_history", "fct_inventory_batch", "dim_customer"]


def slice_sql() -> str:
    parts = [f"select '{t}' as table_name, count(*) as n from {c} where store_id in {PICKED} and date_day {SPAN}" for t, c in BY_DAY.items()]
    parts += [f"select '{t}', count(*) from {c} where store_id in {PICKED}" for t, c in BY_STORE.items()]
    parts += [f"select '{t}', count(*) from {c}" for t, c in WHOLE.items()]
    parts.append(f"select 'fct_price_history', count(*) from price_spans where store_id in {PICKED} and effective_from_date <= date '2025-08-31' and effective_to_date > date '2025-06-01'")
    parts.append(f"select 'fct_inventory_batch', count(*) from batch where store_id in {PICKED} and received_date <= date '2025-08-31' and expiry_date > date '2025-06-01'")
    parts.append(f"select 'dim_customer', count(*) from customers where home_store_id in {PICKED}")
    return " union all ".join(parts)


def sliced(wh) -> DataFrame:
    picked = slices.pick_stores(wh("dim_store"), wh("fct_order"), 2)
    cut = slices.slice_tables(wh, picked, *SLICE, SLICED)
    rows = None
    for name, df in cut.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def single_file(wh) -> DataFrame:
    path = _fresh(wh, "single")
    wh.feed("crm_deal_exposure").coalesce(1).write.parquet(path)
    return feeds.read_file(wh.spark, path, "crm_deal_exposure")


def replaced(wh) -> DataFrame:
    path = _fresh(wh, "replaced")
    name = f"replaced_{path.rsplit('/', 1)[-1].replace('-', '_')}"
    days = wh("mart_order_daily")
    tables.replace_table(days.filter("placed_orders < 0"), name, path)
    tables.replace_table(days, name, path)
    return wh.spark.table(name)


def stock_by_band(wh) -> DataFrame:
    stock = wh("mart_expiry_risk").withColumn("dte_band", band_of(F.col("days_to_expiry"), seeds.DTE_BANDS))
    return stock.groupBy("dte_band").agg(F.count("*").alias("batches"), F.sum("qty_remaining").alias("units")).join(wh("dim_dte_band"), "dte_band")


PICKED = """(select store_id from (select *, row_number() over (partition by catchment_tier order by n desc, store_id) as r
             from stores join (select store_id, count(*) as n from order_fact group by 1) using (store_id)) order by r, n desc, store_id limit 2)"""
SPAN = "between date '2025-06-01' and date '2025-08-31'"


def source_queries() -> dict[str, Query]:
    def q(build, cols, sql=None):
        return over_library(LIBRARY, build, cols, sql)

    return {
        "s01_partitioned_feed": q(
            read_back, "order_id:s store_id:s order_ts:t is_late:b n_units:i dt:d", "select * from pos_orders"
        ),
        "s02_single_file": q(single_file, "customer_id:s deal_arm:s assigned_date:d holdout_share:6", "select * from crm_deal_exposure"),
        "s08_replace_table": q(replaced, "store_id:s date_day:d placed_orders:i orders_count:i net_revenue:2", "select * from order_daily"),
        "m16_stock_by_band": q(
            stock_by_band, "dte_band:s sort_order:i batches:i units:i",
            """select dte_band, sort_order, count(*) as batches, sum(qty_remaining) as units
               from risk join dte_bands on days_to_expiry >= min_days and days_to_expiry < max_days group by 1, 2""",
        ),
        "s03_seeds": q(
            lambda wh: seeds.seed(wh.spark, "promotions").join(wh("stg_catalog__price_history"), "promo_id").groupBy("promo_id", "funding_source").agg(F.count("*").alias("n")),
            "promo_id:s funding_source:s n:i",
            "select promo_id, funding_source, count(*) as n from promotions join stg_prices using (promo_id) group by all",
        ),
        "s04_late_arrivals_by_path": q(
            lambda wh: gate.late_arrivals_by_path(read_back(wh)), "figure:i", "select count(*) as figure from pos_orders where cast(order_ts as date) < dt"
        ),
        "s07_incremental_rebuild": q(
            incremental, "store_id:s sku_id:s date_day:d units_sold:i net_revenue:2 closing_units:i trailing_7d_avg_units:6 units_demanded_imputed:2 demand_imputation_method:s",
            "select * from cells",
        ),
        "s09_forecast_swap": q(
            lambda wh: forecast.swap_forecast(
                wh("mart_forecast_accuracy"),
                wh("mart_demand_forecast").filter("horizon_days <= 3").withColumns({"forecast_units": F.col("forecast_units") * 2, "model_name": F.lit("doubled")}),
            ),
            "store_id:s sku_id:s date_day:d origin_date:d horizon_days:i forecast_units:6 baseline_units:6 model_name:s",
            """select a.* exclude (forecast_units, model_name), if(f.store_id is not null and a.horizon_days <= 3, 2 * f.forecast_units, a.forecast_units) as forecast_units,
                      if(f.store_id is not null and a.horizon_days <= 3, 'doubled', a.model_name) as model_name
               from accuracy a left join forecast f on f.store_id = a.store_id and f.sku_id = a.sku_id and f.date_day = a.date_day
                    and f.origin_date = a.origin_date and f.horizon_days = a.horizon_days""",
        ),
        "s11_clustered_write": q(
            clustered, "store_id:s n:i units:i", "select store_id, count(*) as n, sum(signed_qty) as units from order_item group by 1"
        ),
        "s12_pruned_copy": q(pruned, "order_id:s gmv:2 fill_rate:6", "select * from order_fact"),
        "s13_consistent_slice": q(
            sliced, "table_name:s n:i",
            slice_sql(),
        ),
        "s14_store_pick": q(
            lambda wh: slices.pick_stores(wh("dim_store"), wh.unwritten("fct_order"), 4), "store_id:s catchment_tier:s orders:i rank_in_tier:i",
            """select store_id, catchment_tier, n as orders, r as rank_in_tier
               from (select *, row_number() over (partition by catchment_tier order by n desc, store_id) as r
                     from stores join (select store_id, count(*) as n from order_fact group by 1) using (store_id)) order by r, n desc, store_id limit 4""",
        ),
        "s16_policy_bundle": q(
            # Every row but the fitted slopes and how many are identified.
            lambda wh: jobs.policy_bundle(wh).filter("item is null or item not in ('elasticity_raw', 'standard_error', 'is_identified', 'elasticity_usable', 'identified')"),
            "section:s name:s item:s value:6",
            f"""with cell as (select distinct l1_category, dte_band from elastic_panel),
                    late as (select l1_category, quantile_cont(lead_time_days, 0.9) as p90, avg(lead_time_days) as mean, count(*) as n
                             from stg_purchases join products using (sku_id) where lead_time_days is not null group by grouping sets ((l1_category), ()))
               select 'elasticity' as section, l1_category || ' | ' || dte_band as name, unnest(['min_days', 'max_days']) as item, unnest([min_days, max_days])::double as value
               from cell join dte_bands using (dte_band)
               union all select 'lead_time_days', coalesce(l1_category, 'all'), unnest(['p90', 'mean', 'observations']), unnest([p90, mean, n::double]) from late
               union all select 'demand', 'dispersion', 'k', k from dispersion
               union all select 'provenance', 'agg_store_sku_day', unnest(['rows', 'net_revenue']), unnest([count(*)::double, round(sum(net_revenue), 2)]) from cells
               union all select 'provenance', 'elasticity', 'cells', count(*) from cell
               union all select * from (values {CONSTANT_ROWS})""",
        ),
        "r01_stream_dedupe": q(
            lambda wh: streamed(wh, "pos_orders", lambda s: live.deduplicated_orders(s).drop("event_time")),
            "order_id:s store_id:s n_units:i", "select order_id, store_id, n_units from stg_orders",
        ),
        "r02_stream_hourly_clicks": q(
            lambda wh: streamed(wh, "clickstream", live.hourly_clicks).groupBy("store_id", "sku_id", "event_type", "was_in_stock", F.col("hour_utc").cast("date").alias("day_utc")).agg(F.sum("event_count").alias("event_count")),
            "store_id:s sku_id:s event_type:s was_in_stock:b day_utc:d event_count:i",
            """select store_id, if(sku_id like 'SKU\\_%' escape '\\', 'SKU-' || lpad(sku_id[5:], 5, '0'), sku_id) as sku_id, event_type, was_in_stock,
                      event_date as day_utc, count(*) as event_count from clickstream
               where date_trunc('hour', event_ts_utc) + interval 1 hour <= (select max(event_ts_utc) from clickstream) - interval 48 hour group by all""",
        ),
        "r03_stream_upsert": q(
            streamed_upsert, "store_id:s sku_id:s date_day:d units_sold:i net_revenue:2",
            "select store_id, sku_id, date_day, sum(signed_qty) as units_sold, sum(net_revenue) as net_revenue from order_item group by all",
        ),
        "r05_stream_sold_days": q(
            streamed_sales, "store_id:s sku_id:s date_day:d units_sold:i net_revenue:2",
            """select store_id, sku_id, date_day, sum(signed_qty) as units_sold, sum(net_revenue) as net_revenue from order_item
               where source_feed = 'pos_order_items' group by all""",
        ),
        "r04_stream_sessions": q(
            lambda wh: streamed(wh, "clickstream", live.browse_sessions), "store_id:s sku_id:s events:i",
            """with v as (select store_id, if(sku_id like 'SKU\\_%' escape '\\', 'SKU-' || lpad(sku_id[5:], 5, '0'), sku_id) as sku, event_ts_utc as ts
                          from clickstream where event_type = 'pdp_view'),
                    w as (select *, sum(opens) over (partition by store_id, sku order by ts) as session
                          from (select *, case when ts < lag(ts) over (partition by store_id, sku order by ts) + interval 1 hour then 0 else 1 end as opens from v))
               select store_id, sku as sku_id, count(*) as events from w group by store_id, sku, session
               having max(ts) >= min(ts) + interval 2 hour and max(ts) + interval 1 hour <= (select max(ts) from v) - interval 48 hour""",
        ),
    }
