"""Facts: order lines, orders, the stock ledger, availability, prices, clicks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import at_hour, changed, positive_ratio, row_hash, sum_where
from larder.functions.ordered import islands, run_window, running_sum

RECEIPT_EVENTS = ("inbound", "opening_balance")


def fct_order_item(lines: DataFrame, orders: DataFrame) -> DataFrame:
    header = orders.select(
        "order_id", "store_id", "customer_id", F.col("order_date_ist").alias("date_day"), "order_ts_ist",
        F.col("arrival_date").alias("order_arrival_date"), F.col("arrival_lag_days").alias("order_arrival_lag_days"),
    )
    return lines.join(header, "order_id").withColumns(line_values())


def line_values() -> dict[str, Column]:
    """Key and money of a line, from its other columns."""
    qty = F.col("signed_qty")
    return {
        "order_item_key": row_hash(["order_id", "sku_id", "batch_id", "line_type", "source_feed"]),
        "net_revenue": qty * F.col("unit_realized_price"),
        "gross_revenue": qty * F.col("unit_base_price"),
        "discount_value": qty * F.col("discount_amt"),
        "cogs": qty * F.col("unit_cogs"),
        "gross_margin": qty * (F.col("unit_realized_price") - F.col("unit_cogs")),
    }


def fct_order(orders: DataFrame, items: DataFrame) -> DataFrame:
    sale, back = F.col("line_type") == "sale", F.col("line_type") == "return"
    measures = {
        "net_units": F.sum("signed_qty"),
        "gross_units": sum_where(F.col("units"), sale),
        "returned_units": sum_where(F.col("units"), back),
        "line_count": F.count(F.when(sale, 1)),
        # Sets are bounded by the lines of one order, and need no copy of the line table for each distinct count.
        "distinct_skus": F.size(F.collect_set("sku_id")),
        "distinct_batches": F.size(F.collect_set("batch_id")),
        "gmv": F.sum("net_revenue"),
        "discount_total": F.sum("discount_value"),
        "cogs": F.sum("cogs"),
        "gross_margin": F.sum("gross_margin"),
    }
    flags = {"has_promotion": F.max("is_promoted"), "has_substitution": F.max("is_substitution"), "has_return": F.max(back)}
    basket = items.groupBy("order_id").agg(
        *[m.alias(n) for n, m in {**measures, **flags}.items()], F.min("dte_at_sale").alias("min_dte_at_sale")
    )
    return (
        orders.join(basket, "order_id", "left")
        .fillna(0, list(measures))
        .fillna(False, list(flags))
        .withColumnsRenamed({"order_date_ist": "date_day", "n_units": "requested_units"})
        .withColumns(
            {
                "unfulfilled_units": F.col("requested_units") - F.col("gross_units"),
                "fill_rate": F.col("gross_units") / F.nullif(F.col("requested_units").cast("double"), F.lit(0.0)),
                "is_short_filled": F.col("requested_units") > F.col("gross_units"),
            }
        )
        .drop("row_hash")
    )


def int_movement_day(movements: DataFrame) -> DataFrame:
    """Units and number of movements per batch, event and day: all that sums over the ledger need."""
    return movements.groupBy("batch_id", "event_type", "event_date").agg(
        F.sum("qty_delta").alias("qty_delta"), F.count("*").alias("movement_count")
    )


def valued_movements(movements: DataFrame, batches: DataFrame) -> DataFrame:
    """Movements, or sums of them by day, with what their batch says of them."""
    return movements.join(
        batches.select("batch_id", "sku_id", "store_id", "supplier_id", "expiry_date", "unit_landed_cost"), "batch_id"
    ).withColumnRenamed("event_date", "date_day")


def int_stock_day(movement_days: DataFrame, batches: DataFrame) -> DataFrame:
    """``int_movement_day`` valued at batch cost."""
    return valued_movements(movement_days, batches).withColumn(
        "movement_cost_value", F.col("qty_delta") * F.col("unit_landed_cost")
    )


def fct_inventory_movement(movements: DataFrame, batches: DataFrame, slice_width: int) -> DataFrame:
    """The ledger valued at batch cost, with each batch's balance after every movement."""
    valued = valued_movements(movements, batches)
    balanced = running_sum(
        valued, ["batch_id"], F.floor(F.col("movement_seq") / slice_width), ["movement_seq"], "qty_delta",
        "running_balance",
    )
    return balanced.withColumns(
        {
            "movement_cost_value": F.col("qty_delta") * F.col("unit_landed_cost"),
            "days_to_expiry": F.datediff("expiry_date", "date_day"),
        }
    ).drop("unit_landed_cost")


def fct_inventory_batch(batches: DataFrame, movements: DataFrame) -> DataFrame:
    """``movements`` are single ones, or their sums by day (``int_movement_day``)."""
    delta, event = F.col("qty_delta"), F.col("event_type")
    counted = F.sum("movement_count") if "movement_count" in movements.columns else F.count("*")
    ledger = movements.groupBy("batch_id").agg(
        F.sum(delta).alias("qty_remaining"),
        sum_where(delta, event.isin(*RECEIPT_EVENTS)).alias("qty_in"),
        sum_where(-delta, event == "sale").alias("qty_sold"),
        sum_where(-delta, event == "expiry_writeoff").alias("qty_written_off"),
        counted.alias("movement_count"),
        F.min("event_date").alias("first_movement_date"),
        F.max("event_date").alias("last_movement_date"),
    )
    return (
        batches.join(ledger, "batch_id", "left")
        .fillna(0, ["qty_remaining", "qty_in", "qty_sold", "qty_written_off", "movement_count"])
        .withColumns(
            {
                "date_day": F.col("received_date"),
                "writeoff_value": F.col("qty_written_off") * F.col("unit_landed_cost"),
                "sell_through_rate": F.col("qty_sold") / F.nullif(F.col("qty_received").cast("double"), F.lit(0.0)),
                "is_reconciled": F.col("qty_in") == F.col("qty_received"),
            }
        )
        .drop("qty_in")
    )


def fct_availability_hour(
    batches: DataFrame, movements: DataFrame, products: DataFrame, stockouts: DataFrame
) -> DataFrame:
    """In-stock and out-of-stock intervals of every carried day, two rows at most per day.

    The spine is one row per store, SKU and day, so each series' window is as long as the
    calendar, whatever its sales.
    """
    end = products.agg(F.max("snapshot_date")).scalar()
    carried = batches.groupBy("store_id", "sku_id").agg(F.min("received_date").alias("first_day"))
    spine = (
        carried.withColumn("end", end)
        .filter("first_day <= end")
        .select("store_id", "sku_id", F.explode(F.sequence("first_day", "end")).alias("date_day"))
    )
    deltas = movements.groupBy("store_id", "sku_id", "date_day").agg(F.sum("qty_delta").alias("delta"))
    series = run_window(["store_id", "sku_id"], "date_day")
    before = series.rowsBetween(Window.unboundedPreceding, -1)
    opened = spine.join(deltas, ["store_id", "sku_id", "date_day"], "left").withColumn(
        "open_units", F.coalesce(F.sum("delta").over(before), F.lit(0))
    )
    out_at = stockouts.select(
        "store_id", "sku_id", F.col("stockout_date").alias("date_day"), F.col("stockout_hour_ist").alias("ran_out_at_hour")
    )
    days = opened.join(out_at, ["store_id", "sku_id", "date_day"], "left")
    until = F.coalesce("ran_out_at_hour", F.lit(24))
    states = F.array(
        F.when(until > 0, F.struct(F.lit(0).alias("a"), until.alias("b"), F.lit(True).alias("s"), F.col("open_units").alias("u"))),
        F.when(
            F.col("ran_out_at_hour").isNotNull(),
            F.struct(F.col("ran_out_at_hour").alias("a"), F.lit(24).alias("b"), F.lit(False).alias("s"), F.lit(0).cast("long").alias("u")),
        ),
    )
    return (
        days.withColumn("state", F.explode(F.array_compact(states)))
        .select(
            "store_id", "sku_id", "date_day", F.col("state.a").alias("from_hour_ist"), F.col("state.b").alias("to_hour_ist"),
            F.col("state.s").alias("is_in_stock"), F.col("state.u").alias("on_hand_units"),
            F.lit(True).alias("in_assortment"), "ran_out_at_hour",
        )
        .withColumns(
            {
                "hours_in_state": F.col("to_hour_ist") - F.col("from_hour_ist"),
                "hour_ts_ist": at_hour(F.col("date_day"), F.col("from_hour_ist")),
                "valid_to_hour_ts_ist": at_hour(F.col("date_day"), F.col("to_hour_ist")),
            }
        )
    )


def fct_clickstream(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy(
        "store_id", "sku_id", "event_type", "was_in_stock", F.col("event_date_ist").alias("date_day"), "event_hour_ist"
    ).agg(
        F.count("*").alias("event_count"),
        F.count(F.when(F.col("is_censored_demand"), 1)).alias("censored_event_count"),
        F.max("is_censored_demand").alias("is_censored_demand"),
        F.min("event_ts_utc").alias("event_ts_utc"),
        F.max("sku_id_was_conformed").alias("sku_id_was_conformed"),
        F.min("arrival_date").alias("arrival_date"),
    ).withColumn("hour_ts_ist", at_hour(F.col("date_day"), F.col("event_hour_ist")))


def price_days(prices: DataFrame, promotions: DataFrame) -> DataFrame:
    """One price per store, SKU and day; of stacked promotions the deepest on record sets it."""
    depth = F.struct(F.coalesce("observed_depth_pct", F.lit(-1.0)).alias("depth"), "promo_id")
    return (
        prices.join(promotions.select("promo_id", "observed_depth_pct"), "promo_id", "left")
        .groupBy("store_id", "sku_id", "effective_date")
        .agg(
            F.min("base_price").alias("base_price"),
            F.min("realized_price").alias("realized_price"),
            F.max("realized_price").alias("realized_price_high"),
            F.max_by("promo_id", depth).alias("promo_id"),
            F.array_sort(F.collect_set("promo_id")).alias("stacked_promo_ids"),
            F.count("*").alias("promo_count"),
        )
    )


def fct_price_history(prices: DataFrame, promotions: DataFrame) -> DataFrame:
    """The sparse promotion ledger as half-open price intervals."""
    keys = ["store_id", "sku_id"]
    w = run_window(keys, "effective_date")
    breaks = (
        F.lag("effective_date").over(w).isNull()
        | changed(F.col("base_price"), F.lag("base_price").over(w))
        | changed(F.col("realized_price"), F.lag("realized_price").over(w))
        | changed(F.col("promo_id"), F.lag("promo_id").over(w))
        | (F.datediff("effective_date", F.lag("effective_date").over(w)) != 1)
    )
    numbered = islands(price_days(prices, promotions), keys, "effective_date", breaks, "interval_no")
    intervals = numbered.groupBy(*keys, "interval_no").agg(
        F.min("effective_date").alias("effective_from_date"),
        F.date_add(F.max("effective_date"), 1).alias("effective_to_date"),
        F.count("*").alias("duration_days"),
        F.min("base_price").alias("base_price"),
        F.min("realized_price").alias("realized_price"),
        F.min("promo_id").alias("promo_id"),
        F.max("promo_count").alias("max_promos_active"),
        F.max(F.col("promo_count") > 1).alias("is_promo_stacked"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("stacked_promo_ids")))).alias("stacked_promo_ids"),
    )
    last = prices.agg(F.max("effective_date")).scalar()
    off = F.col("base_price") - F.col("realized_price")
    return intervals.withColumns(
        {
            "price_interval_key": row_hash([*keys, "effective_from_date"]),
            "effective_from": F.col("effective_from_date").cast("timestamp_ntz"),
            "effective_to": F.col("effective_to_date").cast("timestamp_ntz"),
            "is_open_at_window_end": F.col("effective_to_date") > last,
            "discount_amt": off,
            "discount_pct": positive_ratio(off, F.col("base_price")),
        }
    )
