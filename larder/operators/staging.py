"""Staging: one function per raw feed, repairing the defects that feed is known to have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import (
    at_hour,
    conformed_sku_id,
    minutes_between,
    positive_ratio,
    row_hash,
    utc_to_ist,
)
from larder.functions.ordered import by_key, first_arrival

# What makes a row "the same row": everything the business wrote, never the arrival day, or a
# copy that arrives a day late would pass as new.
ORDER_COLUMNS = [
    "order_id", "order_ts", "promised_ts", "delivered_ts", "is_late", "payment_mode", "n_units",
    "store_id", "customer_id",
]
ITEM_COLUMNS = [
    "order_id", "sku_id", "batch_id", "qty", "unit_base_price", "unit_realized_price",
    "discount_amt", "unit_cogs", "dte_at_sale", "promo_id", "is_substitution",
]
# Names of a staged order's columns that the feed names otherwise.
ORDER_NAMES = {"order_ts": "order_ts_ist", "promised_ts": "promised_ts_ist", "delivered_ts": "delivered_ts_ist", "dt": "arrival_date"}
# Reason codes written to the quarantine.
NO_BATCH = "missing_batch_reference"
NO_SALE = "return_without_matching_sale"


def stg_pos__orders(raw: DataFrame, tasks: int | None = None) -> DataFrame:
    once = first_arrival(raw, ORDER_COLUMNS, "dt", by="order_id", tasks=tasks)
    return (
        once.withColumnsRenamed(ORDER_NAMES)
        .withColumns(order_hash())
        .withColumns(
            {
                "order_date_ist": F.col("order_ts_ist").cast("date"),
                "delivery_slack_minutes": minutes_between(F.col("promised_ts_ist"), F.col("delivered_ts_ist")),
                "arrival_lag_days": F.datediff("arrival_date", F.col("order_ts_ist").cast("date")),
            }
        )
    )


def order_hash() -> dict[str, Column]:
    """The hash of a staged order, from its other columns."""
    return {"row_hash": row_hash([ORDER_NAMES.get(c, c) for c in ORDER_COLUMNS])}


def stg_pos__order_items(raw: DataFrame, tasks: int | None = None) -> DataFrame:
    return (
        first_arrival(raw, ITEM_COLUMNS, "dt", by="order_id", tasks=tasks)
        .withColumns(item_hash())
        .withColumnRenamed("dt", "arrival_date")
        .withColumns(
            {
                "is_promoted": F.col("promo_id").isNotNull(),
                "is_return_encoded_as_negative": F.col("qty") < 0,
            }
        )
    )


def item_hash() -> dict[str, Column]:
    """The hash of a staged item, from its other columns."""
    return {"row_hash": row_hash(ITEM_COLUMNS)}


def stg_pos__returns(raw: DataFrame) -> DataFrame:
    """Renamed only: two equal returns of one line are two returns."""
    return raw.withColumnsRenamed({"qty": "returned_qty", "reason": "return_reason", "dt": "arrival_date"})


def stg_pos__order_lines(items: DataFrame, returns: DataFrame, tasks: int | None = None) -> DataFrame:
    """Sales, negative sales and the returns feed as one signed line per event.

    Items meet the returns of their order, so the items, which come together by order, are read once and do not move
    again. SKU and batch are compared by two inequalities: as equalities they would be join keys, and both sides
    would be shuffled on all three. ``tasks`` is that of the items.
    """
    line = ["order_id", "sku_id", "batch_id"]
    priced = [
        "promo_id", "unit_base_price", "unit_realized_price", "discount_amt", "unit_cogs",
        "dte_at_sale", "is_substitution", "is_promoted",
    ]
    taken = ["returned_qty", "return_reason", "return_date", "arrival_date"]
    back = (
        by_key(returns.select(*[F.col(c).alias(f"_r_{c}") for c in [*line, *taken]]), "_r_order_id", tasks)
        .withColumn("_nth", F.row_number().over(Window.partitionBy(*[f"_r_{c}" for c in line]).orderBy("_r_return_date")))
    )
    same = F.col("order_id") == F.col("_r_order_id")
    for c in line[1:]:
        same = same & (F.col(c) >= F.col(f"_r_{c}")) & (F.col(c) <= F.col(f"_r_{c}"))
    joined = items.select(*line, *priced, "arrival_date", "qty").join(back, same & (F.col("qty") > 0), "left")

    def event(kind, feed: str, qty, day, reason, returned) -> Column:
        return F.struct(
            day.alias("arrival_date"), kind.alias("line_type"), F.lit(feed).alias("source_feed"), qty.alias("signed_qty"),
            reason.alias("return_reason"), returned.alias("return_date"),
        )

    kind = F.when(F.col("qty") > 0, "sale").otherwise("return")
    none = {c: F.lit(None).cast(returns.schema[c].dataType) for c in ("return_reason", "return_date")}
    # An item with several returns comes as often: the first brings its own line along.
    events = F.array(
        F.when(
            (F.col("qty") != 0) & (F.coalesce("_nth", F.lit(1)) == 1),
            event(kind, "pos_order_items", F.col("qty"), F.col("arrival_date"), none["return_reason"], none["return_date"]),
        ),
        F.when(
            F.col("_nth").isNotNull(),
            event(F.lit("return"), "pos_returns", -F.col("_r_returned_qty"), F.col("_r_arrival_date"), F.col("_r_return_reason"), F.col("_r_return_date")),
        ),
    )
    return (
        joined.select(*line, *priced, F.explode(events).alias("event"))
        .filter("event is not null")
        .select(*line, *priced, "event.*")
        .withColumn("units", F.abs("signed_qty"))
    )


def stg_quarantine(raw_movements: DataFrame, returns: DataFrame, items: DataFrame) -> DataFrame:
    """Rows the facts cannot use, with why and how many units they carry."""
    orphans = raw_movements.filter(F.col("batch_id").isNull()).select(
        F.lit("wms_inventory_movement").alias("source_name"),
        F.lit(NO_BATCH).alias("reason_code"),
        F.lit("The movement names no batch, so no balance can hold it.").alias("reason"),
        F.col("movement_seq").cast("string").alias("record_key"),
        "event_date",
        F.col("dt").alias("arrival_date"),
        F.abs("qty_delta").cast("double").alias("impact_units"),
        F.to_json(F.struct("movement_seq", "batch_id", "event_type", "qty_delta", "event_date")).alias("payload"),
    )
    line = ["order_id", "sku_id", "batch_id"]
    unmatched = returns.join(items.filter("qty > 0").select(*line), line, "left_anti").select(
        F.lit("pos_returns").alias("source_name"),
        F.lit(NO_SALE).alias("reason_code"),
        F.lit("The return names a line that was never sold, so it has no price.").alias("reason"),
        F.concat_ws("|", "order_id", "sku_id", F.coalesce("batch_id", F.lit(""))).alias("record_key"),
        F.col("return_date").alias("event_date"),
        "arrival_date",
        F.col("returned_qty").cast("double").alias("impact_units"),
        F.to_json(F.struct(*line, "returned_qty", "return_reason", "return_date")).alias("payload"),
    )
    return orphans.unionByName(unmatched, allowMissingColumns=True)


def stg_catalog__products(raw: DataFrame) -> DataFrame:
    """Packs keyed in kg while labelled g are put back to g; sizes compare in base units."""
    drifted = F.col("uom").isin("g", "ml") & (F.col("pack_qty") < 1)
    unit = F.lower("uom")
    large = unit.isin("kg", "l")
    return (
        raw.withColumnRenamed("dt", "arrival_date")
        .withColumn("pack_qty_was_repaired", drifted)
        .withColumn("pack_qty", F.when(F.col("pack_qty_was_repaired"), F.col("pack_qty") * 1000).otherwise(F.col("pack_qty")))
        .withColumns(
            {
                "base_uom": F.when(unit == "kg", "g").when(unit == "l", "ml").otherwise(unit),
                "pack_size_base_units": F.when(large, F.col("pack_qty") * 1000).otherwise(F.col("pack_qty")),
                "unit_margin": F.col("base_price") - F.col("landed_cost"),
                "gross_margin_pct": positive_ratio(F.col("base_price") - F.col("landed_cost"), F.col("base_price")),
            }
        )
    )


def stg_catalog__price_history(raw: DataFrame) -> DataFrame:
    off = F.col("base_price") - F.col("realized_price")
    return raw.withColumnRenamed("dt", "arrival_date").withColumns(
        {
            "discount_amt": off,
            "discount_pct": positive_ratio(off, F.col("base_price")),
            "is_promoted": F.col("promo_id").isNotNull(),
        }
    )


def stg_web__clickstream(raw: DataFrame) -> DataFrame:
    return raw.select(
        "store_id",
        conformed_sku_id(F.col("sku_id")).alias("sku_id"),
        F.col("sku_id").alias("sku_id_raw"),
        "event_type",
        "was_in_stock",
        (~F.col("was_in_stock")).alias("is_censored_demand"),
        utc_to_ist(F.col("event_ts_utc")).alias("event_ts_ist"),
        "event_ts_utc",
        F.col("event_date").alias("event_date_utc"),
        F.col("dt").alias("arrival_date"),
    ).select(
        "*",
        F.col("event_ts_ist").cast("date").alias("event_date_ist"),
        F.hour("event_ts_ist").alias("event_hour_ist"),
        (F.col("sku_id") != F.col("sku_id_raw")).alias("sku_id_was_conformed"),
    ).drop("sku_id_raw")


def stg_wms__inventory_movements(raw: DataFrame) -> DataFrame:
    return raw.filter(F.col("batch_id").isNotNull()).withColumnRenamed("dt", "arrival_date").withColumns(
        {"units": F.abs("qty_delta"), "direction": F.signum("qty_delta")}
    )


def stg_wms__inventory_batches(raw: DataFrame) -> DataFrame:
    return raw.withColumnRenamed("dt", "arrival_date").withColumns(
        {
            "po_id": F.col("po_id").cast("string"),
            "landed_cost_value": F.col("qty_received") * F.col("unit_landed_cost"),
            "shelf_life_remaining_days": F.datediff("expiry_date", "received_date"),
            "is_opening_balance": F.col("po_id").isNull(),
        }
    )


def stg_wms__purchase_orders(raw: DataFrame) -> DataFrame:
    return raw.withColumnRenamed("dt", "arrival_date").withColumns(
        {
            "fill_rate": positive_ratio(F.col("received_qty"), F.col("ordered_qty")),
            "shortfall_qty": F.col("ordered_qty") - F.col("received_qty"),
            "lead_time_days": F.datediff("received_date", "ordered_date"),
            "days_late": F.datediff("received_date", "expected_date"),
        }
    )


def stg_wms__stockout_intervals(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(
        {"event_date": "stockout_date", "hour_out": "stockout_hour_ist", "dt": "arrival_date"}
    ).withColumn("stockout_hour_ts_ist", at_hour(F.col("stockout_date"), F.col("stockout_hour_ist")))


def stg_crm__customers(raw: DataFrame) -> DataFrame:
    return raw.withColumnRenamed("dt", "snapshot_date")


def stg_crm__deal_exposure(raw: DataFrame) -> DataFrame:
    return raw.withColumn("is_deal_exposed", F.col("deal_arm") == "exposed")


def stg_ref__stores(raw: DataFrame) -> DataFrame:
    return raw.withColumnRenamed("dt", "arrival_date")


def stg_ref__suppliers(raw: DataFrame) -> DataFrame:
    return raw.withColumnRenamed("dt", "arrival_date")
