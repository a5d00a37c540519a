"""Daily demand per store and SKU, with stockouts taken out of it, and the curve that does so."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import ratio, row_hash, sum_where
from larder.operators.facts import RECEIPT_EVENTS
from larder.params import Params

CELL = ["store_id", "sku_id", "date_day"]


def agg_intraday_arrival_curve(clicks: DataFrame, products: DataFrame) -> DataFrame:
    """Hourly share of a category's demand, shrunk to the overall curve where it is only noise."""
    views = (
        clicks.filter((F.col("event_type") == "pdp_view") & F.col("was_in_stock"))
        .join(products.select("sku_id", "l1_category"), "sku_id")
        .groupBy("l1_category", F.col("event_hour_ist").alias("hour_ist"))
        .agg(F.sum("event_count").alias("events"))
    )
    # Categories x 24 rows from here on.
    grid = views.select("l1_category").distinct().withColumn("hour_ist", F.explode(F.sequence(F.lit(0), F.lit(23))))
    counted = grid.join(views, ["l1_category", "hour_ist"], "left").fillna(0, ["events"])
    category = Window.partitionBy("l1_category")
    hour = Window.partitionBy("hour_ist")
    everything = views.agg(F.sum("events")).scalar()
    shares = counted.withColumns(
        {
            "category_events": F.sum("events").over(category),
            "global_share": F.sum("events").over(hour) / everything,
        }
    ).withColumn("category_share", ratio(F.col("events"), F.col("category_events")))
    g, n = F.col("global_share"), F.col("category_events")
    noise = F.when(n != 0, F.sqrt(g * (1 - g) / n)) * math.sqrt(2.0 / math.pi)
    weighed = shares.withColumns(
        {
            "observed_tvd": F.sum(F.abs(F.col("category_share") - g)).over(category) * 0.5,
            "noise_tvd": F.sum(noise).over(category) * 0.5,
        }
    ).withColumn(
        "signal_weight",
        F.greatest(F.lit(0.0), 1 - F.pow(ratio(F.col("noise_tvd"), F.col("observed_tvd")), 2)),
    )
    weight = F.col("signal_weight")
    blended = weighed.withColumn("blend", weight * F.col("category_share") + (1 - weight) * g)
    earlier = category.orderBy("hour_ist").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("blend").over(category)
    return blended.select(
        "l1_category", "hour_ist", "events", "category_events", "category_share", "global_share", "signal_weight",
        (F.col("blend") / whole).alias("arrival_share"),
        F.coalesce(F.sum("blend").over(earlier) / whole, F.lit(0.0)).alias("cumulative_share_before"),
    )


def daily_sales(items: DataFrame, promotions: DataFrame) -> DataFrame:
    sale = F.col("line_type") == "sale"
    by_platform, by_brand = F.col("funding_source") == "platform", F.col("funding_source") == "brand"
    promoted = items.join(promotions.select("promo_id", "promo_type", "funding_source"), "promo_id", "left")
    return promoted.groupBy(*CELL).agg(
        F.sum("signed_qty").alias("units_sold"),
        sum_where(F.col("units"), sale).alias("gross_units"),
        sum_where(F.col("units"), ~sale).alias("returned_units"),
        F.countDistinct("order_id").alias("order_count"),
        *[F.sum(c).alias(c) for c in ("net_revenue", "gross_revenue", "discount_value", "cogs", "gross_margin")],
        sum_where(F.col("signed_qty"), F.col("promo_type") == "markdown").alias("markdown_units"),
        sum_where(F.col("discount_value"), by_platform).alias("markdown_subsidy_platform"),
        sum_where(F.col("discount_value"), by_brand).alias("markdown_subsidy_brand"),
        F.min("dte_at_sale").alias("min_dte_at_sale"),
        F.sum(F.col("signed_qty") * F.col("dte_at_sale")).alias("dte_weighted_units"),
    )


def daily_stock(movements: DataFrame) -> DataFrame:
    received, scrapped = F.col("event_type").isin(*RECEIPT_EVENTS), F.col("event_type") == "expiry_writeoff"
    qty, value = F.col("qty_delta"), F.col("movement_cost_value")
    return movements.groupBy(*CELL).agg(
        F.sum(qty).alias("net_movement"),
        sum_where(qty, received).alias("received_units"),
        sum_where(value, received).alias("received_value"),
        sum_where(-qty, scrapped).alias("writeoff_units"),
        sum_where(-value, scrapped).alias("writeoff_value"),
    )


def daily_availability(hours: DataFrame) -> DataFrame:
    return hours.groupBy(*CELL).agg(
        F.sum("hours_in_state").alias("hours_carried"),
        sum_where(F.col("hours_in_state"), F.col("is_in_stock")).alias("hours_in_stock"),
        F.max("on_hand_units").alias("opening_units"),
        F.max("ran_out_at_hour").alias("ran_out_at_hour"),
        F.max(~F.col("is_in_stock")).alias("is_censored"),
    )


def daily_browsing(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy(*CELL).agg(
        F.sum("event_count").alias("browse_events"), F.sum("censored_event_count").alias("censored_browse_events")
    )


def _arrived(df: DataFrame, cutoff, arrival: str | None) -> DataFrame:
    if cutoff is None:
        return df
    kept = df.filter(F.col("date_day") <= F.lit(cutoff))
    return kept.filter(F.col(arrival) <= F.lit(cutoff)) if arrival else kept


def agg_store_sku_day(
    items: DataFrame,
    movements: DataFrame,
    hours: DataFrame,
    clicks: DataFrame,
    promotions: DataFrame,
    products: DataFrame,
    curve: DataFrame,
    params: Params,
    rebuild_from=None,
) -> DataFrame:
    """Everything known about a store-SKU-day, and what it would have sold had it not run out.

    ``rebuild_from`` limits the output to that day on; inputs are then read only as far back as
    the trailing mean needs. ``params.arrival_cutoff_date`` replays what was known on a day.
    """
    cutoff = params.arrival_cutoff_date
    sources = [
        (_arrived(items, cutoff, "order_arrival_date"), lambda d: daily_sales(d, promotions)),
        (_arrived(movements, cutoff, "arrival_date"), daily_stock),
        (_arrived(hours, cutoff, None), daily_availability),
        (_arrived(clicks, cutoff, None), daily_browsing),
    ]
    if rebuild_from is not None:
        read_from = F.date_sub(F.lit(rebuild_from), params.trailing_window_days)
        sources = [(df.filter(F.col("date_day") >= read_from), fn) for df, fn in sources]
    return store_sku_days([fn(df) for df, fn in sources], products, curve, params, rebuild_from)


def store_sku_days(
    parts: Sequence[DataFrame], products: DataFrame, curve: DataFrame, params: Params, rebuild_from=None
) -> DataFrame:
    """``agg_store_sku_day`` from its four parts: sales, stock, availability and browsing by cell."""
    # The four inputs have disjoint columns, so stacking them and grouping once is the key spine
    # and all four lookups together: no sort, and no join that could skew.
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    cells = stacked.groupBy(*CELL).agg(*[F.max(c).alias(c) for c in stacked.columns if c not in CELL])
    additive = [
        "units_sold", "gross_units", "returned_units", "order_count", "net_revenue", "gross_revenue", "discount_value",
        "cogs", "gross_margin", "markdown_units", "markdown_subsidy_platform", "markdown_subsidy_brand",
        "received_units", "received_value", "writeoff_units", "writeoff_value", "net_movement", "hours_carried",
        "hours_in_stock", "opening_units", "browse_events", "censored_browse_events",
    ]
    filled = cells.fillna(0, additive).fillna(False, ["is_censored"])
    recent = (
        Window.partitionBy("store_id", "sku_id").orderBy("date_day").rowsBetween(-params.trailing_window_days, -1)
    )
    trailed = filled.withColumn("trailing_7d_avg_units", F.coalesce(F.avg("units_sold").over(recent), F.lit(0.0)))
    if rebuild_from is not None:
        trailed = trailed.filter(F.col("date_day") >= F.lit(rebuild_from))
    known = trailed.join(products.select("sku_id", "l1_category", "is_private_label"), "sku_id", "left").join(
        curve.select(
            "l1_category", F.col("hour_ist").alias("ran_out_at_hour"),
            F.col("cumulative_share_before").alias("demand_share_before_stockout"),
        ),
        ["l1_category", "ran_out_at_hour"],
        "left",
    )
    sold = F.col("units_sold").cast("double")
    exposed = F.coalesce("demand_share_before_stockout", F.lit(0.0)) >= params.min_arrival_exposure
    scaled = F.round(sold / F.nullif(F.col("demand_share_before_stockout"), F.lit(0.0)))
    return known.withColumns(
        {
            "store_sku_day_key": row_hash(CELL),
            "closing_units": F.col("opening_units") + F.col("net_movement"),
            "base_price_avg": ratio(F.col("gross_revenue"), F.col("units_sold")),
            "realized_price_avg": ratio(F.col("net_revenue"), F.col("units_sold")),
            "in_stock_pct": ratio(F.col("hours_in_stock"), F.col("hours_carried")),
            "avg_dte_at_sale": ratio(F.col("dte_weighted_units"), F.col("units_sold")),
            "units_demanded_imputed": F.when(~F.col("is_censored"), sold)
            .when(exposed, F.greatest(sold, scaled))
            .otherwise(F.greatest(sold, F.round("trailing_7d_avg_units"))),
            "demand_imputation_method": F.when(~F.col("is_censored"), "observed")
            .when(exposed, "arrival_curve_scaled")
            .otherwise("trailing_mean"),
        }
    ).drop("dte_weighted_units", "net_movement")
