"""Fifteen questions asked of the warehouse, each a function of it returning a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import changed, hour_number, sum_where
from larder.functions.ordered import global_running, islands, latest_per_key, run_window, running_sum, top_per_group
from larder.functions.ranges import band_of, in_force
from larder.operators.facts import RECEIPT_EVENTS
from larder.sources.seeds import DTE_BANDS


def tidy(value: Column, digits: int) -> Column:
    """Round for display; the inner rounding removes the noise of distributed addition."""
    return F.round(F.round(value, digits + 4), digits)


def percent(part: Column, whole: Column) -> Column:
    return F.lit(100.0) * part / F.nullif(whole.cast("double"), F.lit(0.0))


def how_many(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def running_balance(wh, limit: int = 50) -> DataFrame:
    """Replay every batch's ledger, compare with the stored balance, list what is left."""
    replayed = running_sum(
        wh("fct_inventory_movement").select(
            "batch_id", "store_id", "sku_id", "movement_seq", "event_type", "qty_delta", "running_balance"
        ),
        ["batch_id"], F.floor(F.col("movement_seq") / wh.params.ledger_slice_width), ["movement_seq"],
        "qty_delta", "recomputed",
    )
    return (
        replayed.groupBy("batch_id", "store_id", "sku_id")
        .agg(
            F.count("*").alias("movements"),
            F.max_by("recomputed", "movement_seq").alias("closing_units"),
            how_many(F.col("event_type") == "expiry_writeoff").alias("writeoff_events"),
            how_many(changed(F.col("recomputed"), F.col("running_balance"))).alias("disagreements"),
        )
        .filter("closing_units > 0")
        .orderBy(F.desc("closing_units"), "batch_id")
        .limit(limit)
    )


def fefo_queue(wh, limit: int | None = 50) -> DataFrame:
    """Open batches in picking order, and what each will not sell before it expires."""
    daily = wh("agg_store_sku_day")
    as_of = daily.agg(F.max("date_day")).scalar()
    rate = daily.filter(F.col("date_day") == as_of).select(
        "store_id", "sku_id", F.col("trailing_7d_avg_units").alias("rate")
    )
    open_batches = (
        wh("fct_inventory_batch")
        .filter((F.col("qty_remaining") > 0) & (F.col("expiry_date") >= as_of))
        .select("batch_id", "store_id", "sku_id", "expiry_date", "qty_remaining")
        .withColumn("days_left", F.datediff("expiry_date", as_of))
    )
    queued = running_sum(
        open_batches, ["store_id", "sku_id"], F.col("expiry_date"), ["batch_id"], "qty_remaining",
        "units_ahead_in_queue", inclusive=False,
    ).join(rate, ["store_id", "sku_id"], "left")
    expected = F.coalesce("rate", F.lit(0.0)) * F.col("days_left")
    out = queued.select(
        "store_id", "sku_id", "batch_id", "expiry_date", "days_left", "qty_remaining", "units_ahead_in_queue",
        tidy(F.coalesce("rate", F.lit(0.0)), 2).alias("daily_units"),
        tidy(expected, 1).alias("demand_before_expiry"),
        F.round(
            F.greatest(F.lit(0.0), F.col("qty_remaining") - F.greatest(F.lit(0.0), expected - F.col("units_ahead_in_queue"))),
            6,
        ).alias("units_expected_to_expire"),
    )
    if limit is None:
        return out
    return out.orderBy(F.desc("units_expected_to_expire"), "expiry_date", "batch_id").limit(limit)


def cohort_pivot(wh) -> DataFrame:
    months = list(range(1, 7))
    wide = (
        wh("mart_cohort_retention")
        .filter(F.col("month_index").between(1, 6))
        .groupBy("cohort_month", "cohort_size", "months_observed")
        .pivot("month_index", months)
        .agg(F.first("retention_rate"))
    )
    return wide.select(
        "cohort_month", "cohort_size", "months_observed",
        *[tidy(F.col(str(m)) * 100, 1).alias(f"m{m}_pct") for m in months],
    ).orderBy("cohort_month")


def browse_bursts(wh, min_hours: int = 3, limit: int | None = 50) -> DataFrame:
    """Runs of consecutive hours with product views, three hours or longer."""
    hourly = (
        wh("fct_clickstream")
        .filter(F.col("event_type") == "pdp_view")
        .groupBy("store_id", "sku_id", "hour_ts_ist")
        .agg(
            F.sum("event_count").alias("events"),
            F.min(~F.col("was_in_stock")).alias("never_in_stock"),
            F.sum("censored_event_count").alias("censored_events"),
        )
    )
    hour = hour_number(F.col("hour_ts_ist"))
    seq = F.row_number().over(run_window(["store_id", "sku_id"], "hour_ts_ist"))
    bursts = (
        hourly.withColumn("island", hour - seq)
        .groupBy("store_id", "sku_id", "island")
        .agg(
            F.min("hour_ts_ist").alias("burst_started"),
            F.max("hour_ts_ist").alias("burst_ended"),
            F.count("*").alias("hours_in_burst"),
            F.sum("events").alias("events"),
            F.sum("censored_events").alias("censored_events"),
            F.min("never_in_stock").alias("empty_shelf_throughout"),
        )
        .filter(F.col("hours_in_burst") >= min_hours)
        .drop("island")
    )
    if limit is None:
        return bursts
    return bursts.orderBy(
        F.desc("hours_in_burst"), F.desc("events"), "store_id", "sku_id", "burst_started"
    ).limit(limit)


def stockout_runs(wh, limit: int = 50) -> DataFrame:
    """Out-of-stock intervals stitched across midnight into runs, summed per store and SKU."""
    keys = ["store_id", "sku_id"]
    out = wh("fct_availability_hour").filter(~F.col("is_in_stock")).select(
        *keys, F.col("hour_ts_ist").alias("starts_at"), F.col("valid_to_hour_ts_ist").alias("ends_at"), "hours_in_state"
    )
    gap = changed(F.lag("ends_at").over(run_window(keys, "starts_at")), F.col("starts_at"))
    runs = islands(out, keys, "starts_at", gap, "run_id").groupBy(*keys, "run_id").agg(
        F.sum("hours_in_state").alias("hours_out")
    )
    per_series = runs.groupBy(*keys).agg(
        F.count("*").alias("stockout_runs"),
        F.sum("hours_out").alias("total_hours_out"),
        F.avg("hours_out").alias("mean_hours"),
        F.max("hours_out").alias("longest_run_hours"),
    )
    return (
        per_series.filter("total_hours_out > 0")
        .join(wh("dim_product").select("sku_id", "sku_name", "l1_category"), "sku_id")
        .withColumn("avg_hours_per_run", tidy(F.col("mean_hours"), 1))
        .withColumn("worst_vs_typical", tidy(F.col("longest_run_hours") / F.nullif("mean_hours", F.lit(0.0)), 1))
        .drop("mean_hours")
        .orderBy(F.desc("longest_run_hours"), F.desc("total_hours_out"), *keys)
        .limit(limit)
    )


def basket_pairs(baskets: DataFrame, min_orders: int, large_basket: int = 64, salts: int = 32) -> DataFrame:
    """Orders holding both SKUs of a pair, for pairs in at least ``min_orders`` orders.

    A pair can be no more frequent than its rarer SKU, so SKUs below the threshold drop out
    before the join without losing a pair. A large basket is spread over ``salts`` tasks.
    """
    support = baskets.groupBy("sku_id").agg(F.count("*").alias("n")).filter(F.col("n") >= min_orders)
    likely = baskets.join(support.select("sku_id"), "sku_id", "left_semi")
    # Baskets hold distinct SKUs, so one order is never longer than the catalogue. Hashing on the
    # order once serves its size and, for ordinary baskets, both sides of the pairing.
    size = F.count("*").over(Window.partitionBy("order_id"))
    sized = likely.repartition("order_id").withColumn("size", size)

    def pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        return left.withColumnRenamed("sku_id", "sku_a").join(right.withColumnRenamed("sku_id", "sku_b"), on).filter(
            F.col("sku_a") < F.col("sku_b")
        ).select("sku_a", "sku_b")

    small = sized.filter((F.col("size") > 1) & (F.col("size") <= large_basket)).select("order_id", "sku_id")
    large = sized.filter(F.col("size") > large_basket).select("order_id", "sku_id")
    spread = large.withColumn("salt", F.pmod(F.xxhash64("sku_id"), F.lit(salts)))
    copied = large.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return (
        pairs(small, small, ["order_id"]).unionByName(pairs(spread, copied, ["order_id", "salt"]))
        .groupBy("sku_a", "sku_b")
        .agg(F.count("*").alias("orders_with_both"))
        .filter(F.col("orders_with_both") >= min_orders)
    )


def market_basket(wh, min_orders: int = 200, limit: int = 30) -> DataFrame:
    baskets = wh("fct_order_item").filter(F.col("line_type") == "sale").select("order_id", "sku_id").distinct()
    support = baskets.groupBy("sku_id").agg(F.count("*").alias("n"))
    orders = baskets.agg(F.countDistinct("order_id")).scalar()
    named = wh("dim_product").select("sku_id", "sku_name", "l1_category").join(support, "sku_id")

    def side(tag: str) -> DataFrame:
        return named.select(
            F.col("sku_id").alias(f"sku_{tag}"), F.col("sku_name").alias(f"name_{tag}"),
            F.col("l1_category").alias(f"category_{tag}"), F.col("n").alias(f"n_{tag}"),
        )

    both, n_a, n_b = F.col("orders_with_both"), F.col("n_a"), F.col("n_b")
    return (
        basket_pairs(baskets, min_orders)
        .join(side("a"), "sku_a")
        .join(side("b"), "sku_b")
        .withColumn("orders", orders)
        .withColumn("support_pct", tidy(both * 100.0 / F.col("orders"), 3))
        .withColumn("lift", tidy(both * F.col("orders").cast("double") / (n_a * n_b), 2))
        .drop("n_a", "n_b", "orders")
        .orderBy(F.desc("lift"), F.desc("orders_with_both"), "sku_a", "sku_b")
        .limit(limit)
    )


def abc_xyz_recheck(wh, limit: int = 50) -> DataFrame:
    """The classification recomputed from the daily table, beside the one in the dimension."""
    daily = wh("agg_store_sku_day").groupBy("sku_id", "date_day").agg(
        F.sum("units_sold").alias("units"), F.sum("net_revenue").alias("revenue")
    )
    per_sku = (
        daily.groupBy("sku_id")
        .agg(F.round(F.sum("revenue"), 2).alias("revenue"), (F.stddev_samp("units") / F.nullif(F.avg("units"), F.lit(0.0))).alias("cv"))
        .filter("revenue > 0")
    )
    total = per_sku.agg(F.sum("revenue")).scalar()
    ranked = global_running(per_sku, [F.desc("revenue"), F.asc("sku_id")], {"running": F.col("revenue")}).withColumn(
        "share", F.col("running") / total
    )
    classes = ranked.select(
        "sku_id", "revenue",
        tidy(F.col("share") * 100, 2).alias("cumulative_share_pct"),
        F.when(F.col("share") <= 0.80, "A").when(F.col("share") <= 0.95, "B").otherwise("C").alias("abc_recomputed"),
        F.when(F.col("cv") < 0.5, "X").when(F.col("cv") < 1.0, "Y").otherwise("Z").alias("xyz_recomputed"),
        tidy(F.col("cv"), 3).alias("demand_cv"),
    )
    known = wh("dim_product").select("sku_id", "sku_name", "l1_category", F.col("abc_xyz_class").alias("class_in_dimension"))
    return (
        classes.join(known, "sku_id")
        .withColumn("disagrees_with_dimension", F.concat("abc_recomputed", "xyz_recomputed") != F.col("class_in_dimension"))
        .orderBy(F.desc("revenue"), "sku_id")
        .limit(limit)
    )


def month_over_month(wh) -> DataFrame:
    monthly = (
        wh("agg_store_sku_day")
        .join(wh("dim_product").select("sku_id", F.col("l1_category").alias("category")), "sku_id")
        .groupBy(F.col("category").alias("l1_category"), F.trunc("date_day", "month").alias("month_start"))
        .agg(F.round(F.sum("net_revenue"), 2).alias("revenue"), F.countDistinct("date_day").alias("days_in_month"))
        .withColumn("per_day", F.col("revenue") / F.col("days_in_month"))
    )
    festivals = wh("dim_date").groupBy(F.col("month_start_date").alias("month_start")).agg(
        how_many(F.col("is_festival")).alias("festival_days")
    )
    w = run_window(["l1_category"], "month_start")
    lagged = monthly.withColumns(
        {"prev": F.lag("revenue").over(w), "prev_per_day": F.lag("per_day").over(w)}
    ).filter("prev is not null")
    step, step_per_day = F.col("revenue") - F.col("prev"), F.col("per_day") - F.col("prev_per_day")
    return (
        lagged.join(festivals, "month_start", "left")
        .select(
            "l1_category", "month_start", "days_in_month", F.coalesce("festival_days", F.lit(0)).alias("festival_days"),
            tidy(F.col("revenue"), 0).alias("revenue"),
            tidy(F.col("per_day"), 0).alias("revenue_per_day"),
            tidy(percent(step, F.col("prev")), 1).alias("mom_pct"),
            tidy(percent(step_per_day, F.col("prev_per_day")), 1).alias("mom_per_day_pct"),
            (F.signum(step) != F.signum(step_per_day)).alias("calendar_flipped_the_sign"),
        )
        .orderBy("l1_category", "month_start")
    )


def availability_funnel(wh) -> DataFrame:
    """From looking at a product to being served, by category."""
    cell = ["store_id", "sku_id", "date_day"]
    view = F.col("event_type") == "pdp_view"
    browse = wh("fct_clickstream").groupBy(*cell).agg(
        sum_where(F.col("event_count"), view).alias("pdp_views"),
        sum_where(F.col("event_count"), F.col("event_type") == "notify_me").alias("notify_me_events"),
        sum_where(F.col("event_count"), view & ~F.col("was_in_stock")).alias("views_against_empty_shelf"),
    )
    served = wh("agg_store_sku_day").select(
        *cell, F.col("order_count").alias("orders"), F.col("units_sold").alias("units_served"), "units_demanded_imputed", "in_stock_pct"
    )
    sums = ["pdp_views", "notify_me_events", "views_against_empty_shelf", "orders", "units_served"]
    return (
        browse.join(served, cell)
        .join(wh("dim_product").select("sku_id", "l1_category"), "sku_id")
        .groupBy("l1_category")
        .agg(
            *[F.sum(c).alias(c) for c in sums],
            F.sum("units_demanded_imputed").alias("demanded"),
            tidy(F.avg("in_stock_pct") * 100, 1).alias("avg_in_stock_pct"),
        )
        .withColumns(
            {
                "units_demanded_imputed": tidy(F.col("demanded"), 0),
                "browse_to_order_pct": tidy(percent(F.col("orders"), F.col("pdp_views")), 1),
                "demand_served_pct": tidy(percent(F.col("units_served"), F.col("demanded")), 1),
                "browsed_an_empty_shelf_pct": tidy(percent(F.col("views_against_empty_shelf"), F.col("pdp_views")), 1),
            }
        )
        .drop("demanded")
        .orderBy(F.desc("browsed_an_empty_shelf_pct"), "l1_category")
    )


def top_sellers(wh, n: int = 3, estate_cut: int = 20) -> DataFrame:
    """Best sellers of each store, and whether the estate as a whole agrees."""
    store_sku = wh("agg_store_sku_day").groupBy("store_id", "sku_id").agg(
        F.round(F.sum("net_revenue"), 2).alias("revenue"), F.sum("units_sold").alias("units")
    )
    by_sku = store_sku.groupBy("sku_id").agg(F.round(F.sum("revenue"), 2).alias("total"))
    estate = global_running(by_sku, [F.desc("total"), F.asc("sku_id")], {"estate_rank": F.lit(1)}).select(
        "sku_id", F.col("estate_rank").cast("int").alias("estate_rank")
    )
    best = top_per_group(store_sku, ["store_id"], [F.desc("revenue"), F.asc("sku_id")], n, "rank_in_store")
    return (
        best.join(wh("dim_store").select("store_id", "store_name", "locality", "catchment_tier"), "store_id")
        .join(wh("dim_product").select("sku_id", "sku_name", "l1_category"), "sku_id")
        .join(estate, "sku_id")
        .withColumn("revenue", tidy(F.col("revenue"), 0))
        .withColumn("local_only", F.col("estate_rank") > estate_cut)
        .orderBy("store_name", "rank_in_store")
    )


def current_prices(wh, limit: int = 50) -> DataFrame:
    """Latest price interval of every promoted store-SKU, with the count of duplicated lines."""
    columns = ["store_id", "sku_id", "interval_no", "effective_from_date", "base_price", "realized_price",
               "discount_pct", "promo_id", "is_open_at_window_end"]
    current = latest_per_key(
        wh("fct_price_history").select(*columns), ["store_id", "sku_id"], ["effective_from_date", "interval_no"]
    ).filter("promo_id is not null")
    duplicated = (
        wh("fct_order_item").groupBy("order_item_key").agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*")).scalar()
    )
    return (
        current.join(wh("dim_product").select("sku_id", "sku_name"), "sku_id")
        .withColumns(
            {
                "discount_pct": tidy(F.col("discount_pct"), 3),
                "on_promotion": F.col("promo_id").isNotNull(),
                "duplicate_order_lines": duplicated,
            }
        )
        .orderBy(F.desc("discount_pct"), "store_id", "sku_id")
        .limit(limit)
    )


def point_in_time_margin(wh, limit: int = 40) -> DataFrame:
    """Margin at the cost in force on the day of sale, against margin at today's cost."""
    sales = (
        wh("fct_order_item").filter(F.col("line_type") == "sale").groupBy("sku_id", "date_day")
        .agg(F.sum("units").alias("units"), F.sum("net_revenue").alias("revenue"))
    )
    versions = wh("dim_product_snapshot").select(
        "sku_id", "version_no", "valid_from_date", "valid_to_date", F.col("landed_cost").alias("cost_then")
    )
    today = wh("dim_product").select("sku_id", "sku_name", "l1_category", "landed_cost")
    dated = in_force(sales, versions, ["sku_id"], "date_day", "valid_from_date", "valid_to_date").join(today, "sku_id")
    per_sku = dated.groupBy("sku_id", "sku_name", "l1_category").agg(
        F.countDistinct("version_no").alias("versions_used"),
        F.sum("units").alias("units"),
        F.sum("revenue").alias("revenue"),
        F.round(F.sum(F.col("revenue") - F.col("units") * F.col("cost_then")), 2).alias("then"),
        F.round(F.sum(F.col("revenue") - F.col("units") * F.col("landed_cost")), 2).alias("now"),
    ).filter("versions_used > 1")
    error = F.col("now") - F.col("then")
    return (
        per_sku.withColumn("gap", F.round(F.abs(error), 2))
        .select(
            "sku_id", "sku_name", "l1_category", "versions_used", "units", "gap",
            tidy(F.col("revenue"), 0).alias("revenue"),
            tidy(F.col("then"), 0).alias("margin_point_in_time"),
            tidy(F.col("now"), 0).alias("margin_current_cost"),
            tidy(error, 0).alias("error_inr"),
            tidy(percent(error, F.col("then")), 2).alias("error_pct"),
        )
        .orderBy(F.desc("gap"), "sku_id")
        .limit(limit)
        .drop("gap")
    )


def expiry_decisions(wh) -> DataFrame:
    """What was decided about the stock at risk, by category. Needs the expiry and markdown jobs."""
    risk = wh("mart_expiry_risk").filter(F.col("risk_state") == "at_risk")
    decided = wh("rec_markdown").select("batch_id", "decision")
    decision = F.col("decision")
    return (
        risk.join(decided, "batch_id", "left")
        .groupBy("l1_category")
        .agg(
            F.count("*").alias("batches_at_risk"),
            tidy(F.sum("value_at_risk_inr"), 0).alias("value_at_risk_inr"),
            tidy(F.sum("units_at_risk"), 0).alias("units_at_risk"),
            tidy(F.avg("days_to_expiry"), 1).alias("avg_days_to_expiry"),
            tidy(F.avg("expiry_risk_score"), 3).alias("avg_risk_score"),
            how_many(decision == "markdown").alias("marked_down"),
            how_many(decision == "hold_price").alias("held_price"),
            how_many(decision == "no_recommendation").alias("no_coefficient"),
        )
        .withColumn("pct_of_at_risk_acted_on", tidy(percent(F.col("marked_down"), F.col("batches_at_risk")), 1))
        .orderBy(F.desc("value_at_risk_inr"), "l1_category")
    )


def naive_promotion_lift(wh, min_days: int = 30) -> DataFrame:
    """Discounted against regular days by category and freshness, with no model."""
    base, paid = F.col("base_price_avg"), F.col("realized_price_avg")
    days = (
        wh("agg_store_sku_day").filter((F.col("units_sold") > 0) & (base > 0))
        .select(
            "l1_category", "units_sold", band_of(F.col("min_dte_at_sale"), DTE_BANDS).alias("dte_band"),
            (paid / F.nullif(base, F.lit(0.0))).alias("price_ratio"),
            (F.round(paid, 6) < F.round(base * 0.98, 6)).alias("cut"),
        )
        .filter("dte_band is not null")
    )
    cut, regular = F.col("cut"), ~F.col("cut")
    return (
        days.groupBy("l1_category", "dte_band")
        .agg(
            how_many(cut).alias("discounted_days"),
            how_many(regular).alias("regular_days"),
            F.avg(F.when(regular, F.col("units_sold"))).alias("units_regular"),
            F.avg(F.when(cut, F.col("units_sold"))).alias("units_discounted"),
            F.avg(F.when(cut, F.col("price_ratio"))).alias("avg_price_ratio"),
        )
        .filter((F.col("discounted_days") >= min_days) & (F.col("regular_days") >= min_days))
        .withColumn(
            "naive_lift_pct", tidy(percent(F.col("units_discounted") - F.col("units_regular"), F.col("units_regular")), 1)
        )
        .withColumns(
            {
                "units_regular": tidy(F.col("units_regular"), 2),
                "units_discounted": tidy(F.col("units_discounted"), 2),
                "avg_price_ratio": tidy(F.col("avg_price_ratio"), 3),
            }
        )
    )


def promotion_lift_vs_fitted(wh) -> DataFrame:
    """The naive lift beside the elasticity fitted for the same cell."""
    fitted = wh("mart_price_elasticity").select(
        "l1_category", "dte_band", F.round("elasticity", 4).alias("fitted_elasticity"), "is_identified",
        "elasticity_basis", "observations",
    )
    return naive_promotion_lift(wh).join(fitted, ["l1_category", "dte_band"], "left").orderBy(
        F.desc("naive_lift_pct"), "l1_category", "dte_band"
    )


def inventory_reconciliation(wh) -> DataFrame:
    """Two accounts of every batch, and how often they disagree."""
    units, event = F.col("units"), F.col("event_type")
    moved = wh("fct_inventory_movement").groupBy("batch_id").agg(
        sum_where(units, event.isin(*RECEIPT_EVENTS)).alias("m_received"),
        sum_where(units, event == "sale").alias("m_sold"),
        sum_where(units, event == "expiry_writeoff").alias("m_written_off"),
        F.sum("qty_delta").alias("m_balance"),
        F.lit(True).alias("in_movements"),
    )
    ledger = wh("fct_inventory_batch").select(
        "batch_id", F.col("qty_received").alias("l_received"), F.col("qty_sold").alias("l_sold"),
        F.col("qty_written_off").alias("l_written_off"), F.col("qty_remaining").alias("l_remaining"), "is_reconciled",
        F.lit(True).alias("in_ledger"),
    )
    amounts = ["m_received", "m_sold", "m_written_off", "m_balance", "l_received", "l_sold", "l_written_off", "l_remaining"]
    both = ledger.join(moved, "batch_id", "full_outer").fillna(0, amounts).fillna(
        False, ["in_movements", "in_ledger", "is_reconciled"]
    )
    both = both.withColumns(
        {
            "l_gap": F.expr("l_received - l_sold - l_written_off - l_remaining"),
            "m_gap": F.expr("m_received - m_sold - m_written_off - m_balance"),
            "received_gap": F.expr("l_received - m_received"),
            "sold_gap": F.expr("l_sold - m_sold"),
        }
    )
    return both.groupBy("is_reconciled").agg(
        F.count("*").alias("batches"),
        how_many(~F.col("in_ledger")).alias("missing_from_ledger"),
        how_many(~F.col("in_movements")).alias("missing_from_movements"),
        how_many(F.col("l_gap") != 0).alias("ledger_identity_broken"),
        how_many(F.col("m_gap") != 0).alias("movement_identity_broken"),
        how_many(F.col("received_gap") != 0).alias("received_disagrees"),
        how_many(F.col("sold_gap") != 0).alias("sold_disagrees"),
        F.sum(F.abs("l_gap")).alias("total_abs_ledger_residual"),
        F.max(F.abs("received_gap")).alias("worst_received_gap"),
        F.max(F.abs("sold_gap")).alias("worst_sold_gap"),
    ).orderBy(F.desc("is_reconciled"))
