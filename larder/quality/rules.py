"""Thirty-one statements about the warehouse; each returns the rows that break it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import changed, ratio, sum_where
from larder.functions.ordered import run_window
from larder.functions.ranges import expand_days, in_force
from larder.operators.facts import price_days
from larder.operators.staging import ITEM_COLUMNS
from larder.workspace import in_turn

CENT = 0.01
# Fixed value: days the click feed is documented to have been down.
DECLARED_OUTAGE = {"clickstream": 2}
LINE = ["order_id", "sku_id", "batch_id"]
CELL = ["store_id", "sku_id", "date_day"]


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row frames as one row."""
    return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one").drop("_one")


def _apart(a: str, b: str, tolerance: float = CENT):
    return F.abs(F.coalesce(a, F.lit(0.0)) - F.coalesce(b, F.lit(0.0))) > tolerance


def _raw_lines(wh) -> DataFrame:
    """Lines straight from the raw feeds: copies dropped, returns priced by the sale they reverse."""
    items = wh.feed("pos_order_items").select(*ITEM_COLUMNS).distinct()
    sold = items.filter("qty > 0").select(*LINE, F.col("unit_realized_price").alias("price"))
    back = wh.feed("pos_returns").join(sold, LINE).select("order_id", (-F.col("qty")).alias("qty"), "price")
    lines = items.select("order_id", "qty", F.col("unit_realized_price").alias("price")).unionByName(back)
    return lines.join(wh.feed("pos_orders").select("order_id").distinct(), "order_id", "left_semi")


def _raw_totals(wh) -> DataFrame:
    """Number, units and revenue of the raw lines; a warehouse works them out once for the rules that compare them."""

    def totals() -> DataFrame:
        return _raw_lines(wh).agg(
            F.count("*").alias("raw_n"), F.sum("qty").alias("raw_units"), F.sum(F.col("qty") * F.col("price")).alias("raw_revenue")
        )

    return wh.derive("raw_totals", totals) if hasattr(wh, "derive") else totals()


def agg_revenue_ties_to_raw_order_totals(wh):
    raw = _raw_totals(wh).drop("raw_n")
    agg = wh("agg_store_sku_day").agg(F.sum("units_sold").alias("units"), F.sum("net_revenue").alias("revenue"))
    return _beside(agg, raw).filter((F.col("units") != F.col("raw_units")) | _apart("revenue", "raw_revenue"))


def availability_intervals_cover_every_carried_day(wh):
    return wh("fct_availability_hour").groupBy(*CELL).agg(F.sum("hours_in_state").alias("hours")).filter("hours <> 24")


def clickstream_counts_tie_to_the_raw_feed(wh):
    fact = wh("fct_clickstream").agg(F.sum("event_count").alias("n"), F.sum("censored_event_count").alias("dry"))
    raw = wh.feed("clickstream").agg(F.count("*").alias("raw_n"), F.count(F.when(~F.col("was_in_stock"), 1)).alias("raw_dry"))
    return _beside(fact, raw).filter("n <> raw_n or dry <> raw_dry")


def clickstream_demand_peaks_in_the_evening(wh):
    hour = F.col("event_hour_ist")
    return wh("stg_web__clickstream").agg(
        F.count(F.when(hour.between(17, 22), 1)).alias("evening"), F.count(F.when(hour.between(0, 4), 1)).alias("small_hours")
    ).filter("evening <= small_hours")


def denormalised_store_and_day_match_the_order_header(wh):
    header = wh("stg_pos__orders").select("order_id", F.col("store_id").alias("h_store"), F.col("order_date_ist").alias("h_day"))
    return wh("fct_order_item").join(header, "order_id").filter(
        changed(F.col("store_id"), F.col("h_store")) | changed(F.col("date_day"), F.col("h_day"))
    )


def every_batch_resolves_to_a_supplier(wh):
    return wh("fct_inventory_batch").join(wh("dim_supplier"), "supplier_id", "left_anti")


def late_arrivals_stay_within_the_lookback(wh):
    return wh("stg_pos__orders").filter(~F.col("arrival_lag_days").between(0, wh.params.late_arrival_lookback_days))


def no_source_partition_is_missing_undeclared(wh):
    coverage = wh("dq_source_coverage")
    declared = F.coalesce(
        F.create_map(*[F.lit(x) for pair in DECLARED_OUTAGE.items() for x in pair])[F.col("source_name")], F.lit(0)
    )
    gaps = coverage.filter("is_missing_partition").groupBy("source_name").agg(F.count("*").alias("missing_days"))
    stale = coverage.filter("is_stale").groupBy("source_name").agg(F.lit(0).cast("long").alias("missing_days"))
    return gaps.filter(F.col("missing_days") > declared).unionByName(stale)


def nothing_is_dropped_without_being_quarantined(wh):
    held = wh("stg_quarantine").groupBy("source_name").agg(F.count("*").alias("held"))
    counts = None
    for feed, kept in (
        ("wms_inventory_movement", wh("stg_wms__inventory_movements")),
        ("pos_returns", wh("stg_pos__order_lines").filter(F.col("source_feed") == "pos_returns")),
    ):
        row = _beside(wh.feed(feed).agg(F.count("*").alias("raw")), kept.agg(F.count("*").alias("kept"))).withColumn("source_name", F.lit(feed))
        counts = row if counts is None else counts.unionByName(row)
    return counts.join(held, "source_name", "left").filter("kept + coalesce(held, 0) <> raw")


def order_daily_denominators_are_consistent(wh):
    return wh("mart_order_daily").filter("orders_count + unfulfilled_orders <> placed_orders")


def order_daily_ties_to_the_sku_aggregate(wh):
    sums = ["net_revenue", "cogs", "gross_margin"]
    daily = wh("mart_order_daily").agg(*[F.sum(c).alias(f"d_{c}") for c in sums])
    cells = wh("agg_store_sku_day").agg(*[F.sum(c).alias(f"c_{c}") for c in sums])
    apart = _apart("d_net_revenue", "c_net_revenue") | _apart("d_cogs", "c_cogs") | _apart("d_gross_margin", "c_gross_margin")
    return _beside(daily, cells).filter(apart)


def order_items_tie_to_the_raw_feed(wh):
    raw = _raw_totals(wh).drop("raw_units")
    fact = wh("fct_order_item").agg(F.count("*").alias("n"), F.sum("net_revenue").alias("revenue"))
    return _beside(fact, raw).filter((F.col("n") != F.col("raw_n")) | _apart("revenue", "raw_revenue"))


def pack_size_is_physically_plausible(wh):
    unit, qty = F.lower("uom"), F.col("pack_qty")
    return wh("stg_catalog__products").filter(
        (qty <= 0) | (unit.isin("g", "ml") & (qty < 1)) | (unit.isin("kg", "l") & (qty > 100))
    )


def _both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).unionByName(b.exceptAll(a))


def price_intervals_expand_back_to_the_ledger(wh):
    keep = ["store_id", "sku_id", "effective_date", "base_price", "realized_price", "promo_id"]
    ledger = price_days(wh("stg_catalog__price_history"), wh("dim_promotion")).select(*keep)
    spans = expand_days(wh("fct_price_history"), F.col("effective_from_date"), F.col("effective_to_date"), "effective_date")
    return _both_ways(ledger, spans.select(*keep))


def product_history_covers_every_sale(wh):
    sales = wh("fct_order_item").select("sku_id", "date_day").distinct()
    versions = wh("dim_product_snapshot").select("sku_id", "version_no", "valid_from_date", "valid_to_date")
    found = in_force(sales, versions, ["sku_id"], "date_day", "valid_from_date", "valid_to_date", "left")
    return found.groupBy("sku_id", "date_day").agg(F.count("version_no").alias("versions")).filter("versions <> 1")


def product_versions_are_contiguous(wh):
    w = run_window(["sku_id"], "version_no")
    versions = wh("dim_product_snapshot")
    broken = versions.withColumn("next_from", F.lead("valid_from_date").over(w)).filter(
        changed(F.col("next_from"), F.col("valid_to_date"))
    ).select("sku_id", "version_no")
    not_one_open = versions.groupBy("sku_id").agg(F.count(F.when(F.col("is_current"), 1)).alias("n")).filter("n <> 1")
    return broken.unionByName(not_one_open.select("sku_id", F.lit(None).cast("bigint").alias("version_no")))


def product_versions_expand_back_to_the_daily_catalogue(wh):
    end = F.coalesce("valid_to_date", F.date_add("last_seen_date", 1))
    keep = ["sku_id", "snapshot_date", "landed_cost", "base_price"]
    expanded = expand_days(wh("dim_product_snapshot"), F.col("valid_from_date"), end, "snapshot_date")
    return _both_ways(wh("stg_catalog__products").select(*keep), expanded.select(*keep))


def readout_rows_are_measured_or_explained(wh):
    figures = F.col("policy_a").isNull() | F.col("policy_b").isNull() | F.col("delta").isNull()
    reason = F.coalesce(F.trim("not_applicable_reason"), F.lit(""))
    measured = F.col("is_measured")
    return wh("mart_experiment_readout").filter((measured & figures) | (~measured & (reason == "")))


def returns_never_re_enter_the_stock_ledger(wh):
    known = ("inbound", "opening_balance", "sale", "expiry_writeoff")
    return wh("fct_inventory_movement").filter(~F.col("event_type").isin(*known)).groupBy("event_type").agg(F.count("*").alias("n"))


def returns_reconcile_across_encodings(wh):
    items, value = wh("stg_pos__order_items"), F.col("qty") * F.col("unit_realized_price")
    sold = items.filter("qty > 0").select(*LINE, "unit_realized_price")
    back = wh("stg_pos__returns").join(sold, LINE).agg(F.sum(F.col("returned_qty") * F.col("unit_realized_price")).alias("back"))
    gross = items.agg(F.coalesce(F.sum(value), F.lit(0.0)).alias("net_items"))
    lines = wh("stg_pos__order_lines").agg(F.sum(F.col("signed_qty") * F.col("unit_realized_price")).alias("lines"))
    both = _beside(_beside(gross, back), lines).withColumn("expected", F.col("net_items") - F.coalesce("back", F.lit(0.0)))
    return both.filter(_apart("lines", "expected"))


def shelf_life_at_sale_is_possible(wh):
    life = wh("dim_product").select("sku_id", "shelf_life_days")
    return wh("fct_order_item").join(life, "sku_id").filter("dte_at_sale < 0 or dte_at_sale > shelf_life_days")


def stacked_promotions_agree_on_price(wh):
    return (
        wh("stg_catalog__price_history").groupBy("store_id", "sku_id", "effective_date")
        .agg(F.count("*").alias("n"), F.min("realized_price").alias("a"), F.max("realized_price").alias("b"))
        .filter("n > 1 and a <> b")
    )


def stacked_promotions_attribute_to_the_price_setter(wh):
    depth = wh("dim_promotion").select("promo_id", "observed_depth_pct")
    stacked = wh("fct_price_history").filter("is_promo_stacked")
    contenders = (
        stacked.select("price_interval_key", F.explode("stacked_promo_ids").alias("promo_id"))
        .join(depth, "promo_id").groupBy("price_interval_key").agg(F.max("observed_depth_pct").alias("deepest"))
    )
    return stacked.join(depth, "promo_id").join(contenders, "price_interval_key").filter("deepest > observed_depth_pct")


def the_arrival_curve_is_a_probability_distribution(wh):
    return wh("agg_intraday_arrival_curve").groupBy("l1_category").agg(
        F.count("*").alias("hours"), F.sum("arrival_share").alias("total"), F.min("arrival_share").alias("lowest"),
        F.min("cumulative_share_before").alias("first"), F.max("cumulative_share_before").alias("last"),
    ).filter("hours <> 24 or abs(total - 1) > 1e-9 or lowest < 0 or first < 0 or last >= 1")


def the_availability_fact_accounts_for_every_stockout(wh):
    carried = wh("fct_availability_hour")
    last = carried.agg(F.max("date_day")).scalar()
    first = carried.groupBy("store_id", "sku_id").agg(F.min("date_day").alias("first_day"))
    placeable = (
        wh("stg_wms__stockout_intervals").select("store_id", "sku_id", F.col("stockout_date").alias("date_day"), F.col("stockout_hour_ist").alias("from_hour_ist"))
        .join(first, ["store_id", "sku_id"]).withColumn("last", last).filter("date_day >= first_day and date_day <= last")
    )
    shown = carried.filter(~F.col("is_in_stock")).select(*CELL, "from_hour_ist")
    return placeable.join(shown, [*CELL, "from_hour_ist"], "left_anti")


def the_calendar_has_no_gaps(wh):
    days = wh("dim_date").select("date_day")
    newest = wh("agg_store_sku_day").agg(F.max("date_day")).scalar()
    # The calendar is a few hundred days, so one window over it is one small task.
    stepped = days.withColumn("next", F.lead("date_day").over(run_window([F.lit(0)], "date_day")))
    short = days.agg(F.max("date_day").alias("date_day")).filter(F.col("date_day") < newest)
    return stepped.filter("next is not null and datediff(next, date_day) <> 1").select("date_day").unionByName(short)


def the_lookback_window_covers_every_late_arrival(wh):
    lag = wh("stg_pos__orders").groupBy("order_date_ist").agg(F.max("arrival_lag_days").alias("lag"))
    return lag.filter(F.col("lag") > wh.params.late_arrival_lookback_days)


def the_promo_master_covers_every_promotion_run(wh):
    seen = wh("stg_catalog__price_history").select("promo_id").unionByName(wh("stg_pos__order_items").select("promo_id"))
    return seen.filter("promo_id is not null").distinct().join(wh("dim_promotion"), "promo_id", "left_anti")


def the_stock_ledger_reconciles_to_the_pos(wh):
    sale = F.col("event_type") == "sale"
    pos = wh("fct_order_item").filter(F.col("line_type") == "sale").agg(F.sum("units").alias("pos"), F.sum("cogs").alias("pos_value"))
    wms = wh("fct_inventory_movement").agg(sum_where(-F.col("qty_delta"), sale).alias("wms"), sum_where(-F.col("movement_cost_value"), sale).alias("wms_value"))
    lost = wh("stg_quarantine").filter(F.get_json_object("payload", "$.event_type") == "sale").agg(F.coalesce(F.sum("impact_units"), F.lit(0.0)).alias("lost"))
    cost = wh("fct_inventory_batch").agg(F.min("unit_landed_cost").alias("low"), F.max("unit_landed_cost").alias("high"))
    row = _beside(_beside(_beside(pos, wms), lost), cost).withColumn("implied", ratio(F.col("pos_value") - F.col("wms_value"), F.col("lost")))
    return row.filter("pos - wms <> lost or implied is null or implied < low or implied > high")


def time_weighted_availability_differs_from_a_midnight_snapshot(wh):
    midnight = F.max(((F.col("from_hour_ist") == 0) & F.col("is_in_stock")).cast("int"))
    days = wh("fct_availability_hour").groupBy(*CELL).agg(
        F.sum("hours_in_state").alias("h"), F.sum(F.when(F.col("is_in_stock"), F.col("hours_in_state")).otherwise(0)).alias("up"), midnight.alias("m")
    )
    both = days.agg((F.sum("up") / F.nullif(F.sum("h").cast("double"), F.lit(0.0))).alias("weighted"), F.avg("m").alias("snapshot"))
    return both.filter("weighted is null or snapshot - weighted < 0.001")


def uncensoring_only_ever_adds_demand(wh):
    imputed, sold = F.col("units_demanded_imputed"), F.col("units_sold")
    return wh("agg_store_sku_day").filter((imputed < sold) | (~F.col("is_censored") & (imputed != sold)))


RULES: dict[str, Callable] = {
    f.__name__: f
    for f in [
        agg_revenue_ties_to_raw_order_totals, availability_intervals_cover_every_carried_day, clickstream_counts_tie_to_the_raw_feed,
        clickstream_demand_peaks_in_the_evening, denormalised_store_and_day_match_the_order_header, every_batch_resolves_to_a_supplier,
        late_arrivals_stay_within_the_lookback, no_source_partition_is_missing_undeclared, nothing_is_dropped_without_being_quarantined,
        order_daily_denominators_are_consistent, order_daily_ties_to_the_sku_aggregate, order_items_tie_to_the_raw_feed,
        pack_size_is_physically_plausible, price_intervals_expand_back_to_the_ledger, product_history_covers_every_sale,
        product_versions_are_contiguous, product_versions_expand_back_to_the_daily_catalogue, readout_rows_are_measured_or_explained,
        returns_never_re_enter_the_stock_ledger, returns_reconcile_across_encodings, shelf_life_at_sale_is_possible,
        stacked_promotions_agree_on_price, stacked_promotions_attribute_to_the_price_setter,
        the_arrival_curve_is_a_probability_distribution, the_availability_fact_accounts_for_every_stockout, the_calendar_has_no_gaps,
        the_lookback_window_covers_every_late_arrival, the_promo_master_covers_every_promotion_run, the_stock_ledger_reconciles_to_the_pos,
        time_weighted_availability_differs_from_a_midnight_snapshot, uncensoring_only_ever_adds_demand,
    ]
}


# All of these are written for some rules, so each is built from the one before, and others from them: copies, returns and
# orders meet once.
LINE_TABLES = ("stg_pos__order_items", "stg_pos__order_lines", "fct_order_item")
READ_ALL_LINES = {"nothing_is_dropped_without_being_quarantined", "returns_reconcile_across_encodings"}
AT_ONCE = 6


def singular_tests(wh, names: list[str] | None = None) -> DataFrame:
    """Failing rows per rule; a rule holds when it has none. A few rules run at a time."""
    if READ_ALL_LINES & set(names or RULES):
        for table in LINE_TABLES:
            wh(table)
    rows = [
        RULES[name](wh).agg(F.count("*").alias("failed_rows")).select(F.lit(name).alias("check_name"), "failed_rows")
        for name in names or RULES
    ]
    return in_turn(rows, AT_ONCE)
