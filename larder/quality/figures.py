"""Named figures: anchors to pin, published numbers to re-derive, a profile of the raw feeds."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import ratio
from larder.functions.ordered import global_running
from larder.operators.staging import ITEM_COLUMNS

MONEY_TOLERANCE = 0.01


@dataclass(frozen=True)
class Figure:
    name: str
    table: str
    measure: Callable[[], Column]
    unit: str = "count"
    where: str | None = None


def _n() -> Column:
    return F.count("*")


def _sum(c: str) -> Callable[[], Column]:
    return lambda: F.sum(c)


CELL, RISK, ORDER, ITEM, SLOPE = "agg_store_sku_day", "mart_expiry_risk", "fct_order", "fct_order_item", "mart_price_elasticity"
ANCHORS = [
    Figure("agg_rows", CELL, _n),
    Figure("net_revenue", CELL, _sum("net_revenue"), "money"),
    Figure("order_items", ITEM, _n),
    Figure("writeoff_value", CELL, _sum("writeoff_value"), "money"),
    Figure("distinct_stores", CELL, lambda: F.countDistinct("store_id")),
    Figure("elasticity_cells", SLOPE, _n),
    Figure("rec_markdown_rows", "rec_markdown", _n),
]
PUBLISHED = [
    Figure("net_revenue", CELL, _sum("net_revenue"), "money"),
    Figure("writeoff_value", CELL, _sum("writeoff_value"), "money"),
    Figure("gross_margin_pct", CELL, lambda: ratio(F.sum("net_revenue") - F.sum("cogs"), F.sum("net_revenue")) * 100, "percent"),
    Figure("at_risk_batches", RISK, _n, where="risk_state = 'at_risk'"),
    Figure("expired_batches", RISK, _n, where="risk_state = 'expired'"),
    Figure("expired_value", RISK, _sum("value_at_risk_inr"), "money", "risk_state = 'expired'"),
    Figure("value_at_risk", RISK, _sum("value_at_risk_inr"), "money", "risk_state = 'at_risk'"),
    Figure("stacked_promo_intervals", "fct_price_history", _n, where="is_promo_stacked"),
    Figure("unfulfilled_units", ORDER, _sum("unfulfilled_units")),
    Figure("unfulfilled_share_pct", ORDER, lambda: ratio(F.sum("unfulfilled_units"), F.sum("requested_units")) * 100, "percent"),
    Figure("short_filled_orders_pct", ORDER, lambda: ratio(F.count(F.when(F.col("is_short_filled"), 1)), F.count("*")) * 100, "percent"),
    Figure("elasticity_cells_identified", SLOPE, _n, where="is_identified"),
    Figure("strongest_elasticity", SLOPE, lambda: F.min("elasticity"), "coefficient", "is_identified"),
    Figure("rec_markdown_rows", "rec_markdown", _n),
    Figure("rec_deal_slot_rows", "rec_deal_slot", _n),
    Figure("rec_transfer_order_rows", "rec_transfer_order", _n),
    Figure("rec_purchase_order_rows", "rec_purchase_order", _n),
    Figure("orders_delivered", ORDER, _n, where="net_units > 0"),
    Figure("orders_total_stockout", ORDER, _n, where="net_units = 0"),
    Figure("aov", ITEM, lambda: ratio(F.sum("net_revenue"), F.countDistinct("order_id")), "money"),
    Figure("aov_all_headers", ORDER, lambda: ratio(F.sum("gmv"), F.count("*")), "money"),
    Figure("batches_scored", RISK, _n),
]


def figures(wh, wanted: list[Figure]) -> DataFrame:
    reads = Counter(f.table for f in wanted)

    def table(name: str) -> DataFrame:
        # Single lines are the widest table: one figure reads its columns of them, and the others are not written for it.
        return wh.unwritten(name) if name == ITEM and reads[name] == 1 else wh(name)

    rows = []
    for f in wanted:
        df = table(f.table) if f.where is None else table(f.table).filter(f.where)
        rows.append(df.agg(f.measure().cast("double").alias("value")).select(F.lit(f.name).alias("name"), "value", F.lit(f.unit).alias("unit")))
    return reduce(DataFrame.unionByName, rows)


def compare(measured: DataFrame, expected: Mapping[str, float]) -> DataFrame:
    """Counts must match, money within a cent; a figure nobody expects is reported, not failed."""
    known = F.create_map(*[x for k, v in expected.items() for x in (F.lit(k), F.lit(float(v)))])
    gap = F.abs(F.col("value") - F.col("expected"))
    allowed = F.when(F.col("unit") == "money", MONEY_TOLERANCE).otherwise(1e-9)
    return measured.withColumn("expected", known[F.col("name")]).withColumn(
        "status", F.when(F.col("expected").isNull(), "unpinned").when(F.col("value").isNull(), "missing").when(gap <= allowed, "ok").otherwise("moved")
    )


# The profile: what the raw feeds look like once copies and returns are set aside.


def _items(feed) -> DataFrame:
    return feed("pos_order_items").filter("qty > 0").select(*ITEM_COLUMNS).distinct()


def _catalogue(feed) -> DataFrame:
    cat = feed("catalog_snapshot")
    return cat.filter(F.col("snapshot_date") == cat.agg(F.max("snapshot_date")).scalar())


def _written_off(feed) -> DataFrame:
    cost = feed("wms_inventory_batch").select("batch_id", "sku_id", "unit_landed_cost")
    gone = feed("wms_inventory_movement").filter(F.col("event_type") == "expiry_writeoff").join(cost, "batch_id")
    return gone.select("sku_id", (-F.col("qty_delta")).alias("units"), (-F.col("qty_delta") * F.col("unit_landed_cost")).alias("value"))


def profile_headline(feed) -> DataFrame:
    qty = F.col("qty")
    sold = _items(feed).agg(
        F.sum(qty * F.col("unit_realized_price")).alias("revenue"), F.sum(qty * F.col("unit_cogs")).alias("cogs"), F.sum(qty).alias("units"),
        F.count("*").alias("lines"), F.sum(F.when(F.col("is_substitution"), qty).otherwise(0)).alias("substituted"),
    )
    waste, wasted = [_written_off(feed).agg(F.sum(c)).scalar() for c in ("value", "units")]
    orders = feed("pos_orders").drop("dt").distinct().agg(F.count("*")).scalar()
    return sold.withColumns({"wastage": waste, "wasted_units": wasted, "orders": orders}).withColumns(
        {
            "gross_margin": F.col("revenue") - F.col("cogs"),
            "gm_pct": ratio(F.col("revenue") - F.col("cogs"), F.col("revenue")),
            "gm_awm_pct": ratio(F.col("revenue") - F.col("cogs") - F.col("wastage"), F.col("revenue")),
            "wastage_pct_rev": ratio(F.col("wastage"), F.col("revenue")),
        }
    )


def profile_daily(feed) -> DataFrame:
    orders = feed("pos_orders").select("order_id", F.col("order_ts").cast("date").alias("date_day")).distinct()
    return _items(feed).join(orders, "order_id").groupBy("date_day").agg(F.sum("qty").alias("sold"))


def profile_stockout_days(feed) -> DataFrame:
    return feed("wms_stockout_interval").groupBy(F.col("event_date").alias("date_day")).agg(F.count("*").alias("cells"))


def profile_waste_by_category(feed) -> DataFrame:
    named = _catalogue(feed).select("sku_id", "l1_category")
    return _written_off(feed).join(named, "sku_id").groupBy("l1_category").agg(F.sum("value").alias("value")).filter("value > 0")


def profile_supplier_freshness(feed, category: str | None = None, max_life: int | None = None) -> DataFrame:
    named = _catalogue(feed).select("sku_id", "l1_category", "shelf_life_days")
    rows = feed("wms_inventory_batch").filter(F.col("supplier_id") != "SUP-OPENING").join(named, "sku_id")
    if category is not None:
        rows = rows.filter(F.col("l1_category") == category)
    if max_life is not None:
        rows = rows.filter(F.col("shelf_life_days") <= max_life)
    return rows.groupBy("supplier_id").agg(
        F.count("*").alias("batches"), F.avg("usable_days").alias("days"), F.avg("unit_landed_cost").alias("cost")
    )


# How promotions are named in the profile.
PROMO_LABELS = {"PROMO-DEAL11": "Rs 11 deal rail", "PROMO-MD-30": "Markdown 30%"}


def profile_promo_margin(feed) -> DataFrame:
    label = F.when(F.col("promo_id").isNull(), "Full price")
    for promo, name in PROMO_LABELS.items():
        label = label.when(F.col("promo_id") == promo, name)
    return _items(feed).groupBy(label.otherwise("Markdown 50%").alias("promotion")).agg(
        F.sum("qty").alias("units"), F.sum(F.col("qty") * (F.col("unit_realized_price") - F.col("unit_cogs"))).alias("margin")
    )


def profile_velocity(feed, tiles: int = 10) -> DataFrame:
    """Stockout rate (per store and day of the feed) and volume share by sales decile; deciles come from
    global positions."""
    days, stores = profile_daily(feed).agg(F.count("*")).scalar(), feed("pos_orders").agg(F.countDistinct("store_id")).scalar()
    units = _items(feed).groupBy("sku_id").agg(F.sum("qty").alias("units"))
    total = units.agg(F.sum("units")).scalar()
    n = units.agg(F.count("*")).scalar()
    ranked = global_running(units, [F.asc("units"), F.asc("sku_id")], {"position": F.lit(1)}).withColumns({"n": n, "total": total, "cell_days": days * stores})
    size, extra = F.floor(F.col("n") / tiles), F.col("n") % tiles
    wide = extra * (size + 1)
    decile = F.when(F.col("position") <= wide, F.ceil(F.col("position") / (size + 1))).otherwise(
        extra + F.ceil((F.col("position") - wide) / F.greatest(size, F.lit(1)))
    )
    outs = feed("wms_stockout_interval").groupBy("sku_id").agg(F.count("*").alias("outs"))
    return ranked.withColumn("decile", decile).join(outs, "sku_id", "left").groupBy("decile").agg(
        (F.avg(F.coalesce("outs", F.lit(0))) / F.max("cell_days")).alias("stockout_rate"), F.sum(F.col("units") / F.col("total")).alias("volume_share")
    )


def profile_dte_mix(feed, max_life: int = 14) -> DataFrame:
    short = _catalogue(feed).filter(F.col("shelf_life_days") <= max_life).select("sku_id")
    d = F.col("dte_at_sale")
    label = (
        F.when(d == 0, "expires today").when(d == 1, "1 day left").when(d <= 3, "2-3 days").when(d <= 7, "4-7 days").otherwise("8+ days")
    )
    return _items(feed).join(short, "sku_id", "left_semi").groupBy(label.alias("remaining")).agg(F.sum("qty").alias("units"))


def profile_counts(feed) -> DataFrame:
    parts = {
        "days": profile_daily(feed).agg(F.count("*")), "stores": feed("pos_orders").agg(F.countDistinct("store_id")),
        "skus": _catalogue(feed).agg(F.count("*")), "batches": feed("wms_inventory_batch").agg(F.count("*")),
        "movements": feed("wms_inventory_movement").agg(F.count("*")),
    }
    return reduce(DataFrame.unionByName, [df.toDF("value").select(F.lit(k).alias("name"), "value") for k, df in parts.items()])
