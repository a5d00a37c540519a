"""Which SKUs get the store's few deal slots: scored candidates and an exact allocation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import sum_where
from larder.functions.ordered import exact_median, top_per_group
from larder.decisions.markdown import posted_prices

# The deal price and the measured effects the score rests on.
DEAL_PRICE = 11.0
UPLIFT = 3.57
BASKET_MARGIN = 4.33
CANNIBALISATION = 0.1154
REACTIVATION = 0.0283
SLOTS = 3
MIN_ON_HAND = 12
MIN_DAYS_LEFT = 1
PRIVATE_LABEL_FLOOR = 0.30


def deal_candidates(risk: DataFrame, daily: DataFrame, prices: DataFrame, products: DataFrame) -> DataFrame:
    as_of = risk.agg(F.max("date_day")).scalar()
    at_risk = F.col("risk_state") == "at_risk"
    stock = (
        risk.filter((F.col("risk_state") != "expired") & (F.col("qty_remaining") > 0))
        .groupBy("store_id", "sku_id", "date_day")
        .agg(
            F.sum("qty_remaining").alias("on_hand_units"), F.min("days_to_expiry").alias("days_to_expiry"),
            F.coalesce(sum_where(F.col("units_at_risk"), at_risk), F.lit(0.0)).alias("units_at_risk"),
            F.coalesce(sum_where(F.col("value_at_risk_inr"), at_risk), F.lit(0.0)).alias("value_at_risk"),
            F.max("unit_landed_cost").alias("unit_landed_cost"),
        )
        .filter((F.col("on_hand_units") >= MIN_ON_HAND) & (F.col("days_to_expiry") >= MIN_DAYS_LEFT))
    )
    rate = daily.filter((F.col("date_day") == as_of) & (F.col("trailing_7d_avg_units") > 0)).select(
        "store_id", "sku_id", F.col("trailing_7d_avg_units").alias("base_units_per_day")
    )
    named = products.select(
        "sku_id", "sku_name", "l1_category", "l2_subcategory", "is_private_label", F.col("base_price").alias("list_price")
    )
    return (
        stock.join(rate, ["store_id", "sku_id"])
        .join(named, "sku_id")
        .join(posted_prices(prices, as_of), ["store_id", "sku_id"], "left")
        .withColumn("base_price", F.coalesce("posted_price", "list_price"))
        .filter(F.col("base_price") > DEAL_PRICE)
        .drop("posted_price", "posted_base", "list_price")
    )


def deal_score(candidates: DataFrame, reactivation_value: float = 0.0, basket_margin: float = BASKET_MARGIN) -> DataFrame:
    """What a slot is worth: clearance, basket, reactivation and the item's own margin."""
    units, cost, base = F.col("expected_units"), F.col("unit_landed_cost"), F.col("base_price")
    scored = candidates.withColumn(
        "expected_units", F.least(F.col("base_units_per_day") * UPLIFT, F.col("on_hand_units").cast("double"))
    ).withColumns(
        {
            "clearance_value": F.least(units, F.col("units_at_risk")) * cost,
            "basket_value": units * basket_margin,
            "reactivation_value": units * REACTIVATION * reactivation_value,
            "cannibalisation_drag": -units * CANNIBALISATION * (base - cost),
            "item_margin_delta": units * (F.lit(DEAL_PRICE) - cost) - F.col("base_units_per_day") * (base - cost),
        }
    )
    return scored.withColumns(
        {
            "subsidy": -F.col("item_margin_delta"),
            "slot_value": F.col("clearance_value") + F.col("basket_value") + F.col("reactivation_value") + F.col("item_margin_delta"),
        }
    )


def _best_set(values: list[tuple], slots: int, required: int):
    """Best choice from (value, subcategory, is private label, row) by dynamic programming.

    State is (slots used, private labels used); each subcategory offers at most one row.
    """
    by_sub: dict = {}
    for item in values:
        by_sub.setdefault(item[1], []).append(item)
    states = {(0, 0): (0.0, ())}
    for options in by_sub.values():
        grown = dict(states)
        for (used, labels), (value, rows) in states.items():
            if used == slots:
                continue
            for worth, _, private, row in options:
                key = (used + 1, min(labels + int(private), required))
                if key not in grown or value + worth > grown[key][0]:
                    grown[key] = (value + worth, (*rows, row))
        states = grown
    feasible = [s for (_, labels), s in states.items() if labels >= required]
    return max(feasible, key=lambda s: s[0]) if feasible else None


def deal_allocate(scored: DataFrame, slots: int = SLOTS, floor: float = PRIVATE_LABEL_FLOOR) -> DataFrame:
    """``rec_deal_slot``: the optimal slots of each store-day.

    Only the best SKU per subcategory and label can be chosen, and of those only the best
    ``2 * slots`` per label: at most ``slots`` of the other kind can block a subcategory. So the
    group handed to a task never exceeds ``4 * slots`` rows, whatever the store carries.
    """
    required = math.ceil(floor * slots)
    day = ["date_day", "store_id"]
    tie = [F.desc("slot_value"), F.asc("sku_id")]
    best = top_per_group(scored, [*day, "l2_subcategory", "is_private_label"], tie, 1, "_rank").drop("_rank")
    few = top_per_group(best, [*day, "is_private_label"], tie, 2 * slots, "_rank").drop("_rank")
    narrow = few.select(*day, "sku_id", "l2_subcategory", "is_private_label", "slot_value")

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        items = [(r.slot_value, r.l2_subcategory, bool(r.is_private_label), i) for i, r in enumerate(group.itertuples())]
        found = _best_set(items, slots, required)
        if found is None:
            empty = group.head(1)[["date_day", "store_id"]].copy()
            empty["sku_id"], empty["slot_rank"], empty["solver_status"] = None, 0, "Infeasible"
            return empty
        rows = group.iloc[list(found[1])].sort_values(["slot_value", "sku_id"], ascending=[False, True])
        out = rows[["date_day", "store_id", "sku_id"]].copy()
        out["slot_rank"], out["solver_status"] = range(1, len(out) + 1), "Optimal"
        return out

    schema = "date_day date, store_id string, sku_id string, slot_rank int, solver_status string"
    chosen = narrow.groupBy(*day).applyInPandas(choose, schema)
    return chosen.join(few, [*day, "sku_id"], "left").withColumn("deal_price", F.lit(DEAL_PRICE))


def slot_recommendations(allocated: DataFrame) -> DataFrame:
    """Chosen slots only; a store-day that cannot meet the floor keeps its status in ``allocated``."""
    return allocated.filter(F.col("sku_id").isNotNull())


def breakeven_reactivation_value(scored: DataFrame) -> DataFrame:
    """Median of what a reactivation must be worth for a candidate to pay for itself."""
    without = F.col("clearance_value") + F.col("basket_value") + F.col("item_margin_delta")
    needed = scored.select((-without / F.nullif(F.col("expected_units") * REACTIVATION, F.lit(0.0))).alias("needed"))
    median = exact_median(needed.filter("needed > 0"), "needed", "m")
    return median.select(F.coalesce("m", F.lit(0.0)).alias("breakeven_reactivation_value"))
