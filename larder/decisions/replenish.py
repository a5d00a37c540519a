"""Order-up-to levels for perishables: overage depends on spoilage, which depends on the level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions import negbin

REVIEW_DAYS = 1
LEAD_QUANTILE = 0.90
CAP_QUANTILE = 0.95
DEFAULT_LEAD_DAYS = 3.0
DEFAULT_MEAN_LEAD_DAYS = 2.57
ITERATIONS = 12


def replenish_candidates(forecast: DataFrame, risk: DataFrame, purchases: DataFrame, products: DataFrame) -> DataFrame:
    origin = forecast.agg(F.max("origin_date")).scalar()
    series = ["store_id", "sku_id"]
    horizon = (
        forecast.filter(F.col("origin_date") == origin).groupBy(*series, F.col("origin_date").alias("date_day"))
        .agg(F.avg("forecast_units").alias("daily_forecast")).filter("daily_forecast > 0")
    )
    on_hand = risk.filter(F.col("risk_state") != "expired").groupBy(*series).agg(F.sum("qty_remaining").alias("on_hand_units"))
    # Lead times are a few whole days, so the exact percentile keeps a handful of counts per key.
    lead = purchases.filter("lead_time_days is not null").groupBy(*series).agg(
        F.avg("lead_time_days").alias("mean_lead_days"), F.percentile("lead_time_days", F.lit(LEAD_QUANTILE)).alias("lead_days")
    )
    named = products.select("sku_id", "sku_name", "l1_category", "shelf_life_days", "base_price", "landed_cost").filter(
        "landed_cost > 0 and base_price > landed_cost"
    )
    return (
        horizon.join(named, "sku_id").join(on_hand, series, "left").join(lead, series, "left")
        .fillna({"on_hand_units": 0, "lead_days": DEFAULT_LEAD_DAYS, "mean_lead_days": DEFAULT_MEAN_LEAD_DAYS})
    )


def _fixed_point(rows: pd.DataFrame, retention: float) -> pd.DataFrame:
    k = rows["k"].fillna(np.inf).to_numpy(float)[0] if len(rows) else np.inf
    protect = (rows["daily_forecast"] * (rows["lead_days"] + REVIEW_DAYS)).to_numpy(float)
    usable = (rows["daily_forecast"] * rows["shelf_life_days"].clip(lower=1)).to_numpy(float)
    under = (rows["base_price"] - rows["landed_cost"] + retention).to_numpy(float)
    cost = rows["landed_cost"].to_numpy(float)
    cap = negbin.quantile(usable, k, np.full(len(rows), CAP_QUANTILE))
    spoil = np.full(len(rows), 0.5)
    ratio = level = free = np.zeros(len(rows))
    for _ in range(ITERATIONS):
        ratio = np.clip(under / (under + cost * spoil), 1e-6, 1.0 - 1e-9)
        free = negbin.quantile(protect, k, ratio)
        level = np.minimum(free, cap)
        spoil = negbin.cdf(level - 1, usable, k)
    return rows.assign(
        critical_ratio=ratio, p_spoil=spoil, uncapped_order_up_to=free, shelf_life_cap=cap, order_up_to=level,
        is_shelf_life_capped=level < free - 1e-9,
        order_units=np.maximum(level - rows["on_hand_units"].to_numpy(float), 0.0).round(),
    )


def order_up_to(candidates: DataFrame, dispersion: DataFrame, retention_cost: float = 0.0) -> DataFrame:
    """``rec_purchase_order``. Rows are independent, so batches of them are solved in place."""
    with_k = candidates.withColumn("k", dispersion.select("k").scalar()).withColumns(
        {c: F.col(c).cast("double") for c in ("on_hand_units", "lead_days", "mean_lead_days")}
    )

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield _fixed_point(rows, retention_cost)

    added = (
        ", critical_ratio double, p_spoil double, uncapped_order_up_to double, shelf_life_cap double, order_up_to double, "
        "is_shelf_life_capped boolean, order_units double"
    )
    base = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in with_k.schema.fields)
    return with_k.mapInPandas(solve, base + added).filter("order_units >= 1").drop("k")
