"""Column contracts of the tables, and the seven kinds of test they expand to."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.workspace import in_turn


@dataclass(frozen=True)
class Contract:
    """Every column not listed as nullable must be filled."""

    nullable: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()
    compound_unique: tuple[tuple[str, ...], ...] = ()
    references: tuple[tuple[str, str, str], ...] = ()
    accepted: dict[str, tuple] = field(default_factory=dict)
    between: dict[str, tuple[float, float]] = field(default_factory=dict)
    at_least: tuple[tuple[str, str], ...] = ()


YES_NO = {"A": ("A", "B", "C"), "X": ("X", "Y", "Z")}
LINE = {"line_type": ("sale", "return"), "source_feed": ("pos_order_items", "pos_returns")}
MOVES = {"event_type": ("inbound", "opening_balance", "sale", "expiry_writeoff")}
SERIES = (("store_id", "dim_store", "store_id"), ("sku_id", "dim_product", "sku_id"))

CONTRACTS: dict[str, Contract] = {
    "stg_pos__orders": Contract(unique=("row_hash", "order_id"), accepted={"payment_mode": ("upi", "card", "cod", "wallet")}),
    "stg_pos__order_items": Contract(nullable=("promo_id",), unique=("row_hash",)),
    "stg_pos__order_lines": Contract(nullable=("promo_id", "return_reason", "return_date"), accepted=LINE),
    "stg_pos__returns": Contract(accepted={"return_reason": ("damaged", "wrong_item", "quality", "late")}, between={"returned_qty": (1, 1_000_000)}),
    "stg_quarantine": Contract(accepted={"source_name": ("wms_inventory_movement", "pos_returns"), "reason_code": ("missing_batch_reference", "return_without_matching_sale")}),
    "stg_catalog__products": Contract(accepted={"base_uom": ("g", "ml", "pc")}, compound_unique=(("sku_id", "snapshot_date"),)),
    "stg_catalog__price_history": Contract(nullable=("promo_id",)),
    "stg_web__clickstream": Contract(references=(("sku_id", "dim_product", "sku_id"),)),
    "stg_wms__inventory_movements": Contract(unique=("movement_seq",), accepted=MOVES),
    "stg_wms__inventory_batches": Contract(nullable=("po_id",), unique=("batch_id",)),
    "stg_wms__purchase_orders": Contract(nullable=("fill_rate",), unique=("po_id",), between={"fill_rate": (0, 1)}),
    "stg_wms__stockout_intervals": Contract(between={"stockout_hour_ist": (0, 23)}),
    "stg_crm__customers": Contract(nullable=("churn_date",), compound_unique=(("customer_id", "snapshot_date"),)),
    "stg_crm__deal_exposure": Contract(unique=("customer_id",), accepted={"deal_arm": ("exposed", "holdout")}),
    "dim_product": Contract(nullable=("demand_cv",), unique=("sku_id",), accepted={"abc_class": YES_NO["A"], "xyz_class": YES_NO["X"]}),
    "dim_product_snapshot": Contract(
        nullable=("valid_to_date", "dbt_valid_to", "landed_cost_delta", "base_price_delta"), unique=("dbt_scd_id",), between={"days_effective": (1, 100_000)},
    ),
    "dim_customer": Contract(nullable=("churn_date", "days_to_churn"), unique=("customer_id",)),
    "dim_date": Contract(nullable=("festival_name",), unique=("date_day",), between={"day_of_week": (1, 7)}),
    "dim_dte_band": Contract(unique=("dte_band",)),
    "dim_promotion": Contract(
        nullable=("contracted_depth_pct", "observed_depth_pct", "observed_depth_pct_min", "observed_depth_pct_max", "priced_store_sku_days",
                  "first_seen_date", "last_seen_date", "start_ts", "end_ts"),
        unique=("promo_id",), accepted={"funding_source": ("platform", "brand")},
    ),
    "dim_store": Contract(nullable=("affinity_dairy_eggs", "affinity_fruits_vegetables", "affinity_ready_to_eat"), unique=("store_id",)),
    "dim_supplier": Contract(
        nullable=("categories", "lead_time_mean_days", "lead_time_sd_days", "otif_rate", "monsoon_otif_penalty", "cost_index",
                  "inbound_freshness_pct_mean", "inbound_freshness_pct_min", "inbound_freshness_pct_max"),
        unique=("supplier_id",),
    ),
    "fct_order_item": Contract(
        nullable=("promo_id", "return_reason", "return_date"), references=(*SERIES, ("order_id", "fct_order", "order_id"), ("batch_id", "fct_inventory_batch", "batch_id")), accepted=LINE,
    ),
    "fct_order": Contract(
        nullable=("min_dte_at_sale", "fill_rate"), unique=("order_id",), references=(SERIES[0], ("customer_id", "dim_customer", "customer_id")),
        between={"fill_rate": (0, 1)}, at_least=(("requested_units", "gross_units"),),
    ),
    "fct_inventory_movement": Contract(unique=("movement_seq",), references=(*SERIES, ("batch_id", "fct_inventory_batch", "batch_id")), accepted=MOVES),
    "fct_inventory_batch": Contract(
        nullable=("po_id", "first_movement_date", "last_movement_date", "sell_through_rate"), unique=("batch_id",),
        references=(*SERIES, ("supplier_id", "dim_supplier", "supplier_id")), between={"sell_through_rate": (0, 1)},
    ),
    "fct_availability_hour": Contract(nullable=("ran_out_at_hour",), references=SERIES, between={"hours_in_state": (1, 24), "from_hour_ist": (0, 23), "to_hour_ist": (1, 24)}),
    "fct_clickstream": Contract(references=SERIES, between={"event_hour_ist": (0, 23)}, at_least=(("event_count", "censored_event_count"),)),
    "fct_price_history": Contract(unique=("price_interval_key",), references=SERIES, between={"discount_pct": (0, 1)}, at_least=(("base_price", "realized_price"),)),
    "agg_store_sku_day": Contract(
        nullable=("min_dte_at_sale", "base_price_avg", "realized_price_avg", "in_stock_pct", "avg_dte_at_sale", "ran_out_at_hour", "demand_share_before_stockout"),
        unique=("store_sku_day_key",), compound_unique=(("store_id", "sku_id", "date_day"),), references=SERIES,
        accepted={"demand_imputation_method": ("observed", "arrival_curve_scaled", "trailing_mean")}, between={"in_stock_pct": (0, 1)},
    ),
    "agg_intraday_arrival_curve": Contract(compound_unique=(("l1_category", "hour_ist"),), between={"arrival_share": (0, 1), "signal_weight": (0, 1), "cumulative_share_before": (0, 1)}),
    "mart_order_daily": Contract(unique=("store_day_key",), references=(SERIES[0],), at_least=(("placed_orders", "orders_count"),)),
    "mart_customer_360": Contract(
        nullable=("first_order_date", "last_order_date", "recency_days", "r_score", "f_score", "m_score", "rfm_segment", "discount_dependency_index"),
        unique=("customer_id",), accepted={"ddi_band": ("no_orders", "low", "medium", "high")},
        between={"r_score": (1, 5), "f_score": (1, 5), "m_score": (1, 5), "discount_dependency_index": (0, 1)},
    ),
    "mart_cohort_retention": Contract(compound_unique=(("cohort_month", "month_index"),), between={"retention_rate": (0, 1)}),
    "dq_source_coverage": Contract(compound_unique=(("source_name", "date_day"),)),
    "mart_expiry_risk": Contract(
        unique=("batch_id",), accepted={"risk_state": ("expired", "at_risk", "beyond_horizon")}, between={"expiry_risk_score": (0, 1)}, at_least=(("qty_remaining", "units_at_risk"),),
    ),
}

AT_ONCE = 6
RESULT = "check_name string, table_name string, column_name string, failed_rows bigint"


def contract_results(df: DataFrame, table: str, contract: Contract, lookup: Callable[[str], DataFrame]) -> DataFrame:
    """One row per test: the row-level tests share one aggregate pass over the table."""
    checks = []
    for column in df.columns:
        if column not in contract.nullable:
            checks.append(("not_null", column, F.col(column).isNull()))
    checks += [("accepted_values", c, ~F.col(c).isin(*v)) for c, v in contract.accepted.items()]
    checks += [("between", c, ~F.col(c).between(*v)) for c, v in contract.between.items()]
    checks += [("at_least", f"{a},{b}", F.col(a) < F.col(b)) for a, b in contract.at_least]
    one_pass = df.agg(*[F.count(F.when(bad, 1)).alias(f"c{i}") for i, (_, _, bad) in enumerate(checks)])
    packed = F.array(
        *[F.struct(F.lit(k).alias("check_name"), F.lit(c).alias("column_name"), F.col(f"c{i}").alias("failed_rows")) for i, (k, c, _) in enumerate(checks)]
    )
    parts = [one_pass.select(F.explode(packed).alias("x")).select("x.check_name", "x.column_name", "x.failed_rows")]
    for keys in [(c,) for c in contract.unique] + list(contract.compound_unique):
        kind = "unique" if len(keys) == 1 else "compound_unique"
        repeated = df.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("_copies")).filter("_copies > 1")
        parts.append(repeated.agg(F.count("*").alias("failed_rows")).select(F.lit(kind).alias("check_name"), F.lit(",".join(keys)).alias("column_name"), "failed_rows"))
    for column, parent, key in contract.references:
        parents = lookup(parent).select(F.col(key).alias(column)).distinct()
        orphans = df.filter(F.col(column).isNotNull()).join(parents, column, "left_anti")
        parts.append(orphans.agg(F.count("*").alias("failed_rows")).select(F.lit("relationships").alias("check_name"), F.lit(column).alias("column_name"), "failed_rows"))
    return reduce(DataFrame.unionByName, parts).select("check_name", F.lit(table).alias("table_name"), "column_name", "failed_rows")


def generic_tests(wh, tables: list[str] | None = None) -> DataFrame:
    """The results of all contracts, or of those of ``tables``; a few tables are tested at a time."""
    return in_turn([contract_results(wh(t), t, CONTRACTS[t], wh) for t in tables or CONTRACTS], AT_ONCE)
