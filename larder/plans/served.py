"""Questions an operator asks of the finished tables, as lazily filtered DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CENTURY = "2999-12-31"


def _positive(limit: int) -> int:
    if limit < 1:
        raise ValueError("limit must be positive")
    return limit


def browse(df: DataFrame, order_by: str, descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """One page of a stored table; only its own columns may order it."""
    if order_by not in df.columns:
        raise ValueError(f"no such column: {order_by!r}")
    by = F.desc_nulls_last(order_by) if descending else F.asc_nulls_last(order_by)
    return df.orderBy(by).offset(offset).limit(_positive(limit))


def expiry_queue(risk: DataFrame, store: str | None = None, min_value: float = 0.0, limit: int = 50) -> DataFrame:
    """Batches at risk, most valuable first; stock already expired cannot be acted on."""
    rows = risk.filter((F.col("risk_state") == "at_risk") & (F.col("value_at_risk_inr") >= min_value))
    if store is not None:
        rows = rows.filter(F.col("store_id") == store)
    return rows.orderBy(F.desc("value_at_risk_inr"), "batch_id").limit(_positive(limit))


def elasticity_cells(elasticity: DataFrame, category: str | None = None, identified_only: bool = False) -> DataFrame:
    """Fitted cells; the usable coefficient is null where no slope was identified."""
    rows = elasticity.withColumn("usable_elasticity", F.when(F.col("is_identified"), F.col("elasticity_raw")))
    if category is not None:
        rows = rows.filter(F.col("l1_category") == category)
    if identified_only:
        rows = rows.filter("is_identified")
    return rows.orderBy("l1_category", "dte_band")


def _markdowns(df: DataFrame) -> DataFrame:
    return df.filter(F.col("decision") == "markdown").select(
        F.lit("markdown").alias("action_type"), "store_id", "sku_id", F.col("margin_vs_do_nothing").alias("value"),
        F.lit("margin over holding the price").alias("value_basis"), F.col("recommended_depth").alias("quantity"),
    )


def _deals(df: DataFrame) -> DataFrame:
    return df.select(
        F.lit("deal_slot").alias("action_type"), "store_id", "sku_id", F.col("slot_value").alias("value"),
        F.lit("expected value of the slot").alias("value_basis"), F.col("expected_units").alias("quantity"),
    )


def _transfers(df: DataFrame) -> DataFrame:
    return df.select(
        F.lit("transfer").alias("action_type"), F.col("from_store").alias("store_id"), "sku_id", F.col("net_benefit").alias("value"),
        F.lit("write-off avoided net of the trip").alias("value_basis"), F.col("units").cast("double").alias("quantity"),
    )


def _purchases(df: DataFrame) -> DataFrame:
    return df.select(
        F.lit("replenish").alias("action_type"), "store_id", "sku_id", (F.col("order_units") * F.col("landed_cost")).alias("value"),
        F.lit("money to be committed").alias("value_basis"), F.col("order_units").alias("quantity"),
    )


ENGINES = {
    "markdown": ("rec_markdown", _markdowns), "deal_slot": ("rec_deal_slot", _deals),
    "transfer": ("rec_transfer_order", _transfers), "replenish": ("rec_purchase_order", _purchases),
}


def action_queue(tables: dict[str, DataFrame], store: str | None = None, action_type: str | None = None, limit: int = 100) -> DataFrame:
    """Four engines' output in one list, ranked by value within each; tables not built are left out."""
    if action_type is not None and action_type not in ENGINES:
        raise ValueError(f"unknown action type: {action_type!r}")
    wanted = [action_type] if action_type else list(ENGINES)
    parts = [shape(tables[table]) for kind, (table, shape) in ENGINES.items() if kind in wanted and table in tables]
    if not parts:
        raise ValueError("no decision table has been built")
    rows = reduce(DataFrame.unionByName, parts)
    if store is not None:
        rows = rows.filter(F.col("store_id") == store)
    order = F.array_position(F.array(*[F.lit(k) for k in ENGINES]), F.col("action_type"))
    return rows.orderBy(order, F.desc("value"), "store_id", "sku_id").limit(_positive(limit))


def experiment_rows(readout: DataFrame) -> DataFrame:
    return readout.orderBy("display_order", "metric")


def deal_page(readout: DataFrame, page: str | None = None) -> DataFrame:
    rows = readout if page is None else readout.filter(F.col("page") == page)
    return rows.orderBy("page_order", "metric")


def source_freshness(coverage: DataFrame) -> DataFrame:
    """Last day seen per feed, how far behind the newest feed it is, and what it is missing."""
    newest = coverage.agg(F.max("date_day")).scalar()
    return (
        coverage.groupBy("source_name")
        .agg(
            F.max("last_seen_date").alias("last_seen_date"), F.count(F.when(F.col("is_missing_partition"), 1)).alias("missing_partitions"),
            F.max("is_stale").alias("is_stale"),
        )
        .withColumn("newest", newest)
        .withColumn("days_behind", F.greatest(F.datediff("newest", "last_seen_date"), F.lit(0)))
        .drop("newest")
        .orderBy(F.desc("is_stale"), "source_name")
    )
