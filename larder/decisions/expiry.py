"""Expiry risk: what each open batch holds, what queues ahead of it, what will not sell in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import sum_where
from larder.functions.negbin import leftover_and_risk
from larder.params import Params

SERIES = ["store_id", "sku_id"]


def batch_position(
    movements: DataFrame, batches: DataFrame, products: DataFrame, forecast: DataFrame, p: Params
) -> DataFrame:
    as_of = forecast.agg(F.max("origin_date")).scalar()
    held = (
        movements.filter(F.col("date_day") <= as_of)
        .groupBy("batch_id").agg(F.sum("qty_delta").alias("qty_remaining"))
        .filter("qty_remaining > 0")
    )
    open_batches = (
        held.join(batches.select("batch_id", *SERIES, "expiry_date", "unit_landed_cost", "usable_days"), "batch_id")
        .withColumn("as_of_date", as_of)
        .withColumn("days_to_expiry", F.datediff("expiry_date", "as_of_date"))
    )
    # Units that expire strictly sooner: one row per expiry day first, so the window is as long
    # as the calendar and batches expiring together do not queue behind each other.
    by_day = open_batches.groupBy(*SERIES, "expiry_date").agg(F.sum("qty_remaining").alias("units"))
    sooner = Window.partitionBy(*SERIES).orderBy("expiry_date").rowsBetween(Window.unboundedPreceding, -1)
    ahead = by_day.select(
        *SERIES, "expiry_date", F.coalesce(F.sum("units").over(sooner), F.lit(0)).alias("units_ahead_in_queue")
    )
    upto = [
        sum_where(F.col("forecast_units"), F.col("horizon_days") <= h).alias(f"h{h}") for h in range(1, p.max_horizon_days + 1)
    ]
    demand = forecast.filter(F.col("origin_date") == as_of).groupBy(*SERIES).agg(*upto).select(
        *SERIES, F.array(*[f"h{h}" for h in range(1, p.max_horizon_days + 1)]).alias("cumulative")
    )
    life = F.least(F.greatest("days_to_expiry", F.lit(0)), F.lit(p.max_horizon_days))
    return (
        open_batches.join(ahead, [*SERIES, "expiry_date"])
        .join(demand, SERIES, "left")
        .join(products.select("sku_id", "l1_category", "sku_name"), "sku_id")
        .withColumn(
            "horizon_demand_mean",
            F.coalesce(F.when(life > 0, F.element_at("cumulative", life)), F.lit(0.0)),
        )
        .drop("cumulative")
    )


def expiry_risk(position: DataFrame, dispersion: DataFrame, p: Params) -> DataFrame:
    """``mart_expiry_risk``: expired, at risk inside the horizon, or beyond it."""
    k = dispersion.select("k").scalar()
    left = F.col("days_to_expiry")
    expired, beyond = left < 0, left > p.max_horizon_days
    scored = (
        position.withColumn("residual_demand_mean", F.greatest(F.lit(0.0), F.col("horizon_demand_mean") - F.col("units_ahead_in_queue")))
        .withColumn("k", k)
        .withColumn("nb", leftover_and_risk(F.col("qty_remaining"), F.col("residual_demand_mean"), F.col("k")))
    )
    return (
        scored.withColumns(
            {
                "risk_state": F.when(expired, "expired").when(beyond, "beyond_horizon").otherwise("at_risk"),
                "expiry_risk_score": F.when(expired, 1.0).when(beyond, 0.0).otherwise(F.col("nb.risk")),
                "units_at_risk": F.when(expired, F.col("qty_remaining").cast("double"))
                .when(beyond, 0.0)
                .otherwise(F.least(F.col("nb.leftover"), F.col("qty_remaining").cast("double"))),
            }
        )
        .withColumn("value_at_risk_inr", F.col("units_at_risk") * F.col("unit_landed_cost"))
        .withColumnRenamed("as_of_date", "date_day")
        .drop("nb", "k")
    )


def expiry_report(risk: DataFrame) -> DataFrame:
    return risk.groupBy("risk_state").agg(
        F.count("*").alias("batches"), F.sum("qty_remaining").alias("units_on_hand"), F.sum("units_at_risk").alias("units_at_risk"),
        F.sum("value_at_risk_inr").alias("value_at_risk"), F.avg("expiry_risk_score").alias("mean_score"),
    )


def expiry_report_by_category(risk: DataFrame, limit: int = 10) -> DataFrame:
    return (
        risk.filter(F.col("risk_state") == "at_risk").groupBy("l1_category").agg(
            F.count("*").alias("batches"), F.sum("units_at_risk").alias("units_at_risk"),
            F.sum("value_at_risk_inr").alias("value_at_risk"), F.avg("days_to_expiry").alias("mean_dte"),
        )
        .filter("value_at_risk > 0").orderBy(F.desc("value_at_risk"), "l1_category").limit(limit)
    )


def expiry_validate(risk: DataFrame, movements: DataFrame, daily: DataFrame) -> DataFrame:
    """What became of the stock called at risk, over the days after it was scored."""
    last_day = daily.agg(F.max("date_day")).scalar()
    at_risk = risk.filter(F.col("risk_state") == "at_risk").select(
        "batch_id", F.col("date_day").alias("scored_on"), "expiry_date", "qty_remaining", "units_at_risk", "value_at_risk_inr"
    )
    later = (
        movements.select("batch_id", "date_day", "event_type", "qty_delta")
        .join(at_risk.select("batch_id", "scored_on"), "batch_id")
        .filter(F.col("date_day") > F.col("scored_on"))
        .groupBy("batch_id")
        .agg(
            sum_where(-F.col("qty_delta"), F.col("event_type") == "sale").alias("sold"),
            sum_where(-F.col("qty_delta"), F.col("event_type") == "expiry_writeoff").alias("written_off"),
        )
    )
    gone = at_risk.join(later, "batch_id", "left").fillna(0, ["sold", "written_off"]).withColumn("last_day", last_day)
    stranded = F.col("qty_remaining") - F.col("sold") - F.col("written_off")
    return gone.agg(
        F.sum("qty_remaining").alias("units_on_hand"), F.sum("sold").alias("sold_after"),
        F.sum("written_off").alias("written_off_after"),
        F.coalesce(sum_where(stranded, F.col("expiry_date") <= F.col("last_day")), F.lit(0)).alias("stranded_past_expiry"),
        F.sum("units_at_risk").alias("predicted_units"), F.sum("value_at_risk_inr").alias("predicted_value"),
    )
