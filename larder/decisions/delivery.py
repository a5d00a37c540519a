"""How the ranking of discount bands depends on the assumed cost of a delivery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COSTS = list(range(0, 71, 2))


def delivery_cost_sweep(customers: DataFrame, costs=COSTS) -> DataFrame:
    """Contribution per customer and band at each cost. Discounts are already in the margin."""
    bands = customers.filter("ddi_band is not null").groupBy("ddi_band").agg(
        F.count("*").alias("customers"), F.sum("orders_90d").alias("orders"), F.sum("gross_margin_90d").alias("margin")
    )
    return bands.withColumn("cost", F.explode(F.array(*[F.lit(float(c)) for c in costs]))).select(
        "ddi_band", "cost", "customers", "orders",
        ((F.col("margin") - F.col("cost") * F.col("orders")) / F.col("customers")).alias("contribution_per_customer"),
    )


def crossover(sweep: DataFrame, high: str, low: str) -> DataFrame:
    """First cost at which the ranking of two bands is not the one at the lowest cost; null if none."""
    value = F.col("contribution_per_customer")
    ahead = sweep.groupBy("cost").agg(
        (F.max(F.when(F.col("ddi_band") == high, value)) > F.max(F.when(F.col("ddi_band") == low, value))).alias("ahead")
    )
    # One row per swept cost.
    first = F.first("ahead").over(Window.partitionBy(F.lit(0)).orderBy("cost"))
    flipped = ahead.withColumn("start", first)
    return flipped.agg(F.min(F.when(F.col("ahead") != F.col("start"), F.col("cost"))).alias("crossover_cost"))
