"""A store experiment made up from the warehouse, as input for the measurement operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.causal import did
from larder.operators import marts

TRIAL_START = date(2025, 7, 1)


def trial(wh) -> DataFrame:
    """A store experiment over the warehouse: categories repeat it, every other store is treated."""
    treated = F.substring("store_id", 5, 12).cast("int") % 2 == 0
    return did.with_margin(did.experiment_panel(wh("agg_store_sku_day"), TRIAL_START, F.col("l1_category"), treated))


def experiment(wh) -> DataFrame:
    return did.experiment_readout(wh("experiment_panel"))


def presented_experiment(wh) -> DataFrame:
    return marts.mart_experiment_readout(experiment(wh))


def component_trial(wh) -> DataFrame:
    """The trial with one component's part of the result taken out at a time."""
    full = trial(wh)
    without = {
        "markdown": full.withColumn("revenue", F.col("revenue") + F.col("markdown_subsidy")),
        "freshness": full.withColumns({"units_expired": F.lit(0), "writeoff_value": F.lit(0.0)}),
        "availability": full.withColumn("units_lost", F.lit(0.0)),
    }
    frames = {did.FULL: full, **without}
    same = {k: f.withColumns({"units_expired": F.col("units_expired").cast("long"), "margin": F.col("revenue") - F.col("cogs")}) for k, f in frames.items()}
    return did.stack(same, "component")


def swept_trial(wh, costs: tuple[float, ...] = (0.0, 42.0, 70.0)) -> DataFrame:
    """The trial's margin at several delivery costs."""
    priced = trial(wh).withColumns({"param": F.lit("delivery_cost"), "value": F.explode(F.array(*[F.lit(c) for c in costs]))})
    return priced.withColumn("margin", F.col("margin") - F.col("value") * F.col("orders"))
