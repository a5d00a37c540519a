"""Analysis tables of the warehouse, by name: how each job reads the tables it needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.causal import deal, did, uplift
from larder.causal.tree import CausalTree
from larder.operators import marts
from larder.quality.results import dq_test_results
from larder.sources import tables
from larder.decisions import elasticity, expiry, forecast, markdown, replenish, slots, transfers


def features(wh, origins: DataFrame) -> DataFrame:
    return forecast.feature_frame(
        wh("agg_store_sku_day"), wh("fct_price_history"), wh("dim_date"), wh("dim_product"), origins, wh.params
    )


def model_forecast(wh, model: str | None = None) -> DataFrame:
    """Fit on the training origins, predict the evaluated ones; ``model`` is "boosted" or "tweedie" (the regression)."""
    model = model or ("tweedie" if wh.params.demand_model == "tweedie" else "boosted")

    def build() -> DataFrame:
        daily = wh("agg_store_sku_day")
        training = wh.derive("train_features", lambda: features(wh, forecast.train_origins(daily, wh.params)))
        asked = wh.derive("eval_features", lambda: features(wh, forecast.eval_origins(daily, wh.params)))
        if model == "tweedie":
            return forecast.predict_demand(*forecast.train_demand(training), asked)
        return forecast.predict_boosted(forecast.train_boosted(training), asked)

    return wh.derive(f"model_forecast_{model}", build)


def model_accuracy(wh, model: str | None = None) -> DataFrame:
    return forecast.swap_forecast(wh("mart_forecast_accuracy"), model_forecast(wh, model))


def forecast_value(wh) -> DataFrame:
    return forecast.forecast_value(model_accuracy(wh, "boosted"), model_accuracy(wh, "tweedie"))


def served_forecast(wh) -> DataFrame:
    """The model's numbers; series without features at the origin keep the moving average and its name."""
    return forecast.swap_forecast(wh("mart_demand_baseline"), model_forecast(wh))


def position(wh) -> DataFrame:
    return expiry.batch_position(
        wh("int_stock_day"), wh("fct_inventory_batch"), wh("dim_product"), wh("mart_demand_forecast"), wh.params
    )


def decisions(wh) -> DataFrame:
    return markdown.markdown_decisions(
        wh("mart_expiry_risk"), wh("fct_price_history"), wh("dim_product"), wh("mart_price_elasticity")
    )


def priced(wh) -> DataFrame:
    return markdown.priced_batches(wh("mart_expiry_risk"), wh("fct_price_history"), wh("dim_product"))


def deal_candidates(wh) -> DataFrame:
    return slots.deal_candidates(
        wh("mart_expiry_risk"), wh("agg_store_sku_day"), wh("fct_price_history"), wh("dim_product")
    )


def transfer_candidates(wh, min_units: int = 0) -> DataFrame:
    return transfers.transfer_candidates(
        wh("mart_expiry_risk"), wh("agg_store_sku_day"), wh("dim_store"), wh("dim_product"), min_units=min_units
    )


def transfer_arcs(wh) -> DataFrame:
    return wh.derive("transfer_arcs", lambda: transfers.shelf_life_gate(transfer_candidates(wh, transfers.MIN_UNITS)))


def transfer_bound(wh) -> DataFrame:
    return transfers.plan_bound(transfer_arcs(wh), wh("rec_transfer_order"))


def replenish_candidates(wh) -> DataFrame:
    return replenish.replenish_candidates(
        wh("mart_demand_forecast"), wh("mart_expiry_risk"), wh("stg_wms__purchase_orders"), wh("dim_product")
    )


def retention(wh) -> DataFrame:
    return deal.retention_outcomes(
        wh("fct_order_item"), wh("agg_store_sku_day"), wh("dim_customer"), wh("stg_crm__deal_exposure")
    )


LEARNERS = {
    "t_learner": uplift.t_learner,
    "x_learner": uplift.x_learner,
    "transformed_outcome": uplift.transformed_outcome,
    "two_stage": uplift.two_stage,
}


def uplift_scores(wh, learner: str, outcome: str = "margin_post") -> DataFrame:
    """Held-out customers scored by one learner, written once."""

    def build() -> DataFrame:
        train, score = uplift.split(wh("uplift_panel"))
        if learner == "causal_tree":
            fitted = CausalTree(uplift.NUMERIC).fit(train, outcome)
            return fitted.predict(score.select(*uplift.NUMERIC, *[c for c in uplift.KEPT if c not in uplift.NUMERIC]))
        return LEARNERS[learner](train, score, outcome)

    return wh.derive(f"uplift_{learner}_{outcome}", build)


def behaviour_curve(wh) -> DataFrame:
    """The gain curve of the simplest score: how much a customer bought before."""
    return uplift.gain_curve(wh("uplift_panel").withColumn("uplift", F.col("units_pre")))


def deal_readout(wh) -> DataFrame:
    def build() -> DataFrame:
        scored = {name: uplift_scores(wh, name) for name in ("t_learner", "x_learner", "causal_tree")}
        judged = {name: uplift.qini(uplift.gain_curve(s)) for name, s in scored.items()}
        churn = uplift_scores(wh, "causal_tree", "churned").select("customer_id", F.col("uplift").alias("churn_uplift"))
        net = scored["causal_tree"].join(churn, "customer_id").withColumns(
            {
                "uplift": F.col("uplift") - F.col("churn_uplift") * deal.CUSTOMER_VALUE,
                "net_post": F.col("margin_post") - F.col("churned") * deal.CUSTOMER_VALUE,
            }
        )
        curve = uplift.targeting_curve(uplift.gain_curve(net, "net_post"))
        return deal.deal_readout(
            wh("fct_order_item"), wh("stg_crm__deal_exposure"), wh("event_panel"), retention(wh), wh("rec_deal_slot"), judged, curve
        )

    return wh.derive("deal_readout", build)


#: What each engine is told, beside what is fitted.
CONSTANTS = {
    "newsvendor": {"review_period_days": replenish.REVIEW_DAYS, "lead_time_quantile": replenish.LEAD_QUANTILE, "shelf_life_cap_quantile": replenish.CAP_QUANTILE},
    "markdown": {"depth_grid": markdown.DEPTHS, "budget_per_store_day": markdown.BUDGET_PER_STORE_DAY, "disposal_cost_per_unit": 0.0},
    "deal_slot": {
        "deal_price": slots.DEAL_PRICE, "slots_per_store_day": slots.SLOTS, "private_label_floor": slots.PRIVATE_LABEL_FLOOR, "uplift_multiplier": slots.UPLIFT,
        "incremental_basket_margin": slots.BASKET_MARGIN, "reactivation_rate": slots.REACTIVATION, "min_on_hand_units": slots.MIN_ON_HAND, "min_days_to_expiry": slots.MIN_DAYS_LEFT,
    },
    "transfers": {
        "speed_kmh": transfers.SPEED_KMH, "handling_hours": transfers.HANDLING_HOURS, "cost_per_km": transfers.COST_PER_KM,
        "fixed_trip_cost": transfers.FIXED_TRIP_COST, "min_transfer_units": transfers.MIN_UNITS,
    },
}


def policy_bundle(wh) -> DataFrame:
    return tables.policy_bundle(
        wh("mart_price_elasticity"), wh("dim_dte_band"), wh("stg_wms__purchase_orders"), wh("dim_product"),
        forecast.fit_dispersion(wh("mart_forecast_accuracy")), wh("agg_store_sku_day"), CONSTANTS,
    )


def presented_readout(wh) -> DataFrame:
    return marts.mart_deal_readout(deal_readout(wh))


def job_builders(wh) -> dict:
    return {
        "mart_forecast_accuracy": lambda: forecast.backtest(wh("agg_store_sku_day"), wh("dim_product"), wh.params),
        "mart_demand_baseline": lambda: forecast.baseline_forecast(wh("agg_store_sku_day"), wh.params),
        "mart_demand_forecast": lambda: wh("mart_demand_baseline") if wh.params.demand_model == "baseline" else served_forecast(wh),
        "mart_expiry_risk": lambda: expiry.expiry_risk(
            position(wh), forecast.fit_dispersion(wh("mart_forecast_accuracy")), wh.params
        ),
        "elasticity_panel": lambda: elasticity.elasticity_panel(
            wh("int_stock_day"), wh("fct_inventory_batch"), wh("dim_product"), wh("dim_date"),
            wh("agg_store_sku_day"), wh("fct_price_history"),
        ),
        "mart_price_elasticity": lambda: elasticity.estimate(wh("elasticity_panel")),
        "rec_markdown": lambda: markdown.optimise(decisions(wh)),
        "rec_deal_slot": lambda: slots.slot_recommendations(slots.deal_allocate(slots.deal_score(deal_candidates(wh)))),
        "rec_transfer_order": lambda: transfers.transfer_plan(transfer_arcs(wh)),
        "rec_purchase_order": lambda: replenish.order_up_to(
            replenish_candidates(wh), forecast.fit_dispersion(wh("mart_forecast_accuracy"))
        ),
        "event_panel": lambda: deal.event_panel(wh("fct_price_history"), wh("agg_store_sku_day")),
        "uplift_panel": lambda: deal.uplift_panel(wh("fct_order_item"), wh("dim_customer"), wh("stg_crm__deal_exposure")),
        "mart_deal_readout": lambda: presented_readout(wh),
        "mart_experiment_readout": lambda: marts.mart_experiment_readout(did.experiment_readout(wh("experiment_panel"))),
        "dq_test_results": lambda: dq_test_results(wh),
    }
