"""Registered queries: forecasting, expiry, pricing and stock decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.decisions import expiry, forecast, markdown, slots, transfers
from larder.functions.negbin import leftover_and_risk
from larder.plans import jobs
from suite.ctes_feeds import FEEDS
from suite.ctes_jobs import JOBS
from suite.ctes_models import MODELS
from suite.models import over_library
from suite.spec import Query

LIBRARY = {**FEEDS, **MODELS, **JOBS}
ACCURACY = "cells:i actual_units:2 wape:6 naive_wape:6 bias:6 fva:6"
REPORT_SQL = """
select {by}, count(*) as cells, sum(actual_units) as actual_units, sum(abs(actual_units - forecast_units)) / sum(actual_units) as wape,
       sum(abs(actual_units - naive_units)) / sum(actual_units) as naive_wape, sum(forecast_units - actual_units) / sum(actual_units) as bias,
       (sum(abs(actual_units - naive_units)) - sum(abs(actual_units - forecast_units))) / sum(actual_units) as fva
from accuracy group by {by}"""


#: The budget spent one step at a time: in every store the best margin per rupee first; a step that does not fit ends its batch.
PLAN_SQL = """
with recursive up as (select *, row_number() over (partition by batch_id order by spend, margin, depth) as n from grid),
rising as (select * from up u where n = 1 or not exists (select 1 from up e where e.batch_id = u.batch_id and e.n < u.n and e.margin >= u.margin)),
kept as materialized (
  select store_id, batch_id, depth, price, spend, margin, row_number() over (partition by batch_id order by n) - 1 as step
  from rising i where n = 1 or not exists (
    select 1 from rising a join rising b on a.batch_id = b.batch_id where a.batch_id = i.batch_id and a.n < i.n and b.n > i.n
      and (b.margin - a.margin) * greatest(i.spend - a.spend, 1e-9) >= (i.margin - a.margin) * greatest(b.spend - a.spend, 1e-9))),
moves as materialized (
  select *, row_number() over (partition by store_id order by gain / greatest(cost, 1e-9) desc, batch_id, step) as turn
  from (select store_id, batch_id, step, spend - lag(spend) over w as cost, margin - lag(margin) over w as gain from kept
        window w as (partition by batch_id order by step))
  where step > 0 and gain > 0 and cost > 0),
walk as (
  select store_id, 0::bigint as turn, sum(spend) as spent, []::varchar[] as ended, null::varchar as batch_id, null::bigint as step
  from kept where step = 0 group by store_id
  union all
  select store_id, turn, spent + if(fits, cost, 0), if(fits, ended, list_append(ended, id)), if(fits, id, null), if(fits, s, null)
  from (select w.store_id, m.turn, w.spent, w.ended, m.batch_id as id, m.step as s, m.cost,
               not list_contains(w.ended, m.batch_id) and m.cost <= 100 - w.spent as fits
        from walk w join moves m on m.store_id = w.store_id and m.turn = w.turn + 1)),
reached as (select batch_id, max(step) as step from walk where batch_id is not null group by 1),
chosen as (select k.* from kept k left join reached r using (batch_id) where k.step = coalesce(r.step, 0)),
free as (select batch_id, arg_max(depth, struct_pack(m := margin, d := -depth)) as best from grid group by 1)
select p.batch_id, p.store_id, coalesce(c.depth, 0) as recommended_depth, coalesce(f.best, 0) as unconstrained_depth,
       coalesce(c.depth < f.best - 1e-9, false) as is_budget_constrained, coalesce(c.spend, 0) as expected_markdown_spend,
       case when c.price is null then 'no_recommendation' when c.price < p.posted_price - 1e-9 then 'markdown' else 'hold_price' end as decision
from priced p left join chosen c on c.batch_id = p.batch_id left join free f on f.batch_id = p.batch_id"""


def stock_of_categories(wh):
    """Units and demand per store and category: hundreds to thousands of units a row."""
    sums = wh("mart_expiry_risk").groupBy("store_id", "l1_category").agg(F.sum("qty_remaining").alias("units"), F.sum("residual_demand_mean").alias("mu"))
    return sums.withColumn("k", forecast.fit_dispersion(wh("mart_forecast_accuracy")).select("k").scalar())


def value_of_models(wh):
    """Accuracy and value added per class of the boosted model; whether it beats both rivals over all held-out cells."""
    value = jobs.forecast_value(wh)
    error = lambda c: F.sum(F.col(c) * F.col("actual_units"))
    model, rival = jobs.model_accuracy(wh, "boosted"), jobs.model_accuracy(wh, "tweedie")
    missed = lambda df, c: df.agg(F.sum(F.abs(F.col("actual_units") - F.col(c))).alias("e")).scalar()
    summed = value.agg(error("wape").alias("e")).scalar()
    return value.select(
        "abc_xyz_class", "cells", "actual_units", "naive_wape",
        ((F.abs(F.col("naive_wape") - F.col("wape") - F.col("fva")) < 1e-9) & (F.abs(summed - missed(model, "forecast_units")) < 1e-3)).alias("ties"),
        (missed(model, "forecast_units") < missed(model, "naive_units")).alias("model_beats_naive"),
        (missed(model, "forecast_units") < missed(rival, "forecast_units")).alias("model_beats_regression"),
    )


def transfer_check(wh):
    """The plan against what each store has and needs, and its value against the bound."""
    arcs, plan = jobs.transfer_arcs(wh), wh("rec_transfer_order")
    stock = arcs.groupBy("from_store", "sku_id").agg(F.max(F.floor("units_at_risk")).alias("most"))
    need = arcs.groupBy("to_store", "sku_id").agg(F.max(F.floor("unmet_units")).alias("most"))
    holds = lambda side, keys: plan.groupBy(*keys).agg(F.sum("units").alias("u")).join(side, keys, "left").agg(F.coalesce(F.bool_and(F.col("u") <= F.col("most")), F.lit(True)).alias("ok"))
    size = arcs.agg(F.count("*").alias("arcs"), F.countDistinct("from_store", "to_store").alias("pairs"))
    pays = plan.groupBy("from_store", "to_store").agg(F.sum("net_benefit").alias("net")).agg(F.coalesce(F.bool_and(F.col("net") > 0), F.lit(True)).alias("ok"))
    always = lambda c: F.coalesce(F.bool_and(c), F.lit(True))
    rows = plan.agg(always(F.col("units") <= F.col("arc_cap")).alias("arcs_held"), always(F.col("units") >= transfers.MIN_UNITS).alias("least_held"))
    one = lambda df: df.select("ok").scalar()
    return jobs.transfer_bound(wh).join(size).join(rows).select(
        "arcs", "pairs", "opening_bound", one(holds(stock, ["from_store", "sku_id"])).alias("stock_held"), one(holds(need, ["to_store", "sku_id"])).alias("need_held"),
        "arcs_held", "least_held", one(pays).alias("trips_pay"), (F.col("value") <= F.col("bound") + 0.01).alias("below_bound"),
        (F.col("bound") <= F.col("opening_bound") + 1e-6).alias("bound_falls"),
    )


def decision_queries() -> dict[str, Query]:
    def q(build, cols, sql=None):
        return over_library(LIBRARY, build, cols, sql)

    return {
        "n01_eval_origins": q(
            lambda wh: forecast.eval_origins(wh("agg_store_sku_day"), wh.params), "origin_date:d", "select * from origins"
        ),
        "n02_backtest": q(
            lambda wh: wh("mart_forecast_accuracy"),
            "store_id:s sku_id:s date_day:d origin_date:d horizon_days:i abc_class:s xyz_class:s abc_xyz_class:s actual_units:i "
            "forecast_units:6 naive_units:6 baseline_units:6 model_name:s",
            "select * from accuracy",
        ),
        "n03_accuracy_by_class": q(
            lambda wh: forecast.accuracy_report(wh("mart_forecast_accuracy")), f"abc_xyz_class:s {ACCURACY}",
            REPORT_SQL.format(by="abc_xyz_class"),
        ),
        "n03_accuracy_by_horizon": q(
            lambda wh: forecast.accuracy_report(wh("mart_forecast_accuracy"), "horizon_days"), f"horizon_days:i {ACCURACY}",
            REPORT_SQL.format(by="horizon_days"),
        ),
        "n04_feature_frame": q(
            lambda wh: jobs.features(wh, forecast.eval_origins(wh("agg_store_sku_day"), wh.params)),
            "store_id:s sku_id:s date_day:d origin_date:d horizon_days:i demand_at_origin:4 roll_mean_7:6 roll_mean_28:6 roll_std_7:5 "
            "zero_share_28:6 days_since_last_sale:i lag_7:4 lag_14:4 lag_28:4 day_of_week:i is_weekend:b is_salary_week:b is_monsoon:b "
            "is_festival:b is_ipl_window:b is_month_end:b discount_pct:6 is_on_promo:b l1_category:s abc_class:s xyz_class:s "
            "target_demand:4 units_sold:i is_censored:b",
            "select * from features",
        ),
        "n05_train_origins": q(
            lambda wh: forecast.train_origins(wh("agg_store_sku_day"), wh.params), "origin_date:d", "select * from training_origins"
        ),
        "n06_train_demand": q(
            lambda wh: jobs.model_accuracy(wh),
            "store_id:s sku_id:s date_day:d origin_date:d horizon_days:i actual_units:i forecast_units:4 baseline_units:4 model_name:s",
        ),
        "n06_forecast_value": q(
            value_of_models,
            "abc_xyz_class:s cells:i actual_units:2 naive_wape:6 ties:b model_beats_naive:b model_beats_regression:b",
            """select abc_xyz_class, count(*) as cells, sum(actual_units) as actual_units,
                      sum(abs(actual_units - naive_units)) / sum(actual_units) as naive_wape, true as ties, true as model_beats_naive,
                      true as model_beats_regression
               from accuracy group by 1""",
        ),
        "n06_served_forecast": q(
            lambda wh: jobs.served_forecast(wh).groupBy("origin_date", "horizon_days").agg(
                F.count("*").alias("n"), F.count(F.when(F.col("forecast_units") < 0, 1)).alias("negative"),
                F.count(F.when(F.col("model_name") == forecast.BASELINE_NAME, 1)).alias("from_baseline"),
                F.sum(F.when(F.col("model_name") == forecast.BASELINE_NAME, F.col("forecast_units")).otherwise(0.0)).alias("baseline_units"),
            ),
            "origin_date:d horizon_days:i n:i negative:i from_baseline:i baseline_units:3",
            """select f.origin_date, f.horizon_days, count(*) as n, 0 as negative, count(*) filter (where x.sku_id is null) as from_baseline,
                      coalesce(sum(f.forecast_units) filter (where x.sku_id is null), 0) as baseline_units
               from forecast f left join (select distinct store_id, sku_id, date_day, origin_date, horizon_days from features) x
                    using (store_id, sku_id, date_day, origin_date, horizon_days) group by 1, 2""",
        ),
        "n06_baseline_forecast": q(
            lambda wh: wh("mart_demand_forecast"),
            "store_id:s sku_id:s date_day:d origin_date:d horizon_days:i forecast_units:6 model_name:s", "select * from forecast",
        ),
        "n07_dispersion": q(lambda wh: forecast.fit_dispersion(wh("mart_forecast_accuracy")), "k:6", "select k from dispersion"),
        "n08_batch_position": q(
            lambda wh: jobs.position(wh),
            "batch_id:s store_id:s sku_id:s l1_category:s expiry_date:d days_to_expiry:i qty_remaining:i units_ahead_in_queue:i horizon_demand_mean:6",
            "select * from stock_position",
        ),
        "n09_leftover": q(
            lambda wh: stock_of_categories(wh).select(
                "store_id", "l1_category", "units", F.round("mu", 9).alias("mu"), leftover_and_risk(F.col("units"), F.round("mu", 9), F.col("k")).alias("x")
            ).select("store_id", "l1_category", "units", "mu", "x.*"),
            "store_id:s l1_category:s units:i mu:6 leftover:4 risk:6",
            """select store_id, l1_category, units, mu, list_sum(list_transform(range(units), lambda i: (units - i) * exp(lp[i + 1]))) as leftover,
                      list_sum(list_transform(range(units), lambda i: exp(lp[i + 1]))) as risk
               from (select *, list_transform(range(units), lambda i: lgamma(i + k) - lgamma(k) - lgamma(i + 1) + k * ln(k / (k + mu)) + i * ln(mu / (k + mu))) as lp
                     from (select store_id, l1_category, cast(sum(qty_remaining) as int) as units, greatest(round(sum(residual_demand_mean), 9), 1e-9) as mu
                           from risk group by all), dispersion)""",
        ),
        "n10_expiry_risk": q(
            lambda wh: wh("mart_expiry_risk"),
            "batch_id:s store_id:s sku_id:s l1_category:s sku_name:s date_day:d expiry_date:d days_to_expiry:i usable_days:i "
            "qty_remaining:i units_ahead_in_queue:i horizon_demand_mean:6 residual_demand_mean:6 risk_state:s expiry_risk_score:6 "
            "units_at_risk:5 unit_landed_cost:2 value_at_risk_inr:4",
            "select * from risk",
        ),
        "n11_expiry_report": q(
            lambda wh: expiry.expiry_report(wh("mart_expiry_risk")),
            "risk_state:s batches:i units_on_hand:i units_at_risk:3 value_at_risk:2 mean_score:6",
            """select risk_state, count(*) as batches, sum(qty_remaining) as units_on_hand, sum(units_at_risk) as units_at_risk,
                      sum(value_at_risk_inr) as value_at_risk, avg(expiry_risk_score) as mean_score from risk group by 1""",
        ),
        "n11_expiry_by_category": q(
            lambda wh: expiry.expiry_report_by_category(wh("mart_expiry_risk")),
            "l1_category:s batches:i units_at_risk:3 value_at_risk:2 mean_dte:6",
            """select l1_category, count(*) as batches, sum(units_at_risk) as units_at_risk, sum(value_at_risk_inr) as value_at_risk,
                      avg(days_to_expiry) as mean_dte from risk where risk_state = 'at_risk' group by 1 having sum(value_at_risk_inr) > 0
               order by value_at_risk desc limit 10""",
        ),
        "n11_expiry_validate": q(
            lambda wh: expiry.expiry_validate(wh("mart_expiry_risk"), wh("fct_inventory_movement"), wh("agg_store_sku_day")),
            "units_on_hand:i sold_after:i written_off_after:i stranded_past_expiry:i predicted_units:3 predicted_value:2",
            """select sum(qty_remaining) as units_on_hand, sum(sold) as sold_after, sum(gone) as written_off_after,
                      coalesce(sum(if(expiry_date <= (select max(date_day) from cells), qty_remaining - sold - gone, 0)), 0) as stranded_past_expiry,
                      sum(units_at_risk) as predicted_units, sum(value_at_risk_inr) as predicted_value
               from (select r.batch_id, any_value(qty_remaining) as qty_remaining, any_value(units_at_risk) as units_at_risk,
                            any_value(value_at_risk_inr) as value_at_risk_inr, any_value(r.expiry_date) as expiry_date,
                            coalesce(sum(if(m.event_type = 'sale', -m.qty_delta, 0)), 0) as sold,
                            coalesce(sum(if(m.event_type = 'expiry_writeoff', -m.qty_delta, 0)), 0) as gone
                     from risk r left join movement m on m.batch_id = r.batch_id and m.date_day > r.date_day
                     where r.risk_state = 'at_risk' group by 1)""",
        ),
        "n12_elasticity_panel": q(
            lambda wh: wh("elasticity_panel"),
            "store_id:s sku_id:s date_day:d units_on_hand:i days_to_expiry:i dte_band:s l1_category:s abc_class:s units_sold:i "
            "price_ratio:5 is_weekend:b is_festival:b is_salary_week:b baseline_units:6 undiscounted_days:i",
            "select * from elastic_panel",
        ),
        "n15_price_elasticity": q(
            lambda wh: wh("mart_price_elasticity"),
            "l1_category:s dte_band:s observations:i discounted_observations:i elasticity_raw:5 standard_error:5 is_identified:b "
            "category_elasticity:5 category_standard_error:5 signal_weight:5 elasticity_shrunk:5 elasticity:5 elasticity_basis:s",
        ),
        "n16_markdown_decisions": q(
            lambda wh: jobs.decisions(wh),
            "batch_id:s store_id:s sku_id:s l1_category:s dte_band:s qty_remaining:i base_price:2 posted_price:2 elasticity_raw:5 is_identified:b",
        ),
        "n16_posted_prices": q(
            lambda wh: jobs.priced(wh),
            "batch_id:s store_id:s sku_id:s l1_category:s dte_band:s qty_remaining:i base_price:2 posted_price:2",
            "select * from priced",
        ),
        "n17_markdown_grid": q(
            lambda wh: markdown.evaluate(jobs.priced(wh), F.lit(-1.6)),
            "batch_id:s store_id:s sku_id:s depth:2 price:4 demand:5 batch_sold:5 total_sold:5 margin:4 spend:4",
            "select * from grid",
        ),
        "n18_concave_frontier": q(
            lambda wh: markdown.concave_frontier(markdown.evaluate(jobs.priced(wh), F.lit(-1.6))).select(
                "store_id", "batch_id", F.size("steps").alias("n_steps"),
                F.element_at("steps", -1)["depth"].alias("deepest"), F.element_at("steps", -1)["margin"].alias("best_margin"),
            ),
            "store_id:s batch_id:s n_steps:i deepest:2 best_margin:4",
            """with up as (select *, row_number() over (partition by batch_id order by spend, margin, depth) as n from grid),
                    rising as (select * from up u where n = 1 or not exists (
                      select 1 from up e where e.batch_id = u.batch_id and e.n < u.n and e.margin >= u.margin)),
                    kept as (select * from rising i where n = 1 or not exists (
                      select 1 from rising a join rising b on a.batch_id = b.batch_id where a.batch_id = i.batch_id and a.n < i.n and b.n > i.n
                        and (b.margin - a.margin) * greatest(i.spend - a.spend, 1e-9) >= (i.margin - a.margin) * greatest(b.spend - a.spend, 1e-9)))
               select store_id, batch_id, count(*) as n_steps, arg_max(depth, n) as deepest, arg_max(margin, n) as best_margin
               from kept group by store_id, batch_id""",
        ),
        "n20_rec_markdown": q(
            lambda wh: wh("rec_markdown"),
            "batch_id:s store_id:s sku_id:s dte_band:s recommended_depth:2 recommended_price:2 unconstrained_depth:2 is_budget_constrained:b "
            "expected_units_sold:4 expected_markdown_spend:4 expected_margin:4 margin_vs_do_nothing:4 decision:s decline_reason:s elasticity_used:5",
        ),
        "n20_elastic_plan": q(
            lambda wh: markdown.optimise(
                jobs.priced(wh).withColumns(
                    {"elasticity_raw": F.lit(-1.6), "is_identified": F.lit(True), "elasticity_basis": F.lit("assumed")}
                ), budget=100.0
            ),
            "batch_id:s store_id:s recommended_depth:2 unconstrained_depth:2 is_budget_constrained:b expected_markdown_spend:4 decision:s",
            PLAN_SQL,
        ),
        "n21_monotonicity": q(
            lambda wh: markdown.check_monotonicity(
                wh("mart_expiry_risk").filter(F.col("days_to_expiry").between(1, 7)).select("days_to_expiry")
            ),
            "days_to_expiry:i depth:2 margin:4",
            """select d as days_to_expiry, round(1 - r, 2) as depth, m as margin
               from (select d, r, least(12 * d * pow(r, -1.6), 120) * (100 * r - 60) - (120 - least(12 * d * pow(r, -1.6), 120)) * 60 as m
                     from (select distinct days_to_expiry as d from risk where days_to_expiry between 1 and 7),
                          (select round(1 - n * 0.05::double, 2) as r from range(9) t(n)))
               qualify row_number() over (partition by d order by round(m, 9) desc, r desc) = 1""",
        ),
        "n21_measured_profile": q(
            lambda wh: markdown.measured_depth_profile(jobs.decisions(wh)),
            "l1_category:s dte_band:s days_to_expiry:i elasticity:5 is_identified:b depth:2 margin:4",
        ),
        "n22_deal_candidates": q(
            lambda wh: jobs.deal_candidates(wh),
            "store_id:s sku_id:s date_day:d l2_subcategory:s is_private_label:b on_hand_units:i days_to_expiry:i units_at_risk:5 "
            "value_at_risk:4 unit_landed_cost:2 base_units_per_day:6 base_price:2",
            "select *, rate as base_units_per_day from deal_pool",
        ),
        "n23_deal_score": q(
            lambda wh: slots.deal_score(jobs.deal_candidates(wh)),
            "store_id:s sku_id:s expected_units:5 clearance_value:4 basket_value:4 cannibalisation_drag:4 item_margin_delta:4 slot_value:4",
            "select * from deal_values",
        ),
        "n24_deal_slots": q(
            lambda wh: wh("rec_deal_slot"),
            "store_id:s sku_id:s slot_rank:i slot_value:4 is_private_label:b",
            """select store_id, sku_id, row_number() over (partition by store_id order by slot_value desc, sku_id) as slot_rank, slot_value, is_private_label
               from (select store_id, unnest(picks) as sku_id from deal_sets where labels >= 1
                     qualify row_number() over (partition by store_id order by total desc) = 1)
               join deal_values using (store_id, sku_id)""",
        ),
        "n25_breakeven_reactivation": q(
            lambda wh: slots.breakeven_reactivation_value(slots.deal_score(jobs.deal_candidates(wh))),
            "breakeven_reactivation_value:4",
            """select coalesce(median(v), 0) as breakeven_reactivation_value
               from (select -slot_value / (expected_units * 0.0283) as v from deal_values) where v > 0""",
        ),
        "n26_transfer_candidates": q(
            lambda wh: jobs.transfer_candidates(wh),
            "date_day:d from_store:s to_store:s sku_id:s km:3 units_at_risk:5 days_to_expiry:i unit_landed_cost:2 unmet_units:4 daily_rate:6 unit_margin:2",
            "select * from arcs",
        ),
        "n27_shelf_life_gate": q(
            lambda wh: transfers.shelf_life_gate(jobs.transfer_candidates(wh, transfers.MIN_UNITS)),
            "from_store:s to_store:s sku_id:s transit_hours:6 arc_cap:i unit_benefit:2",
            """select *, cast(round(cap) as int) as arc_cap, unit_landed_cost + greatest(unit_margin, 0) as unit_benefit
               from arcs where round(cap) >= 6""",
        ),
        "n28_transfer_plan": q(
            lambda wh: wh("rec_transfer_order"),
            "from_store:s to_store:s sku_id:s units:i avoided_writeoff:2 recovered_margin:2 trip_cost:2 trip_cost_share:4 net_benefit:4 method:s",
        ),
        "n28_transfer_bound": q(
            transfer_check,
            "arcs:i pairs:i opening_bound:2 stock_held:b need_held:b arcs_held:b least_held:b trips_pay:b below_bound:b bound_falls:b",
            """select sum(n) as arcs, count(*) as pairs, sum(greatest(gain - (300 + 15 * km), 0)) as opening_bound, true as stock_held,
                      true as need_held, true as arcs_held, true as least_held, true as trips_pay, true as below_bound, true as bound_falls
               from (select from_store, to_store, any_value(km) as km, count(*) as n,
                            sum(cast(round(cap) as int) * (unit_landed_cost + greatest(unit_margin, 0))) as gain
                     from arcs where round(cap) >= 6 group by all)""",
        ),
        "n30_replenish_candidates": q(
            lambda wh: jobs.replenish_candidates(wh),
            "store_id:s sku_id:s date_day:d l1_category:s shelf_life_days:i base_price:2 landed_cost:2 daily_forecast:6 on_hand_units:i "
            "lead_days:4 mean_lead_days:6",
            "select * from reorder",
        ),
        "n31_purchase_orders": q(
            lambda wh: wh("rec_purchase_order"),
            "store_id:s sku_id:s daily_forecast:6 critical_ratio:5 p_spoil:5 uncapped_order_up_to:0 shelf_life_cap:0 order_up_to:0 "
            "is_shelf_life_capped:b on_hand_units:0 order_units:0",
        ),
    }
