"""Registered queries: deal effects, uplift, difference-in-differences, delivery cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from larder.causal import deal, did, uplift
from larder.decisions import delivery
from larder.operators import marts
from larder.plans import jobs, served
from suite.ctes_feeds import FEEDS
from suite.ctes_jobs import JOBS
from suite.ctes_models import MODELS
from suite import trials
from suite.models import over_library
from suite.spec import Query

D = "'PROMO-DEAL11'"
BEFORE_AND_AFTER = [f"{c}_pre" for c in ("orders", "margin", "revenue", "units", "skus", "active_days", "promo_units")] + ["margin_post", "orders_post"]
CAUSAL = {
    "customer_deal": f"""
select e.customer_id, e.deal_arm, coalesce(orders, 0) as orders, coalesce(revenue, 0) as revenue, coalesce(margin, 0) as margin,
       coalesce(dm, 0) as deal_margin, coalesce(nm, 0) as nondeal_margin
from crm_deal_exposure e left join (
  select customer_id, count(distinct order_id) as orders, sum(net_revenue) as revenue, sum(gross_margin) as margin,
         sum(if(promo_id = {D}, gross_margin, 0)) as dm, sum(if(promo_id is distinct from {D}, gross_margin, 0)) as nm
  from order_item group by 1) using (customer_id)""",
    "deal_blocks": f"""
select store_id, sku_id, effective_from_date as a, effective_to_date - 1 as b from price_spans where promo_id = {D}""",
    "deal_events": """
select c.store_id, c.sku_id, k.a as block_start, k.b as block_end, c.date_day,
       case when c.date_day < k.a then c.date_day - k.a when c.date_day > k.b then c.date_day - k.b else 0 end as rel_day,
       c.date_day >= k.a and c.date_day <= k.b as in_block, c.units_sold, n.baseline_units, c.units_sold - n.baseline_units as lift
from (select store_id, sku_id, min(a) as a, min(b) as b from deal_blocks group by 1, 2 having count(*) = 1) k
join cells c on c.store_id = k.store_id and c.sku_id = k.sku_id
join (select f.store_id, f.sku_id, avg(f.units_sold) as baseline_units
      from (select distinct store_id, sku_id from deal_blocks) d
      join cells f on f.store_id = d.store_id and f.sku_id = d.sku_id
      left join (select distinct store_id, sku_id, cast(unnest(generate_series(a - 7, b + 7, interval 1 day)) as date) as date_day from deal_blocks) o
        on o.store_id = f.store_id and o.sku_id = f.sku_id and o.date_day = f.date_day
      where not f.is_censored and o.store_id is null
      group by 1, 2 having count(*) >= 7) n on n.store_id = c.store_id and n.sku_id = c.sku_id
where not c.is_censored and c.date_day between k.a - 7 and k.b + 7""",
    "retained": f"""
select e.customer_id, e.deal_arm, coalesce(r.redeemed, 0) as redeemed, (c.churn_date is not null)::int as churned,
       coalesce(r.recent, 0) as active_recent, coalesce(s.n, 0) as stockout_days
from crm_deal_exposure e join customers c using (customer_id)
left join (select customer_id, max((coalesce(promo_id = {D}, false) and date_day >= date '2025-07-01')::int) as redeemed,
                  max((date_day > (select max(date_day) from order_item) - 30)::int) as recent from order_item group by 1) r using (customer_id)
left join (select i.customer_id, count(distinct i.date_day) as n from order_item i
           join cells x on x.store_id = i.store_id and x.sku_id = i.sku_id and x.date_day = i.date_day
           where x.is_censored and i.date_day >= date '2025-07-01' group by 1) s using (customer_id)""",
    "responders": f"""
select e.customer_id, (e.deal_arm = 'exposed')::int as treated, c.is_member::int as is_member, c.acquisition_channel, c.device,
       date '2025-07-01' - c.signup_date as tenure_days, {', '.join(f"coalesce({c}, 0) as {c}" for c in BEFORE_AND_AFTER)},
       coalesce(date '2025-07-01' - p.last_day, 999) as recency_pre, (c.churn_date is not null)::int as churned,
       if(coalesce(units_pre, 0) > 0, promo_units_pre / units_pre, 0) as promo_share_pre,
       if(coalesce(orders_pre, 0) > 0, revenue_pre / orders_pre, 0) as basket_pre
from crm_deal_exposure e join customers c using (customer_id)
left join (select customer_id, count(distinct order_id) as orders_pre, round(sum(gross_margin), 2) as margin_pre,
                  round(sum(net_revenue), 2) as revenue_pre, sum(signed_qty) as units_pre, count(distinct sku_id) as skus_pre,
                  count(distinct date_day) as active_days_pre, max(date_day) as last_day,
                  sum(if(promo_id is not null, signed_qty, 0)) as promo_units_pre
           from order_item where date_day < date '2025-07-01' group by 1) p using (customer_id)
left join (select customer_id, round(sum(gross_margin), 2) as margin_post, count(distinct order_id) as orders_post
           from order_item where date_day >= date '2025-07-01' group by 1) q using (customer_id)
where c.signup_date < date '2025-07-01'""",
    "ranking": """
select customer_id, units_pre as uplift, i as position,
       yt - if(nc > 0, yc * nt / nc, 0) as gain, count(*) over () as n
from (select customer_id, units_pre, row_number() over w as i, sum(treated) over w as nt, sum(1 - treated) over w as nc,
             sum(margin_post * treated) over w as yt, sum(margin_post * (1 - treated)) over w as yc
      from responders window w as (order by units_pre desc, customer_id rows unbounded preceding))""",
    "trial": """
select l1_category as seed, store_id, date_day - date '2025-07-01' as day_rel, date_day >= date '2025-07-01' as post,
       cast(store_id[5:] as int) % 2 = 0 as treated, sum(units_sold) as units_sold, sum(writeoff_units) as units_expired,
       sum(writeoff_value) as writeoff_value, sum(greatest(units_demanded_imputed - units_sold, 0)) as units_lost, sum(net_revenue) as revenue,
       sum(cogs) as cogs, sum(net_revenue) - sum(cogs) as margin, sum(markdown_subsidy_platform) as markdown_subsidy,
       sum(order_count) as orders
from cells group by seed, store_id, date_day""",
    "trial_rates": """
select *, writeoff_value / nullif(revenue, 0) as wastage_rate_value, (revenue - cogs - writeoff_value) / nullif(revenue, 0) as gm_awm_pct,
       1 - units_lost / nullif(units_sold + units_lost, 0) as availability_pct, markdown_subsidy as markdown_subsidy_inr from trial""",
    "trial_parts": """
select 'full' as component, * from trial
union all by name select 'markdown' as component, * replace (revenue + markdown_subsidy as revenue, margin + markdown_subsidy as margin) from trial
union all by name select 'freshness' as component, * replace (0 as units_expired, 0 as writeoff_value) from trial
union all by name select 'availability' as component, * replace (0 as units_lost) from trial""",
    "trial_costs": """
select 'delivery_cost' as param, cost as value, t.* replace (margin - cost * orders as margin) from trial t, (select unnest([0.0, 42.0, 70.0]) as cost)""",
}
LIBRARY = {**FEEDS, **MODELS, **JOBS, **CAUSAL}
# Fixed value: Student's 0.975 quantile for five degrees of freedom.
T_975_5 = 2.5705818356363155


def welch_sql(source: str, outcomes: list[str]) -> str:
    one = """select '{o}' as outcome, m1 as exposed_mean, m0 as holdout_mean, m1 - m0 as diff, m1 - m0 - 1.96 * se as ci_low,
       m1 - m0 + 1.96 * se as ci_high, 2.8 * se as mde, abs(m1 - m0) > 1.96 * se as is_significant, n1 as n_exposed, n0 as n_holdout
from (select *, sqrt(v1 / n1 + v0 / n0) as se from (
  select avg({o}) filter (deal_arm = 'exposed') as m1, avg({o}) filter (deal_arm <> 'exposed') as m0,
         var_samp({o}) filter (deal_arm = 'exposed') as v1, var_samp({o}) filter (deal_arm <> 'exposed') as v0,
         count(*) filter (deal_arm = 'exposed') as n1, count(*) filter (deal_arm <> 'exposed') as n0 from {s}))"""
    return " union all ".join(one.format(o=o, s=source) for o in outcomes)


def did_sql(metric: str) -> str:
    return f"""select seed, '{metric}' as metric, avg({metric}) filter (post and treated) - avg({metric}) filter (not post and treated)
       - avg({metric}) filter (post and not treated) + avg({metric}) filter (not post and not treated) as did from trial group by seed"""


def effects_sql(source: str, metrics: list[str], by: str = "") -> str:
    """Mean effect over the six categories, its Student interval, the base it is relative to and its p-value (five
    degrees of freedom have a closed form)."""
    keys = f"{by}, " if by else ""
    cell = "avg({m}) filter ({a} post and {b} treated)"
    one = "select {k}'{m}' as metric, seed, " + " ".join(
        sign + cell.replace("{a}", a).replace("{b}", b) for sign, a, b in (("", "", ""), ("- ", "not", ""), ("- ", "", "not"), ("+ ", "not", "not"))
    ) + " as did from {s} group by {k}seed"
    base = "select {k}'{m}' as metric, avg({m}) filter (post and not treated) as base from {s}" + (" group by {k}metric" if by else "")
    dids = " union all ".join(one.format(k=keys, m=m, s=source) for m in metrics)
    bases = " union all ".join(base.format(k=keys, m=m, s=source) for m in metrics)
    return f"""select *, effect - {T_975_5} * se as ci_low, effect + {T_975_5} * se as ci_high, 100 * effect / nullif(base, 0) as relative,
       1 - 2 / pi() * (angle + sin(angle) * (cos(angle) + 2 / 3.0 * pow(cos(angle), 3))) as p_value
from (select *, atan(abs(effect) / nullif(se, 0) / sqrt(5)) as angle
      from (select {keys}metric, avg(did) as effect, stddev_samp(did) / sqrt(count(did)) as se, count(did) as seeds from ({dids}) group by {keys}metric)
      join ({bases}) using ({keys}metric))"""


# Two-sided Student p-values have a closed form for few degrees of freedom (here categories less one).
GAPS_TESTED = """
select *, case seeds - 1 when 6 then 1 - sin(angle) * (1 + pow(cos(angle), 2) / 2 + 3 * pow(cos(angle), 4) / 8)
                         when 5 then 1 - 2 / pi() * (angle + sin(angle) * (cos(angle) + 2 / 3.0 * pow(cos(angle), 3)))
                         when 4 then 1 - sin(angle) * (1 + pow(cos(angle), 2) / 2)
                         when 3 then 1 - 2 / pi() * (angle + sin(angle) * cos(angle))
                         when 2 then 1 - sin(angle) end as p
from (select metric, avg(gap) as mean_gap, count(gap) as seeds,
             atan(abs(avg(gap)) / nullif(stddev_samp(gap) / sqrt(count(gap)), 0) / sqrt(count(gap) - 1)) as angle
      from ({gaps}) group by metric)"""
READOUT_SQL = f"""select metric, case metric when 'markdown_subsidy_inr' then 'money' else 'ratio' end as unit, policy_a, policy_b, effect as delta, ci_low, ci_high,
                       ci_low > 0 or ci_high < 0 as significant, seeds, null as not_applicable_reason
                from ({effects_sql("trial_rates", [m for m, _ in did.READOUT])}) e
                join ({" union all ".join(f"select '{m}' as metric, avg({m}) filter (not treated) as policy_a, avg({m}) filter (treated) as policy_b from trial_rates where post" for m, _ in did.READOUT)}) using (metric)
                union all values {", ".join(f"('{m}', 'n/a', null, null, null, null, null, null, null, '{why}')" for m, why in did.NOT_APPLICABLE.items())}"""
PRESENTED_SQL = f"""
select *, coalesce(nullif(list_position({marts.EXPERIMENT_METRICS}, metric), 0), 9) as display_order, not_applicable_reason is null as is_measured,
       {", ".join(f"round({c} * scale, 2) as display_{c}" for c in ("policy_a", "policy_b", "delta"))},
       case unit when 'ratio' then 'pp' when 'money' then 'Rs' else 'n/a' end as display_unit
from (select *, if(unit = 'ratio', 100.0, 1.0) as scale from ({READOUT_SQL}))"""
WELCH = "outcome:s exposed_mean:4 holdout_mean:4 diff:4 ci_low:4 ci_high:4 mde:4 is_significant:b n_exposed:i n_holdout:i"
DID_ALL = " union all ".join(did_sql(m) for m in did.METRICS)
BASE_ALL = " union all ".join(
    f"select '{m}' as metric, avg({m}) filter (post and not treated) as base from trial" for m in did.METRICS
)
GAP_ALL = " union all ".join(
    f"""select seed, '{m}' as metric, regr_slope(y, day_rel) filter (treated) - regr_slope(y, day_rel) filter (not treated) as gap
        from (select seed, day_rel, treated, avg({m}) as y from trial where not post group by all) group by seed"""
    for m in did.METRICS
)


def causal_queries() -> dict[str, Query]:
    def q(build, cols, sql=None):
        return over_library(LIBRARY, build, cols, sql)

    return {
        "n32_deal_pnl": q(
            lambda wh: deal.deal_pnl(wh("fct_order_item")),
            "lines:i units:i revenue:2 cogs:2 margin:2 first_day:d last_day:d price_per_unit:4 price_is_right:b",
            f"""select count(*) as lines, sum(signed_qty) as units, sum(net_revenue) as revenue, sum(cogs) as cogs,
                       sum(net_revenue) - sum(cogs) as margin, min(date_day) as first_day, max(date_day) as last_day,
                       sum(net_revenue) / sum(signed_qty) as price_per_unit, abs(sum(net_revenue) / sum(signed_qty) - 11) <= 0.05 as price_is_right
                from order_item where promo_id = {D}""",
        ),
        "n33_itt_effects": q(
            lambda wh: deal.itt_effects(deal.per_customer(wh("fct_order_item"), wh("stg_crm__deal_exposure"))),
            WELCH, welch_sql("customer_deal", deal.ITT_OUTCOMES),
        ),
        "n34_naive_attach": q(
            lambda wh: deal.naive_attach(wh("fct_order_item")), "dealt_mean:4 undealt_mean:4 naive_attach:4 store_days:i",
            f"""select avg(d) as dealt_mean, avg(u) as undealt_mean, avg(d - u) as naive_attach, count(*) as store_days
                from (select store_id, date_day, avg(case when took then rest end) as d, avg(case when not took then rest end) as u
                      from (select order_id, store_id, date_day, bool_or(coalesce(promo_id = {D}, false)) as took,
                                   sum(if(promo_id is distinct from {D}, gross_margin, 0)) as rest from order_item group by all)
                      group by all) where d is not null and u is not null""",
        ),
        "n35_event_panel": q(
            lambda wh: wh("event_panel"),
            "store_id:s sku_id:s block_start:d block_end:d date_day:d rel_day:i in_block:b units_sold:i baseline_units:6 lift:6",
            "select * from deal_events",
        ),
        "n35_by_relative_day": q(
            lambda wh: deal.by_relative_day(wh("event_panel")),
            "in_block:b rel_day:i mean_units:6 baseline:6 lift:6 sd:5 n:i ci_low:5 ci_high:5",
            """select in_block, rel_day, avg(units_sold) as mean_units, avg(baseline_units) as baseline, avg(lift) as lift, stddev_samp(lift) as sd,
                      count(*) as n, avg(lift) - 1.96 * stddev_samp(lift) / sqrt(count(*)) as ci_low,
                      avg(lift) + 1.96 * stddev_samp(lift) / sqrt(count(*)) as ci_high from deal_events group by in_block, rel_day""",
        ),
        "n35_event_summary": q(
            lambda wh: deal.event_summary(wh("event_panel")),
            "blocks:i in_block_lift:5 pre_window_lift:5 post_window_lift:5 net_cannibalisation:5",
            """select n as blocks, sum(if(in_block, lift, 0)) / n as in_block_lift, sum(if(not in_block and rel_day < 0, lift, 0)) / n as pre_window_lift,
                      sum(if(not in_block and rel_day > 0, lift, 0)) / n as post_window_lift, sum(if(not in_block, lift, 0)) / n as net_cannibalisation
               from deal_events, (select count(distinct (store_id, sku_id, block_start)) as n from deal_events) group by n""",
        ),
        "n36_retention_outcomes": q(
            lambda wh: jobs.retention(wh), "customer_id:s deal_arm:s redeemed:i churned:i active_recent:i stockout_days:i", "select * from retained"
        ),
        "n36_retention_effects": q(
            lambda wh: deal.retention_effects(jobs.retention(wh)), WELCH, welch_sql("retained", deal.RETENTION_OUTCOMES)
        ),
        "n37_exclusion_check": q(
            lambda wh: deal.exclusion_check(jobs.retention(wh)),
            "nonredeemer_stockout_days:6 holdout_stockout_days:6 compliance:6 churn_itt:6 wald_churn:6",
            """select *, churn_itt / compliance as wald_churn from (
                 select avg(stockout_days) filter (deal_arm = 'exposed' and redeemed = 0) as nonredeemer_stockout_days,
                        avg(stockout_days) filter (deal_arm = 'holdout') as holdout_stockout_days,
                        avg(redeemed) filter (deal_arm = 'exposed') as compliance,
                        avg(churned) filter (deal_arm = 'exposed') - avg(churned) filter (deal_arm = 'holdout') as churn_itt from retained)""",
        ),
        "n38_uplift_panel": q(
            lambda wh: wh("uplift_panel"),
            "customer_id:s treated:i is_member:i acquisition_channel:s device:s tenure_days:i orders_pre:i margin_pre:2 revenue_pre:2 units_pre:i "
            "skus_pre:i active_days_pre:i promo_units_pre:i recency_pre:i promo_share_pre:5 basket_pre:4 margin_post:2 orders_post:i churned:i",
            "select * from responders",
        ),
        **{
            f"n39_{name}": q(lambda wh, name=name: jobs.uplift_scores(wh, name), "customer_id:s treated:i uplift:4")
            for name in ("t_learner", "x_learner", "transformed_outcome")
        },
        "n40_two_stage": q(lambda wh: jobs.uplift_scores(wh, "two_stage"), "customer_id:s treated:i uplift:4"),
        "n41_causal_tree": q(lambda wh: jobs.uplift_scores(wh, "causal_tree"), "customer_id:s treated:i uplift:4"),
        "n42_gain_curve": q(
            lambda wh: jobs.behaviour_curve(wh), "customer_id:s position:i gain:2", "select * from ranking"
        ),
        "n42_qini": q(
            lambda wh: uplift.qini(jobs.behaviour_curve(wh)), "n:i area:3 random_area:3 coefficient:3",
            """select n, area, random_area, area - random_area as coefficient from (
                 select max(n) as n, sum((gain + nextg) / 2 / n) filter (nextg is not null) as area,
                        sum((last_gain * position / n + last_gain * (position + 1) / n) / 2 / n) filter (nextg is not null) as random_area
                 from (select *, lead(gain) over (order by position) as nextg, arg_max(gain, position) over () as last_gain from ranking))""",
        ),
        "n43_targeting_curve": q(
            lambda wh: uplift.targeting_curve(jobs.behaviour_curve(wh)), "targeted:2 gain:2 vs_random:2",
            """select f as targeted, gain, gain - (select arg_max(gain, position) from ranking) * position / n as vs_random
               from ranking, (select unnest([0.1::double, 0.2, 0.3, 0.5, 1.0]) as f) where position = least(floor(f * n) + 1, n)""",
        ),
        "n44_deal_readout": q(
            lambda wh: jobs.deal_readout(wh), "page:s metric:s label:s value:2 ci_low:2 ci_high:2 unit:s source:s note:s"
        ),
        "m33_deal_readout_display": q(
            lambda wh: jobs.presented_readout(wh), "page:s page_order:i metric:s value:2 unit:s is_significant:b display_value:s"
        ),
        "n45_seed_did": q(lambda wh: did.seed_did(trials.trial(wh)), "seed:s metric:s did:3", DID_ALL),
        "n45_did_estimate": q(
            lambda wh: did.estimate(trials.trial(wh)), "metric:s effect:3 relative:3 ci_low:3 ci_high:3 seeds:i",
            f"""select metric, effect, 100 * effect / base as relative, effect - h as ci_low, effect + h as ci_high, seeds
                from (select metric, avg(did) as effect, {T_975_5} * stddev_samp(did) / sqrt(count(did)) as h, count(did) as seeds
                      from ({DID_ALL}) group by metric) join ({BASE_ALL}) using (metric)""",
        ),
        "n46_pre_trend_gap": q(lambda wh: did.pre_trend_gap(trials.trial(wh)), "seed:s metric:s gap:4", GAP_ALL),
        "n46_parallel_trends": q(
            lambda wh: did.trends_are_parallel(did.pre_trend_gap(trials.trial(wh))), "metric:s mean_gap:4 seeds:i p_value:5 parallel:b",
            f"select metric, mean_gap, seeds, p as p_value, p > {did.TRENDS_ALPHA} as parallel from ({GAPS_TESTED.format(gaps=GAP_ALL)})",
        ),
        "n47_experiment_readout": q(
            lambda wh: trials.experiment(wh),
            "metric:s unit:s policy_a:4 policy_b:4 delta:4 ci_low:4 ci_high:4 significant:b seeds:i not_applicable_reason:s",
            READOUT_SQL,
        ),
        "m34_experiment_display": q(
            lambda wh: trials.presented_experiment(wh),
            "metric:s display_order:i is_measured:b display_policy_a:2 display_policy_b:2 display_delta:2 display_unit:s",
            PRESENTED_SQL,
        ),
        "v04_experiment_rows": q(
            lambda wh: served.experiment_rows(wh("mart_experiment_readout")), "metric:s display_order:i display_delta:2 display_unit:s", PRESENTED_SQL
        ),
        "v06_deal_page": q(
            lambda wh: served.deal_page(wh("mart_deal_readout"), "what_runs_tomorrow"), "page:s metric:s value:2 unit:s",
            """select 'what_runs_tomorrow' as page, x.metric, x.value, x.unit
               from (select count(*) as n, coalesce(sum(slot_value), 0) as total
                     from (select store_id, unnest(picks) as sku_id from deal_sets where labels >= 1
                           qualify row_number() over (partition by store_id order by total desc) = 1) join deal_values using (store_id, sku_id)),
                    lateral (values ('slots_recommended', n, 'count'), ('slot_value_total', total, 'inr')) x(metric, value, unit)""",
        ),
        "n48_attribution": q(
            lambda wh: did.attribution(trials.component_trial(wh)), "metric:s component:s contribution:4 total:4",
            f"""with e as (select component, metric, relative from ({effects_sql("trial_parts", did.METRICS, "component")})),
                     parts as (select p.metric, p.component, f.relative - p.relative as contribution, f.relative as total
                               from e p join e f on f.metric = p.metric and f.component = 'full' where p.component <> 'full')
                select * from parts union all select metric, 'residual', any_value(total) - sum(contribution), any_value(total) from parts group by metric""",
        ),
        "n49_sensitivity": q(
            lambda wh: did.sensitivity(trials.swept_trial(wh), ["margin", "revenue"]),
            "param:s metric:s settings:i lowest:3 highest:3 worst_p:4 survives:b",
            f"""select param, metric, count(*) as settings, min(effect) as lowest, max(effect) as highest, max(p_value) as worst_p,
                       count(*) >= 2 and count(distinct effect > 0) = 1 and bool_and(coalesce(p_value < 0.05, false)) as survives
                from ({effects_sql("trial_costs", ["margin", "revenue"], "param, value")}) group by 1, 2""",
        ),
        "n50_delivery_cost_sweep": q(
            lambda wh: delivery.delivery_cost_sweep(wh("mart_customer_360")), "ddi_band:s cost:2 customers:i orders:i contribution_per_customer:4",
            """select ddi_band, c as cost, count(*) as customers, sum(orders_90d) as orders,
                      (sum(gross_margin_90d) - c * sum(orders_90d)) / count(*) as contribution_per_customer
               from customer_360, (select unnest(range(0, 71, 2)) as c) group by ddi_band, c""",
        ),
        "n50_crossover": q(
            lambda wh: delivery.crossover(delivery.delivery_cost_sweep(wh("mart_customer_360")), "high", "low"), "crossover_cost:2",
            """select min(case when ahead <> start then c end) as crossover_cost
               from (select c, ahead, first_value(ahead) over (order by c) as start
                     from (select c, max(v) filter (ddi_band = 'high') > max(v) filter (ddi_band = 'low') as ahead
                           from (select ddi_band, c, (sum(gross_margin_90d) - c * sum(orders_90d)) / count(*) as v
                                 from customer_360, (select unnest(range(0, 71, 2)) as c) group by ddi_band, c) group by c))""",
        ),
        "n53_arm_totals": q(
            lambda wh: did.arm_totals(
                trials.trial(wh).withColumn("arm", F.when(F.col("treated"), "optimized").otherwise("baseline"))
            ),
            "arm:s units_demanded:2 units_sold:i units_expired:i writeoff_value:2 revenue:2 cogs:2",
            """select if(treated, 'optimized', 'baseline') as arm, sum(units_sold + units_lost) as units_demanded, sum(units_sold) as units_sold,
                      sum(units_expired) as units_expired, sum(writeoff_value) as writeoff_value, sum(revenue) as revenue, sum(cogs) as cogs
               from trial group by treated""",
        ),
    }
