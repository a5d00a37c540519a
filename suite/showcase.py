"""Registered queries: the showcase questions."""

from __future__ import annotations

from larder.plans import showcase as sc
from suite.models import over_warehouse
from suite.spec import Query

PAIR_THRESHOLD = 15

ACCOUNTS = """
select coalesce(l.batch_id, m.batch_id) as batch_id, coalesce(is_reconciled, false) as is_reconciled, l.batch_id is null as no_ledger,
       m.batch_id is null as no_moves, coalesce(qty_received, 0) as lr, coalesce(qty_sold, 0) as ls,
       coalesce(qty_received, 0) - coalesce(qty_sold, 0) - coalesce(qty_written_off, 0) - coalesce(qty_remaining, 0) as lgap,
       coalesce(mr, 0) as mr, coalesce(ms, 0) as ms, coalesce(mr, 0) - coalesce(ms, 0) - coalesce(mw, 0) - coalesce(mb, 0) as mgap
from batch l full join (
  select batch_id, sum(if(event_type in ('inbound', 'opening_balance'), units, 0)) as mr, sum(if(event_type = 'sale', units, 0)) as ms,
         sum(if(event_type = 'expiry_writeoff', units, 0)) as mw, sum(qty_delta) as mb from movement group by batch_id) m
  on m.batch_id = l.batch_id"""


def showcase_queries() -> dict[str, Query]:
    q = over_warehouse
    return {
        "q01_running_inventory_balance": q(
            sc.running_balance,
            "batch_id:s store_id:s sku_id:s movements:i closing_units:i writeoff_events:i disagreements:i",
            """select batch_id, store_id, sku_id, count(*) as movements, sum(qty_delta) as closing_units,
                      sum((event_type = 'expiry_writeoff')::int) as writeoff_events, 0 as disagreements
               from movement group by all having sum(qty_delta) > 0 order by closing_units desc, batch_id limit 50""",
        ),
        "q02_fefo_allocation": q(
            sc.fefo_queue,
            "store_id:s sku_id:s batch_id:s expiry_date:d days_left:i qty_remaining:i units_ahead_in_queue:i daily_units:2 "
            "demand_before_expiry:1 units_expected_to_expire:4",
            """select *, round(round(rate, 6), 2) as daily_units, round(round(rate * days_left, 5), 1) as demand_before_expiry,
                      round(greatest(0, qty_remaining - greatest(0, rate * days_left - units_ahead_in_queue)), 6) as units_expected_to_expire
               from (select b.batch_id, b.store_id, b.sku_id, b.expiry_date, b.qty_remaining, b.expiry_date - e.as_of as days_left,
                            coalesce(c.trailing_7d_avg_units, 0) as rate,
                            coalesce(sum(b.qty_remaining) over (partition by b.store_id, b.sku_id order by b.expiry_date, b.batch_id
                                     rows between unbounded preceding and 1 preceding), 0) as units_ahead_in_queue
                     from batch b join (select max(date_day) as as_of from cells) e on b.expiry_date >= e.as_of
                     left join cells c on c.store_id = b.store_id and c.sku_id = b.sku_id and c.date_day = e.as_of
                     where b.qty_remaining > 0)
               order by units_expected_to_expire desc, expiry_date, batch_id limit 50""",
        ),
        "q03_cohort_retention_pivot": q(
            sc.cohort_pivot,
            "cohort_month:d cohort_size:i months_observed:i m1_pct:1 m2_pct:1 m3_pct:1 m4_pct:1 m5_pct:1 m6_pct:1",
            "select cohort_month, cohort_size, months_observed, "
            + ", ".join(
                f"round(round(100 * max(case when month_index = {m} then retention_rate end), 5), 1) as m{m}_pct" for m in range(1, 7)
            )
            + " from cohort_retention where month_index between 1 and 6 group by all",
        ),
        "q04_browse_bursts": q(
            sc.browse_bursts,
            "store_id:s sku_id:s burst_started:t burst_ended:t hours_in_burst:i events:i censored_events:i empty_shelf_throughout:b",
            """select store_id, sku_id, min(h) as burst_started, max(h) as burst_ended, count(*) as hours_in_burst, sum(e) as events,
                      sum(ce) as censored_events, bool_and(dry) as empty_shelf_throughout
               from (select *, h - to_hours(cast(row_number() over (partition by store_id, sku_id order by h) as int)) as island
                     from (select store_id, sku_id, hour_ts_ist as h, sum(event_count) as e, sum(censored_event_count) as ce,
                                  bool_and(not was_in_stock) as dry from clicks where event_type = 'pdp_view' group by all))
               group by store_id, sku_id, island having count(*) >= 3
               order by hours_in_burst desc, events desc, store_id, sku_id, burst_started limit 50""",
        ),
        "q05_stockout_runs": q(
            sc.stockout_runs,
            "store_id:s sku_id:s sku_name:s l1_category:s stockout_runs:i total_hours_out:i avg_hours_per_run:1 "
            "longest_run_hours:i worst_vs_typical:1",
            """select store_id, sku_id, sku_name, l1_category, count(*) as stockout_runs, sum(h) as total_hours_out,
                      round(round(avg(h), 5), 1) as avg_hours_per_run, max(h) as longest_run_hours,
                      round(round(max(h) / avg(h), 5), 1) as worst_vs_typical
               from (select store_id, sku_id, run, sum(hours_in_state) as h
                     from (select *, sum(opens) over (partition by store_id, sku_id order by hour_ts_ist) as run
                           from (select *, case when hour_ts_ist = lag(valid_to_hour_ts_ist) over (partition by store_id, sku_id order by hour_ts_ist)
                                           then 0 else 1 end as opens from shelf_hours where not is_in_stock))
                     group by all)
               join products using (sku_id) group by store_id, sku_id, sku_name, l1_category having sum(h) > 0
               order by longest_run_hours desc, total_hours_out desc, store_id, sku_id limit 50""",
        ),
        "q06_market_basket": q(
            lambda wh: sc.market_basket(wh, PAIR_THRESHOLD),
            "sku_a:s name_a:s sku_b:s name_b:s orders_with_both:i support_pct:3 lift:2 category_a:s category_b:s",
            f"""select a as sku_a, pa.sku_name as name_a, b as sku_b, pb.sku_name as name_b, n as orders_with_both,
                       round(round(100.0::double * n / orders, 7), 3) as support_pct,
                       round(round(cast(n as double) * orders / (sa.n_sku * sb.n_sku), 6), 2) as lift,
                       pa.l1_category as category_a, pb.l1_category as category_b
                from (select x.sku_id as a, y.sku_id as b, count(*) as n
                      from (select distinct order_id, sku_id from order_item where line_type = 'sale') x
                      join (select distinct order_id, sku_id from order_item where line_type = 'sale') y
                        on x.order_id = y.order_id and x.sku_id < y.sku_id group by all having count(*) >= {PAIR_THRESHOLD})
                join (select sku_id, count(distinct order_id) as n_sku from order_item where line_type = 'sale' group by 1) sa on sa.sku_id = a
                join (select sku_id, count(distinct order_id) as n_sku from order_item where line_type = 'sale' group by 1) sb on sb.sku_id = b
                join products pa on pa.sku_id = a join products pb on pb.sku_id = b
                join (select count(distinct order_id) as orders from order_item where line_type = 'sale') on true
                order by lift desc, orders_with_both desc, sku_a, sku_b limit 30""",
        ),
        "q07_abc_xyz": q(
            sc.abc_xyz_recheck,
            "sku_id:s sku_name:s l1_category:s revenue:2 cumulative_share_pct:2 abc_recomputed:s xyz_recomputed:s demand_cv:3 "
            "class_in_dimension:s disagrees_with_dimension:b",
            """select *, abc_recomputed || xyz_recomputed <> class_in_dimension as disagrees_with_dimension
               from (select sku_id, sku_name, l1_category, rev as revenue, round(round(100 * share, 6), 2) as cumulative_share_pct,
                            case when share <= 0.8 then 'A' when share <= 0.95 then 'B' else 'C' end as abc_recomputed,
                            case when cv < 0.5 then 'X' when cv < 1 then 'Y' else 'Z' end as xyz_recomputed,
                            round(round(cv, 7), 3) as demand_cv, abc_xyz_class as class_in_dimension
                     from (select *, sum(rev) over (order by rev desc, sku_id) / sum(rev) over () as share
                           from (select sku_id, round(sum(r), 2) as rev, stddev_samp(u) / nullif(avg(u), 0) as cv
                                 from (select sku_id, date_day, sum(units_sold) as u, sum(net_revenue) as r from cells group by all)
                                 group by sku_id having sum(r) > 0))
                     join products using (sku_id))
               order by revenue desc, sku_id limit 50""",
        ),
        "q08_month_over_month": q(
            sc.month_over_month,
            "l1_category:s month_start:d days_in_month:i festival_days:i revenue:0 revenue_per_day:0 mom_pct:1 mom_per_day_pct:1 "
            "calendar_flipped_the_sign:b",
            """select l1_category, m as month_start, days as days_in_month, festival_days, round(rev, 0) as revenue,
                      round(round(rev / days, 4), 0) as revenue_per_day, round(round(100 * (rev - p) / p, 5), 1) as mom_pct,
                      round(round(100 * (rev / days - pd) / pd, 5), 1) as mom_per_day_pct,
                      sign(rev - p) <> sign(rev / days - pd) as calendar_flipped_the_sign
               from (select *, lag(rev) over w as p, lag(rev / days) over w as pd
                     from (select l1_category, date_trunc('month', date_day) as m, round(sum(net_revenue), 2) as rev,
                                  count(distinct date_day) as days from cells group by all)
                     window w as (partition by l1_category order by m))
               join (select month_start_date as m, sum(is_festival::int) as festival_days from calendar group by 1) using (m)
               where p is not null""",
        ),
        "q09_availability_funnel": q(
            sc.availability_funnel,
            "l1_category:s pdp_views:i notify_me_events:i views_against_empty_shelf:i orders:i units_served:i "
            "units_demanded_imputed:0 browse_to_order_pct:1 demand_served_pct:1 browsed_an_empty_shelf_pct:1 avg_in_stock_pct:1",
            """select l1_category, sum(v) as pdp_views, sum(nm) as notify_me_events, sum(dry) as views_against_empty_shelf,
                      sum(order_count) as orders, sum(units_sold) as units_served, round(sum(units_demanded_imputed), 0) as units_demanded_imputed,
                      round(round(100 * sum(order_count) / sum(v), 5), 1) as browse_to_order_pct,
                      round(round(100 * sum(units_sold) / sum(units_demanded_imputed), 5), 1) as demand_served_pct,
                      round(round(100 * sum(dry) / sum(v), 5), 1) as browsed_an_empty_shelf_pct,
                      round(round(100 * avg(in_stock_pct), 5), 1) as avg_in_stock_pct
               from (select store_id, sku_id, date_day, sum(case when event_type = 'pdp_view' then event_count end) as v,
                            sum(case when event_type = 'notify_me' then event_count end) as nm,
                            sum(case when event_type = 'pdp_view' and not was_in_stock then event_count end) as dry from clicks group by all)
               join (select * exclude (l1_category) from cells) using (store_id, sku_id, date_day)
               join (select sku_id, l1_category from products) using (sku_id) group by l1_category""",
        ),
        "q10_top_n_per_store": q(
            sc.top_sellers,
            "store_name:s locality:s catchment_tier:s sku_id:s sku_name:s l1_category:s revenue:0 units:i rank_in_store:i "
            "estate_rank:i local_only:b",
            """select store_name, locality, catchment_tier, sku_id, sku_name, l1_category, round(rev, 0) as revenue, units, rank_in_store,
                      estate_rank, estate_rank > 20 as local_only
               from (select store_id, sku_id, round(sum(net_revenue), 2) as rev, sum(units_sold) as units,
                            row_number() over (partition by store_id order by round(sum(net_revenue), 2) desc, sku_id) as rank_in_store
                     from cells group by store_id, sku_id)
               join (select sku_id, row_number() over (order by round(sum(net_revenue), 2) desc, sku_id) as estate_rank from cells group by 1) using (sku_id)
               join products using (sku_id) join stores using (store_id) where rank_in_store <= 3""",
        ),
        "q11_current_price": q(
            sc.current_prices,
            "store_id:s sku_id:s sku_name:s effective_from_date:d base_price:2 realized_price:2 discount_pct:3 on_promotion:b "
            "is_open_at_window_end:b duplicate_order_lines:i",
            """select store_id, sku_id, sku_name, effective_from_date, s.base_price, s.realized_price,
                      round(round(s.discount_pct, 7), 3) as discount_pct, true as on_promotion, is_open_at_window_end,
                      (select count(*) from (select 1 from order_item group by order_id, sku_id, batch_id, line_type, source_feed
                                             having count(*) > 1)) as duplicate_order_lines
               from price_spans s join products using (sku_id)
               where (store_id, sku_id, interval_no) in (select (store_id, sku_id, max(interval_no)) from price_spans group by store_id, sku_id)
                 and promo_id is not null
               order by discount_pct desc, store_id, sku_id limit 50""",
        ),
        "q12_point_in_time_margin": q(
            sc.point_in_time_margin,
            "sku_id:s sku_name:s l1_category:s versions_used:i units:i revenue:0 margin_point_in_time:0 margin_current_cost:0 "
            "error_inr:0 error_pct:2",
            """select sku_id, sku_name, l1_category, versions_used, units, round(round(rev, 4), 0) as revenue, round(a, 0) as margin_point_in_time,
                      round(b, 0) as margin_current_cost, round(round(b - a, 4), 0) as error_inr, round(round(100 * (b - a) / a, 6), 2) as error_pct
               from (select i.sku_id, count(distinct version_no) as versions_used, sum(units) as units, sum(net_revenue) as rev,
                            round(sum(net_revenue - units * v.landed_cost), 2) as a, round(sum(net_revenue - units * p.landed_cost), 2) as b
                     from order_item i join product_versions v on v.sku_id = i.sku_id and i.date_day >= v.valid_from_date
                          and (v.valid_to_date is null or i.date_day < v.valid_to_date)
                     join products p on p.sku_id = i.sku_id where line_type = 'sale' group by i.sku_id having count(distinct version_no) > 1)
               join products using (sku_id) order by round(abs(b - a), 2) desc, sku_id limit 40""",
        ),
        "q13_expiry_markdown_decision": q(
            sc.expiry_decisions,
            "l1_category:s batches_at_risk:i value_at_risk_inr:0 units_at_risk:0 avg_days_to_expiry:1 avg_risk_score:3 marked_down:i "
            "held_price:i no_coefficient:i pct_of_at_risk_acted_on:1",
            None,
        ),
        "q14_promotion_lift_vs_fitted": q(
            sc.promotion_lift_vs_fitted,
            "l1_category:s dte_band:s discounted_days:i regular_days:i units_regular:2 units_discounted:2 naive_lift_pct:1 "
            "avg_price_ratio:3 fitted_elasticity:4 is_identified:b elasticity_basis:s observations:i",
            None,
        ),
        "q14_naive_promotion_lift": q(
            sc.naive_promotion_lift,
            "l1_category:s dte_band:s discounted_days:i regular_days:i units_regular:2 units_discounted:2 naive_lift_pct:1 avg_price_ratio:3",
            """select l1_category, dte_band, sum(cut::int) as discounted_days, sum((not cut)::int) as regular_days,
                      round(round(avg(case when not cut then units_sold end), 6), 2) as units_regular,
                      round(round(avg(case when cut then units_sold end), 6), 2) as units_discounted,
                      round(round(100 * (avg(case when cut then units_sold end) - avg(case when not cut then units_sold end))
                            / avg(case when not cut then units_sold end), 5), 1) as naive_lift_pct,
                      round(round(avg(case when cut then ratio end), 7), 3) as avg_price_ratio
               from (select l1_category, dte_band, units_sold, realized_price_avg / base_price_avg as ratio,
                            round(realized_price_avg, 6) < round(base_price_avg * 0.98, 6) as cut
                     from cells join dte_bands on min_dte_at_sale >= min_days and min_dte_at_sale < max_days
                     where units_sold > 0 and base_price_avg > 0)
               group by all having sum(cut::int) >= 30 and sum((not cut)::int) >= 30""",
        ),
        "q15_inventory_reconciliation": q(
            sc.inventory_reconciliation,
            "is_reconciled:b batches:i missing_from_ledger:i missing_from_movements:i ledger_identity_broken:i movement_identity_broken:i "
            "received_disagrees:i sold_disagrees:i total_abs_ledger_residual:i worst_received_gap:i worst_sold_gap:i",
            f"""select is_reconciled, count(*) as batches, sum(no_ledger::int) as missing_from_ledger, sum(no_moves::int) as missing_from_movements,
                       sum((lgap <> 0)::int) as ledger_identity_broken, sum((mgap <> 0)::int) as movement_identity_broken,
                       sum((lr <> mr)::int) as received_disagrees, sum((ls <> ms)::int) as sold_disagrees,
                       sum(abs(lgap)) as total_abs_ledger_residual, max(abs(lr - mr)) as worst_received_gap, max(abs(ls - ms)) as worst_sold_gap
                from ({ACCOUNTS}) group by is_reconciled""",
        ),
    }
