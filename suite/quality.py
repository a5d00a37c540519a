"""Registered queries: checks of the tables and feeds, named figures, the raw profile."""

from __future__ import annotations

from larder.quality import figures, gate, results, rules
from suite.contracts import contract_checks, contract_sql
from suite.ctes_feeds import FEEDS
from suite.ctes_jobs import JOBS
from suite.ctes_models import MODELS
from suite.models import TABLES, model_queries, over_library
from suite.spec import Query

CHECKS = "check_name:s table_name:s column_name:s failed_rows:i"
LINES = {
    "raw_items": "select distinct * exclude (dt) from pos_order_items",
    "raw_lines": """
select order_id, qty, unit_realized_price as price from raw_items
union all select r.order_id, -r.qty, i.unit_realized_price from pos_returns r join raw_items i
  on i.order_id = r.order_id and i.sku_id = r.sku_id and i.batch_id = r.batch_id and i.qty > 0""",
    "sold_items": "select i.*, o.store_id, cast(o.order_ts as date) as day from raw_items i join (select distinct * exclude (dt) from pos_orders) o using (order_id) where i.qty > 0",
    "batch_days": """
select b.*, coalesce(s.n, 0) as sold, b.qty_received - sum(coalesce(s.n, 0)) over (partition by b.batch_id order by b.day) as left_units
from (select *, cast(unnest(generate_series(received_date, expiry_date, interval 1 day)) as date) as day from wms_inventory_batch) b
left join (select batch_id, day, sum(qty) as n from sold_items group by all) s on s.batch_id = b.batch_id and s.day = b.day""",
}
LIBRARY = {**FEEDS, **MODELS, **JOBS, **LINES}

RULE_SQL = {
    "agg_revenue_ties_to_raw_order_totals": "select 1 from (select sum(qty) as a, sum(qty * price) as b from raw_lines), (select sum(units_sold) as c, sum(net_revenue) as d from cells) where a <> c or abs(b - d) > 0.01",
    "availability_intervals_cover_every_carried_day": "select store_id from shelf_hours group by store_id, sku_id, date_day having sum(hours_in_state) <> 24",
    "clickstream_counts_tie_to_the_raw_feed": "select 1 from (select sum(event_count) as a from clicks), (select count(*) as b from clickstream) where a <> b",
    "clickstream_demand_peaks_in_the_evening": "select 1 from stg_clicks having count(*) filter (event_hour_ist between 17 and 22) <= count(*) filter (event_hour_ist between 0 and 4)",
    "denormalised_store_and_day_match_the_order_header": "select 1 from order_item i join stg_orders o using (order_id) where i.store_id <> o.store_id or i.date_day <> o.order_date_ist",
    "every_batch_resolves_to_a_supplier": "select 1 from batch where supplier_id not in (select supplier_id from suppliers)",
    "late_arrivals_stay_within_the_lookback": "select 1 from stg_orders where arrival_lag_days not between 0 and 2",
    "no_source_partition_is_missing_undeclared": "select source_name from coverage where is_missing_partition group by 1 having count(*) > if(source_name = 'clickstream', 2, 0) union all select source_name from coverage where is_stale group by 1",
    "nothing_is_dropped_without_being_quarantined": "select 1 from (select count(*) as a from wms_inventory_movement), (select count(*) as b from stg_moves), (select count(*) as c from quarantine where source_name = 'wms_inventory_movement') where a <> b + c",
    "order_daily_denominators_are_consistent": "select 1 from order_daily where orders_count + unfulfilled_orders <> placed_orders",
    "order_daily_ties_to_the_sku_aggregate": "select 1 from (select sum(net_revenue) as a from order_daily), (select sum(net_revenue) as b from cells) where abs(a - b) > 0.01",
    "order_items_tie_to_the_raw_feed": "select 1 from (select count(*) as a from raw_lines), (select count(*) as b from order_item) where a <> b",
    "pack_size_is_physically_plausible": "select 1 from stg_products where pack_qty <= 0 or (uom in ('g', 'ml') and pack_qty < 1) or (uom in ('kg', 'l') and pack_qty > 100)",
    "price_intervals_expand_back_to_the_ledger": "select store_id, sku_id, d, realized_price from price_days except select store_id, sku_id, date_day, realized_price from price_by_day union all (select store_id, sku_id, date_day, realized_price from price_by_day except select store_id, sku_id, d, realized_price from price_days)",
    "product_history_covers_every_sale": "select 1 from (select distinct sku_id, date_day from order_item) s left join product_versions v on v.sku_id = s.sku_id and s.date_day >= v.valid_from_date and s.date_day < coalesce(v.valid_to_date, date '2999-12-31') group by s.sku_id, s.date_day having count(version_no) <> 1",
    "product_versions_are_contiguous": "select sku_id from product_versions group by 1 having sum(is_current::int) <> 1",
    "product_versions_expand_back_to_the_daily_catalogue": "select sku_id, snapshot_date, landed_cost from stg_products except select sku_id, cast(unnest(generate_series(valid_from_date, coalesce(valid_to_date, last_seen_date + 1) - 1, interval 1 day)) as date), landed_cost from product_versions",
    "returns_never_re_enter_the_stock_ledger": "select 1 from movement where event_type not in ('inbound', 'opening_balance', 'sale', 'expiry_writeoff')",
    "returns_reconcile_across_encodings": "select 1 from (select sum(qty * price) as a from raw_lines), (select sum(signed_qty * unit_realized_price) as b from stg_lines) where abs(a - b) > 0.01",
    "shelf_life_at_sale_is_possible": "select 1 from order_item join products using (sku_id) where dte_at_sale < 0 or dte_at_sale > shelf_life_days",
    "stacked_promotions_agree_on_price": "select 1 from stg_prices group by store_id, sku_id, effective_date having count(*) > 1 and count(distinct realized_price) > 1",
    "stacked_promotions_attribute_to_the_price_setter": """select 1 from price_spans s join promos p using (promo_id) join (
        select store_id, sku_id, interval_no, max(observed_depth_pct) as deepest
        from (select store_id, sku_id, interval_no, unnest(string_split(stacked_promo_ids, ',')) as promo_id from price_spans where is_promo_stacked) join promos using (promo_id)
        group by all) d on d.store_id = s.store_id and d.sku_id = s.sku_id and d.interval_no = s.interval_no where s.is_promo_stacked and d.deepest > p.observed_depth_pct""",
    "the_arrival_curve_is_a_probability_distribution": "select 1 from curve group by l1_category having count(*) <> 24 or abs(sum(arrival_share) - 1) > 1e-9",
    "the_availability_fact_accounts_for_every_stockout": "select 1 from stg_stockouts s join (select store_id, sku_id, min(date_day) as f, max(date_day) as l from shelf_hours group by all) h on h.store_id = s.store_id and h.sku_id = s.sku_id and s.stockout_date between h.f and h.l where not exists (select 1 from shelf_hours x where x.store_id = s.store_id and x.sku_id = s.sku_id and x.date_day = s.stockout_date and not x.is_in_stock)",
    "the_calendar_has_no_gaps": "select 1 from calendar having count(*) <> max(date_day) - min(date_day) + 1",
    "the_lookback_window_covers_every_late_arrival": "select order_date_ist from stg_orders group by 1 having max(arrival_lag_days) > 2",
    "the_promo_master_covers_every_promotion_run": "select distinct promo_id from stg_prices where promo_id not in (select promo_id from promos)",
    "the_stock_ledger_reconciles_to_the_pos": "select 1 from (select sum(units) as a from order_item where line_type = 'sale'), (select -sum(qty_delta) as b from stg_moves where event_type = 'sale'), (select sum(abs(qty_delta)) as c from wms_inventory_movement where batch_id is null and event_type = 'sale') where a - b <> c",
    "time_weighted_availability_differs_from_a_midnight_snapshot": """select 1 from (
        select sum(up)::double / nullif(sum(h), 0) as weighted, avg(m) as snapshot
        from (select sum(hours_in_state) as h, sum(if(is_in_stock, hours_in_state, 0)) as up, max((from_hour_ist = 0 and is_in_stock)::int) as m
              from shelf_hours group by store_id, sku_id, date_day)) where weighted is null or snapshot - weighted < 0.001""",
    "uncensoring_only_ever_adds_demand": "select 1 from cells where units_demanded_imputed < units_sold or (not is_censored and units_demanded_imputed <> units_sold)",
}
GATE_SQL = {
    "stock_never_negative": "select count(*) from (select batch_id from wms_inventory_movement where batch_id is not null group by 1 having sum(qty_delta) < 0) where batch_id in (select batch_id from (select batch_id, sum(qty) as sold from sold_items group by 1) join (select batch_id, -sum(qty_delta) as moved from wms_inventory_movement where event_type = 'sale' group by 1) using (batch_id) where sold = moved)",
    "shortfall_beyond_quarantine": "select greatest(coalesce(sum(greatest(-net, 0)), 0) - (select coalesce(sum(abs(qty_delta)), 0) from wms_inventory_movement where batch_id is null), 0) from (select sum(qty_delta) as net from wms_inventory_movement where batch_id is not null group by batch_id)",
    "incomplete_partitions": "select count(*) from (select count(distinct dt) as n from pos_order_items union all select count(distinct dt) from wms_inventory_movement union all select count(distinct dt) from catalog_snapshot) where n <> (select count(distinct dt) from pos_orders)",
    "expired_stock_sold": "select count(*) from pos_order_items where dte_at_sale < 0",
    "batch_of_another_store": "select count(*) from sold_items s join wms_inventory_batch b using (batch_id) where s.store_id <> b.store_id",
    "lines_without_an_order": "select count(*) from pos_order_items where order_id not in (select order_id from pos_orders)",
    "sold_batches_unknown": "select count(distinct batch_id) from pos_order_items where batch_id not in (select batch_id from wms_inventory_batch)",
    "batch_dates_incoherent": "select count(*) from wms_inventory_batch where expiry_date <= received_date or mfg_date > received_date or qty_received <= 0",
    "purchase_orders_incoherent": "select count(*) from wms_purchase_orders where received_date < ordered_date or received_qty > ordered_qty",
    "fefo_violations": "select coalesce(sum(d.sold), 0) from batch_days d join (select store_id, sku_id, day, min(expiry_date) as e from batch_days where left_units > 0 group by all) s on s.store_id = d.store_id and s.sku_id = d.sku_id and s.day = d.day where d.sold > 0 and d.expiry_date > s.e",
    "duplicate_lines": "select count(*) - count(distinct (order_id, sku_id, batch_id, qty, unit_realized_price)) from pos_order_items where qty > 0",
    "movements_without_a_batch": "select count(*) from wms_inventory_movement where batch_id is null",
    "returns_in_both_encodings": "select (select count(*) from pos_order_items where qty < 0) + (select count(*) from pos_returns)",
    "late_arrivals": "select count(*) from pos_orders where cast(order_ts as date) < dt",
    "clickstream_gap": "select (select count(distinct dt) from pos_orders) - (select count(distinct dt) from clickstream)",
    "unjoinable_skus": "select count(*) from clickstream where sku_id not in (select sku_id from catalog_snapshot)",
}
# Documented defects of the feeds: tolerated within a share of the documented figure.
DEVIATIONS = ("duplicate_lines", "movements_without_a_batch", "returns_in_both_encodings", "late_arrivals", "clickstream_gap", "unjoinable_skus")


def quality_queries() -> dict[str, Query]:
    def q(build, cols, sql=None):
        return over_library(LIBRARY, build, cols, sql)

    model_queries()  # fills TABLES
    rule_sql = " union all ".join(f"select '{n}' as check_name, count(*) as failed_rows from ({s})" for n, s in RULE_SQL.items())
    gate_sql = " union all ".join(f"select '{n}' as check_name, ({s}) as figure" for n, s in GATE_SQL.items())
    return {
        "x_singular_tests": q(lambda wh: rules.singular_tests(wh, list(RULE_SQL)), "check_name:s failed_rows:i", rule_sql),
        "x_singular_tests_rest": q(
            lambda wh: rules.singular_tests(wh, [n for n in rules.RULES if n not in RULE_SQL]), "check_name:s failed_rows:i"
        ),
        "y_generic_tests": q(lambda wh: contract_checks(wh, TABLES), CHECKS, contract_sql(TABLES)),
        "y_generic_tests_damaged": q(lambda wh: contract_checks(wh, TABLES, damage=True), CHECKS, contract_sql(TABLES, damage=True)),
        "g_raw_gate": q(
            lambda wh: gate.raw_gate(wh.feed), "check_name:s kind:s figure:i status:s",
            f"""select check_name, if(check_name in {DEVIATIONS}, 'deviation', 'invariant') as kind, figure, if(figure = 0, 'PASS', 'FAIL') as status
                from ({gate_sql})""",
        ),
        "g_raw_gate_figures": q(lambda wh: gate.raw_gate(wh.feed), "check_name:s figure:i", gate_sql),
        "dq_coverage_scan": q(
            lambda wh: results.coverage_scan(wh("dq_source_coverage")), "check_name:s value:i status:s",
            """select 'no_feed_is_stale' as check_name, count(distinct source_name) filter (is_stale) as value,
                      if(count(*) filter (is_stale) > 0, 'fail', 'pass') as status from coverage
               union all select 'no_partition_is_missing', sum(is_missing_partition::int),
                      case when sum(is_missing_partition::int) > 1000 then 'fail' when sum(is_missing_partition::int) > 0 then 'warn' else 'pass' end from coverage
               union all select 'coverage_is_measured', count(*), if(count(*) > 0, 'pass', 'fail') from coverage""",
        ),
        "dq_test_results": q(
            lambda wh: wh("dq_test_results"), "check_name:s check_type:s source_name:s test_severity:s failed_rows:i status:s date_day:d"
        ),
        "n51_anchors": q(lambda wh: figures.figures(wh, figures.ANCHORS), "name:s value:2 unit:s"),
        "n51_published": q(lambda wh: figures.figures(wh, figures.PUBLISHED), "name:s value:3 unit:s"),
        "n51_published_core": q(
            lambda wh: figures.figures(wh, [f for f in figures.PUBLISHED if f.table in ("fct_order", "agg_store_sku_day", "mart_expiry_risk")]),
            "name:s value:3",
            """select 'net_revenue' as name, sum(net_revenue) as value from cells union all select 'writeoff_value', sum(writeoff_value) from cells
               union all select 'gross_margin_pct', 100 * (sum(net_revenue) - sum(cogs)) / sum(net_revenue) from cells
               union all select 'at_risk_batches', count(*) from risk where risk_state = 'at_risk'
               union all select 'expired_batches', count(*) from risk where risk_state = 'expired'
               union all select 'expired_value', sum(value_at_risk_inr) from risk where risk_state = 'expired'
               union all select 'value_at_risk', sum(value_at_risk_inr) from risk where risk_state = 'at_risk'
               union all select 'unfulfilled_units', sum(unfulfilled_units) from order_fact
               union all select 'unfulfilled_share_pct', 100 * sum(unfulfilled_units) / sum(requested_units) from order_fact
               union all select 'short_filled_orders_pct', 100 * sum(is_short_filled::int) / count(*) from order_fact
               union all select 'orders_delivered', count(*) from order_fact where net_units > 0
               union all select 'orders_total_stockout', count(*) from order_fact where net_units = 0
               union all select 'aov_all_headers', sum(gmv) / count(*) from order_fact union all select 'batches_scored', count(*) from risk""",
        ),
        "n52_headline": q(
            lambda wh: figures.profile_headline(wh.feed),
            "revenue:2 cogs:2 units:i lines:i substituted:i wastage:2 wasted_units:i orders:i gross_margin:2 gm_pct:6 gm_awm_pct:6 wastage_pct_rev:6",
            """select *, revenue - cogs as gross_margin, (revenue - cogs) / revenue as gm_pct, (revenue - cogs - wastage) / revenue as gm_awm_pct,
                      wastage / revenue as wastage_pct_rev
               from (select sum(qty * unit_realized_price) as revenue, sum(qty * unit_cogs) as cogs, sum(qty) as units, count(*) as lines,
                            sum(if(is_substitution, qty, 0)) as substituted from raw_items where qty > 0),
                    (select -sum(qty_delta * unit_landed_cost) as wastage, -sum(qty_delta) as wasted_units
                     from wms_inventory_movement join wms_inventory_batch using (batch_id) where event_type = 'expiry_writeoff'),
                    (select count(*) as orders from (select distinct * exclude (dt) from pos_orders))""",
        ),
        "n52_daily": q(lambda wh: figures.profile_daily(wh.feed), "date_day:d sold:i", "select day as date_day, sum(qty) as sold from sold_items group by 1"),
        "n52_stockout_days": q(
            lambda wh: figures.profile_stockout_days(wh.feed), "date_day:d cells:i",
            "select event_date as date_day, count(*) as cells from wms_stockout_interval group by 1",
        ),
        "n52_waste_by_category": q(
            lambda wh: figures.profile_waste_by_category(wh.feed), "l1_category:s value:2",
            """select p.l1_category, -sum(m.qty_delta * b.unit_landed_cost) as value from wms_inventory_movement m
               join wms_inventory_batch b using (batch_id) join products p using (sku_id) where m.event_type = 'expiry_writeoff' group by 1""",
        ),
        "n52_supplier_freshness": q(
            lambda wh: figures.profile_supplier_freshness(wh.feed), "supplier_id:s batches:i days:4 cost:4",
            """select supplier_id, count(*) as batches, avg(usable_days) as days, avg(unit_landed_cost) as cost
               from wms_inventory_batch where supplier_id <> 'SUP-OPENING' group by 1""",
        ),
        "n52_promo_margin": q(
            lambda wh: figures.profile_promo_margin(wh.feed), "promotion:s units:i margin:2",
            """select case promo_id when 'PROMO-DEAL11' then 'Rs 11 deal rail' when 'PROMO-MD-30' then 'Markdown 30%' when 'PROMO-MD-50'
                      then 'Markdown 50%' else 'Full price' end as promotion, sum(qty) as units, sum(qty * (unit_realized_price - unit_cogs)) as margin
               from raw_items where qty > 0 group by 1""",
        ),
        "n52_velocity": q(
            lambda wh: figures.profile_velocity(wh.feed), "decile:i stockout_rate:6 volume_share:6",
            """select decile, avg(coalesce(n, 0)) / (select count(distinct day) * (select count(distinct store_id) from pos_orders) from sold_items) as stockout_rate, sum(u) / (select sum(qty) from raw_items where qty > 0) as volume_share
               from (select sku_id, sum(qty) as u, ntile(10) over (order by sum(qty), sku_id) as decile from raw_items where qty > 0 group by 1)
               left join (select sku_id, count(*) as n from wms_stockout_interval group by 1) using (sku_id) group by 1""",
        ),
        "n52_dte_mix": q(
            lambda wh: figures.profile_dte_mix(wh.feed, 24), "remaining:s units:i",
            """select case when dte_at_sale = 0 then 'expires today' when dte_at_sale = 1 then '1 day left' when dte_at_sale <= 3 then '2-3 days'
                      when dte_at_sale <= 7 then '4-7 days' else '8+ days' end as remaining, sum(qty) as units
               from raw_items join products using (sku_id) where qty > 0 and shelf_life_days <= 24 group by 1""",
        ),
        "n52_counts": q(
            lambda wh: figures.profile_counts(wh.feed), "name:s value:i",
            """select 'days' as name, count(distinct day) as value from sold_items union all select 'stores', count(distinct store_id) from pos_orders
               union all select 'skus', count(*) from products union all select 'batches', count(*) from wms_inventory_batch
               union all select 'movements', count(*) from wms_inventory_movement""",
        ),
    }
