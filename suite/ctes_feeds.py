"""DuckDB text of the derived feeds, independent of the Spark code that builds them."""

FEEDS = {
    "skus": """
select sku_no, p_brand, p_type, round(min(p_retailprice) / 30, 2) + (sku_no * 7) % 60 as base0
from (select *, cast(substr(p_brand, 7) as int) * 10
       + (list_position(['STANDARD','ECONOMY','MEDIUM','PROMO','LARGE','SMALL'], p_type) - 1) as sku_no from part)
group by sku_no, p_brand, p_type""",
    "headers": """
select o_orderkey, o_custkey, n_regionkey as store_no,
       date_diff('day', date '1995-01-01', cast(o_orderdate as date)) % 365 as day_idx
from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "sold": """
select o_orderkey, o_custkey, store_no, sku_no, day_idx, day_idx // 15 as block, qty, is_returned, suppkey,
       base_price, landed_cost, promo_id,
       case promo_id when 'PROMO-MD-30' then round(base_price * 0.72, 2)
            when 'PROMO-MD-50' then round(base_price * 0.52, 2)
            when 'PROMO-DEAL11' then 11.0 else base_price end as realized_price
from (
  select *, case when rule = 0 and dw < 5 then 'PROMO-MD-30' when rule = 1 and dw < 3 then 'PROMO-MD-50'
       when rule = 2 and dw < 4 and day_idx between 182 and 321 then 'PROMO-DEAL11' when rule = 3 and dw < 2 then 'PROMO-MD-50'
       when rule = 4 and dw in (0, 1, 2, 4) then 'PROMO-MD-30' end as promo_id
  from (
    select h.*, l.sku_no, l.qty, l.is_returned, l.suppkey,
       cast(base0 + case when (day_idx // 45 + l.sku_no) % 3 = 0 then 1 else 0 end as double) as base_price,
       cast(round(base0 * 0.6, 2) + 0.5 * ((day_idx // 60 + l.sku_no) % 2) as double) as landed_cost,
       (l.sku_no * 31 + store_no * 17 + (day_idx // 7) * 13) % 20 as rule, day_idx % 7 as dw
    from (
      select l_orderkey, sku_no, cast(sum(l_quantity) as int) as qty, bool_or(l_returnflag = 'R') as is_returned,
             min(l_suppkey) as suppkey
      from lineitem join part on l_partkey = p_partkey join skus using (p_brand, p_type) group by all
    ) l join headers h on l_orderkey = o_orderkey join skus s on s.sku_no = l.sku_no
  )
)""",
    "receipts": """
select store_no, r.sku_no, block, sold_units, suppkey, block * 15 as day_idx, (r.sku_no * 3 + block) % 6 * 4 as leftover,
       16 + r.sku_no % 4 * 8 as shelf, block * 15 + 16 + r.sku_no % 4 * 8 as expiry_idx,
       cast(round(base0 * 0.6, 2) + 0.5 * (((block * 15) // 60 + r.sku_no) % 2) as double) as landed_cost
from (select store_no, sku_no, block, sum(qty) as sold_units, min(suppkey) as suppkey from sold group by all) r
join skus on skus.sku_no = r.sku_no""",
    "assortment_days": """
select store_no, sku_no, unnest(range(365)) as day_idx from (select distinct store_no, sku_no from sold)""",
    "pos_orders": """
select 'ORD-' || o_orderkey as order_id, 'STR-' || store_no as store_id, 'CUS-' || o_custkey as customer_id,
       order_ts, order_ts + interval 20 minute as promised_ts,
       order_ts + to_minutes(12 + (o_orderkey * 7) % 20) as delivered_ts, 12 + (o_orderkey * 7) % 20 > 20 as is_late,
       ['upi','card','cod','wallet'][o_orderkey % 4 + 1] as payment_mode,
       case when served is null then o_orderkey % 5 + 1
            else served + case when o_orderkey % 3 = 0 then 2 else 0 end end as n_units,
       date '2025-01-01' + cast(day_idx + o_orderkey % 3 + copy as int) as dt
from (
  select h.*, s.served, cast(date '2025-01-01' + cast(day_idx as int) as timestamp) + to_minutes(h.o_orderkey % 1440) as order_ts,
         unnest(case when h.o_orderkey % 40 = 0 then [0, 1] else [0] end) as copy
  from headers h left join (select o_orderkey, sum(qty) as served from sold group by 1) s on s.o_orderkey = h.o_orderkey
)""",
    "pos_order_items": """
select 'ORD-' || o_orderkey as order_id, 'SKU-' || lpad(cast(sku_no as varchar), 5, '0') as sku_id,
       'B-' || store_no || '-' || sku_no || '-' || block as batch_id, signed as qty, base_price as unit_base_price,
       realized_price as unit_realized_price, round(base_price - realized_price, 2) as discount_amt,
       landed_cost as unit_cogs, cast(16 + sku_no % 4 * 8 - day_idx % 15 as int) as dte_at_sale, promo_id,
       o_orderkey % 11 = 0 as is_substitution, date '2025-01-01' + cast(day_idx + o_orderkey % 3 + copy as int) as dt
from (
  select *, unnest(case when o_orderkey % 50 = 7 then [0, 1] else [0] end) as copy
  from (select *, unnest(case when is_returned and o_orderkey % 2 = 0
                  then [qty, -least(qty, cast(1 + o_orderkey % 3 as int))] else [qty] end) as signed from sold)
)""",
    "pos_returns": """
select 'ORD-' || o_orderkey as order_id,
       case when stray then 'SKU-99999' else 'SKU-' || lpad(cast(sku_no as varchar), 5, '0') end as sku_id,
       'B-' || store_no || '-' || sku_no || '-' || block as batch_id, least(qty, cast(1 + o_orderkey % 3 as int)) as qty,
       ['damaged','wrong_item','quality','late'][o_orderkey % 4 + 1] as reason,
       date '2025-01-01' + cast(day_idx + 2 as int) as return_date, date '2025-01-01' + cast(day_idx + 2 as int) as dt
from (select *, false as stray from sold where is_returned and o_orderkey % 2 = 1
      union all select *, true from sold where o_orderkey % 89 = 5)""",
    "wms_inventory_batch": """
select 'B-' || store_no || '-' || sku_no || '-' || block as batch_id,
       'SKU-' || lpad(cast(sku_no as varchar), 5, '0') as sku_id, 'STR-' || store_no as store_id,
       case when block = 0 then 'SUP-OPENING' else 'SUP-' || suppkey end as supplier_id,
       case when block > 0 then 'PO-B-' || store_no || '-' || sku_no || '-' || block end as po_id,
       cast(sold_units + leftover as bigint) as qty_received, landed_cost as unit_landed_cost, cast(shelf as int) as usable_days,
       date '2025-01-01' + cast(day_idx - 2 as int) as mfg_date, date '2025-01-01' + cast(day_idx as int) as received_date,
       date '2025-01-01' + cast(expiry_idx as int) as expiry_date, date '2025-01-01' + cast(day_idx as int) as dt
from receipts""",
    "wms_inventory_movement": """
select ((cast(at_idx as bigint) * 4 + kind) * 1099511627776 + k) * 512 + sku_no as movement_seq,
       case when keep then 'B-' || store_no || '-' || sku_no || '-' || block end as batch_id, event_type,
       cast(delta as bigint) as qty_delta, date '2025-01-01' + cast(at_idx as int) as event_date,
       date '2025-01-01' + cast(at_idx as int) as dt
from (
  select store_no, sku_no, block, day_idx as at_idx, 0 as kind, cast(store_no as bigint) * 1000 + block as k,
         case when block = 0 then 'opening_balance' else 'inbound' end as event_type, sold_units + leftover as delta, true as keep
  from receipts
  union all
  select store_no, sku_no, block, day_idx, 1, o_orderkey, 'sale', -qty, o_orderkey % 97 <> 0 from sold
  union all
  select store_no, sku_no, block, expiry_idx, 2, cast(store_no as bigint) * 1000 + block, 'expiry_writeoff', -leftover, true
  from receipts where leftover > 0 and sku_no % 2 = 0 and expiry_idx < 365
)""",
    "wms_purchase_orders": """
select 'PO-B-' || store_no || '-' || sku_no || '-' || block as po_id, 'STR-' || store_no as store_id,
       'SKU-' || lpad(cast(sku_no as varchar), 5, '0') as sku_id, 'SUP-' || suppkey as supplier_id,
       cast(sold_units + leftover + case when block % 4 = 0 then 3 else 0 end as bigint) as ordered_qty,
       cast(sold_units + leftover as bigint) as received_qty, 0.8 + (sku_no % 15) / 100 as inbound_freshness_pct,
       date '2025-01-01' + cast(day_idx - 3 - sku_no % 3 as int) as ordered_date,
       date '2025-01-01' + cast(day_idx - block % 2 as int) as expected_date,
       date '2025-01-01' + cast(day_idx as int) as received_date, block % 4 = 0 as is_short, block % 2 = 1 as is_late,
       date '2025-01-01' + cast(day_idx as int) as dt
from receipts where block > 0""",
    "wms_stockout_interval": """
select 'STR-' || store_no as store_id, 'SKU-' || lpad(cast(sku_no as varchar), 5, '0') as sku_id,
       date '2025-01-01' + cast(day_idx as int) as event_date,
       cast(case when r = 0 then (sku_no + day_idx) % 24 else 0 end as int) as hour_out,
       date '2025-01-01' + cast(day_idx as int) as dt
from (select *, (store_no * 13 + sku_no * 7 + day_idx * 3) % 23 as r from assortment_days)
where r = 0 or (r = 3 and sku_no % 2 = 0)""",
    "catalog_snapshot": """
select 'SKU-' || lpad(cast(sku_no as varchar), 5, '0') as sku_id, 'Item ' || sku_no as sku_name, p_brand as brand,
       sku_no // 10 = 1 as is_private_label, p_type as l1_category, p_type || '-' || ((sku_no // 10) % 5) as l2_subcategory,
       ['ambient','chilled','frozen'][sku_no % 3 + 1] as temp_zone, ['g','kg','ml','pc'][sku_no % 4 + 1] as uom,
       cast(case sku_no % 4 when 0 then case when day_idx >= 200 and sku_no % 8 = 0 then 0.5 else 500 end
            when 1 then 1 when 2 then 250 else 6 end as double) as pack_qty,
       cast(16 + sku_no % 4 * 8 as int) as shelf_life_days, base_price + 10 as mrp, base_price, landed_cost, 0.05 as gst_rate,
       sku_no % 3 = 0 as deal_eligible, date '2025-01-01' + cast(day_idx as int) as snapshot_date,
       date '2025-01-01' + cast(day_idx as int) as dt
from (select *, cast(base0 + case when (day_idx // 45 + sku_no) % 3 = 0 then 1 else 0 end as double) as base_price,
             cast(round(base0 * 0.6, 2) + 0.5 * ((day_idx // 60 + sku_no) % 2) as double) as landed_cost
      from (select *, unnest(range(365)) as day_idx from skus))""",
    "price_history": """
select 'STR-' || store_no as store_id, 'SKU-' || lpad(cast(sku_no as varchar), 5, '0') as sku_id,
       date '2025-01-01' + cast(day_idx as int) as effective_date, base_price,
       case p when 'PROMO-MD-30' then round(base_price * 0.72, 2) when 'PROMO-MD-50' then round(base_price * 0.52, 2)
            else 11.0 end as realized_price,
       unnest(case when rule = 3 then ['PROMO-MD-30', 'PROMO-MD-50'] else [p] end) as promo_id,
       date '2025-01-01' + cast(day_idx as int) as dt
from (
  select *, case when rule = 0 and dw < 5 then 'PROMO-MD-30' when rule = 1 and dw < 3 then 'PROMO-MD-50'
       when rule = 2 and dw < 4 and day_idx between 182 and 321 then 'PROMO-DEAL11' when rule = 3 and dw < 2 then 'PROMO-MD-50'
       when rule = 4 and dw in (0, 1, 2, 4) then 'PROMO-MD-30' end as p
  from (select a.*, (a.sku_no * 31 + store_no * 17 + (day_idx // 7) * 13) % 20 as rule, day_idx % 7 as dw,
               cast(base0 + case when (day_idx // 45 + a.sku_no) % 3 = 0 then 1 else 0 end as double) as base_price
        from assortment_days a join skus on skus.sku_no = a.sku_no)
) where p is not null""",
    "clickstream": """
select 'STR-' || ((user_id // 2) % 5) as store_id,
       case when event_id % 4 = 0 then 'SKU_' || ((user_id % 2 + 1) * 10 + event_id % 6)
            else 'SKU-' || lpad(cast((user_id % 2 + 1) * 10 + event_id % 6 as varchar), 5, '0') end as sku_id,
       case when event_type = 'error' then 'notify_me' else 'pdp_view' end as event_type,
       event_type <> 'error' and value >= 5 as was_in_stock, ts + interval 366 day as event_ts_utc,
       cast(ts + interval 366 day as date) as event_date, cast(ts + interval 366 day as date) as dt
from events""",
    "customer_snapshot": """
select 'CUS-' || c_custkey as customer_id, 'STR-' || n_regionkey as home_store_id, lower(c_mktsegment) as acquisition_channel,
       ['android','ios','web'][c_custkey % 3 + 1] as device, (c_custkey + quarter(q)) % 2 = 0 as is_member,
       date '2024-09-01' + cast(c_custkey * 37 % 420 as int) as signup_date,
       case when c_custkey % 10 = 3 then date '2024-09-01' + cast(c_custkey * 37 % 420 + 120 as int) end as churn_date, q as dt
from (select *, unnest([date '2025-01-01', date '2025-04-01', date '2025-07-01', date '2025-10-01']) as q from customer)
join nation on c_nationkey = n_nationkey""",
    "crm_deal_exposure": """
select 'CUS-' || c_custkey as customer_id, case when c_custkey % 5 = 0 then 'holdout' else 'exposed' end as deal_arm,
       date '2025-07-01' as assigned_date, 0.2 as holdout_share from customer""",
    "ref_stores": """
select 'STR-' || r_regionkey as store_id, 'Store ' || r_name as store_name,
       r_name as locality, cast(411001 + r_regionkey as varchar) as pincode,
       ['premium','mid','value'][r_regionkey % 3 + 1] as catchment_tier, 18.5 + r_regionkey * 0.02::double as lat,
       73.8 + r_regionkey * 0.03::double as lon, 1.0 + r_regionkey * 0.1::double as demand_index, 3.0 as serviceable_radius_km,
       4000 + r_regionkey * 500 as chilled_capacity_units, 9000 + r_regionkey * 100 as ambient_capacity_units,
       1500 as frozen_capacity_units, 24 as daily_operating_hours,
       map {'Dairy & Eggs': 1.0::double + r_regionkey * 0.05::double,
            'Fruits & Vegetables': 1.2::double - r_regionkey * 0.05::double} as category_affinity,
       date '2025-01-01' as opened_date, date '2025-01-01' as dt from region""",
    "ref_suppliers": """
select 'SUP-' || s_suppkey as supplier_id, s_name as supplier_name, 'all' as categories,
       cast(s_suppkey % 4 + 1 as double) as lead_time_mean_days, 0.5 as lead_time_sd_days,
       0.9 + (s_suppkey % 10) / 100 as otif_rate, 0.1 as monsoon_otif_penalty,
       [0.7::double + (s_suppkey % 20) / 100, 0.05::double] as inbound_freshness_pct, 1.0 as cost_index,
       case when s_suppkey % 7 = 0 then true end as private_label_only, date '2025-01-01' as dt from supplier""",
    "promotions": """
select * from (values ('PROMO-MD-30', 'markdown', 'platform', 0.30), ('PROMO-MD-50', 'markdown', 'platform', 0.50),
       ('PROMO-DEAL11', 'deal_11', 'brand', null)) t(promo_id, promo_type, funding_source, contracted_depth_pct)""",
    "dte_bands": """
select * from (values ('0-1d', 0, 1, 1), ('1-2d', 1, 2, 2), ('2-3d', 2, 3, 3), ('3-5d', 3, 5, 4), ('5-7d', 5, 7, 5),
       ('7d+', 7, 9999, 6)) t(dte_band, min_days, max_days, sort_order)""",
    "calendar_events": """
select event_name, event_type, start_date, start_date + duration - 1 as end_date from (values
       ('Ganesh Chaturthi', 'festival', date '2025-08-27', 11), ('Navratri', 'festival', date '2025-09-22', 9),
       ('Dussehra', 'festival', date '2025-10-02', 1), ('Diwali', 'festival', date '2025-10-20', 5),
       ('Christmas', 'festival', date '2025-12-25', 2), ('New Year', 'festival', date '2026-01-01', 2),
       ('Makar Sankranti', 'festival', date '2026-01-14', 2), ('Maha Shivaratri', 'festival', date '2026-02-15', 1),
       ('Holi', 'festival', date '2026-03-03', 2), ('Gudi Padwa', 'festival', date '2026-03-19', 1),
       ('Eid al-Fitr', 'festival', date '2026-03-20', 2), ('Ram Navami', 'festival', date '2026-03-26', 1),
       ('Akshaya Tritiya', 'festival', date '2026-04-19', 1), ('Independence Day', 'festival', date '2026-08-15', 1),
       ('Raksha Bandhan', 'festival', date '2026-08-28', 1), ('IPL 2026', 'sports_season', date '2026-03-20', 70)
       ) t(event_name, event_type, start_date, duration)""",
}
