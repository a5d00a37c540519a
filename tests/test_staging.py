"""Every documented defect of the raw feeds, in frames small enough to read."""

import json
from datetime import date, datetime

from larder.operators import staging
from larder.sources.feeds import feed_schema

D = date(2025, 3, 1)
TS = datetime(2025, 3, 1, 10, 0)


def orders(spark, rows):
    return spark.createDataFrame(rows, feed_schema("pos_orders"))


def order(oid, dt, n=3):
    return (oid, "S", "C", TS, datetime(2025, 3, 1, 10, 20), datetime(2025, 3, 1, 10, 31, 30), True, "upi", n, dt)


def test_exact_copy_in_two_partitions_keeps_the_earlier(spark):
    rows = staging.stg_pos__orders(orders(spark, [order("a", date(2025, 3, 3)), order("a", D), order("b", D)])).collect()
    assert {(r.order_id, r.arrival_date, r.arrival_lag_days) for r in rows} == {("a", D, 0), ("b", D, 0)}
    assert rows[0].delivery_slack_minutes == 11


def test_a_changed_copy_is_another_row(spark):
    assert staging.stg_pos__orders(orders(spark, [order("a", D), order("a", D, n=4)])).count() == 2


def item(oid, qty, dt=D, sku="K", promo=None):
    return (oid, sku, "B", qty, 10.0, 8.0, 2.0, 5.0, 3, promo, False, dt)


def items(spark, rows):
    return staging.stg_pos__order_items(spark.createDataFrame(rows, feed_schema("pos_order_items")))


def returns(spark, rows):
    return staging.stg_pos__returns(spark.createDataFrame(rows, feed_schema("pos_returns")))


def test_both_return_encodings_become_negative_lines(spark):
    sold = items(spark, [item("a", 4), item("a", -1), item("b", 5, promo="P")])
    back = returns(spark, [("b", "K", "B", 2, "damaged", D, D), ("zz", "K", "B", 1, "late", D, D)])
    lines = staging.stg_pos__order_lines(sold, back).collect()
    got = {(r.order_id, r.line_type, r.source_feed, r.signed_qty, r.units) for r in lines}
    assert got == {
        ("a", "sale", "pos_order_items", 4, 4), ("a", "return", "pos_order_items", -1, 1),
        ("b", "sale", "pos_order_items", 5, 5), ("b", "return", "pos_returns", -2, 2),
    }
    priced = next(r for r in lines if r.source_feed == "pos_returns")
    assert (priced.unit_realized_price, priced.promo_id, priced.return_reason) == (8.0, "P", "damaged")


def test_quarantine_says_what_and_why(spark):
    moves = spark.createDataFrame([(1, None, "sale", -3, D, D), (2, "B", "sale", -1, D, D)], feed_schema("wms_inventory_movement"))
    held = staging.stg_quarantine(moves, returns(spark, [("zz", "K", None, 2, "late", D, D)]), items(spark, [item("a", 4)])).collect()
    assert {(r.reason_code, r.record_key, r.impact_units) for r in held} == {
        (staging.NO_BATCH, "1", 3.0), (staging.NO_SALE, "zz|K|", 2.0),
    }
    assert json.loads(next(r.payload for r in held if r.record_key == "1"))["event_type"] == "sale"


def test_unit_drift_is_repaired_and_sizes_compare(spark):
    def sku(uom, qty):
        return ("K", "n", "b", False, "c", "s", "z", uom, qty, 5, 20.0, 10.0, 6.0, 0.05, True, D, D)

    raw = spark.createDataFrame([sku("g", 0.5), sku("g", 500.0), sku("kg", 2.0), sku("L", 1.0)], feed_schema("catalog_snapshot"))
    got = {(r.uom, r.pack_qty, r.pack_qty_was_repaired, r.base_uom, r.pack_size_base_units) for r in staging.stg_catalog__products(raw).collect()}
    assert got == {
        ("g", 500.0, True, "g", 500.0), ("g", 500.0, False, "g", 500.0), ("kg", 2.0, False, "g", 2000.0), ("L", 1.0, False, "ml", 1000.0),
    }


def test_utc_evening_is_the_next_indian_day_and_ids_conform(spark):
    raw = spark.createDataFrame(
        [("S", "SKU_42", "pdp_view", False, datetime(2025, 3, 1, 20, 0), D, D), ("S", "SKU-00042", "pdp_view", True, datetime(2025, 3, 1, 1, 0), D, D)],
        feed_schema("clickstream"),
    )
    rows = sorted(staging.stg_web__clickstream(raw).collect(), key=lambda r: r.event_ts_utc)
    assert [(r.sku_id, r.event_date_ist, r.event_hour_ist, r.sku_id_was_conformed) for r in rows] == [
        ("SKU-00042", D, 6, False), ("SKU-00042", date(2025, 3, 2), 1, True),
    ]


def test_long_sku_numbers_are_not_cut(spark):
    raw = spark.createDataFrame([("S", "SKU_1234567", "pdp_view", True, TS, D, D)], feed_schema("clickstream"))
    assert staging.stg_web__clickstream(raw).first().sku_id == "SKU-1234567"


def test_movements_without_a_batch_are_left_out(spark):
    raw = spark.createDataFrame([(1, None, "sale", -3, D, D), (2, "B", "inbound", 5, D, D)], feed_schema("wms_inventory_movement"))
    assert [(r.movement_seq, r.units, r.direction) for r in staging.stg_wms__inventory_movements(raw).collect()] == [(2, 5, 1.0)]


def test_zero_ordered_quantity_has_no_fill_rate(spark):
    raw = spark.createDataFrame([("p", "S", "K", "U", 0, 0, 0.9, D, D, D, False, False, D)], feed_schema("wms_purchase_orders"))
    assert staging.stg_wms__purchase_orders(raw).first().fill_rate is None
