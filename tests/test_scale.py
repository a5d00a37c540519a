"""Wide rows move once, and a total over days writes no single lines."""

from datetime import date, datetime

from pyspark.sql import functions as F

from larder.operators import facts, staging
from larder.plans.warehouse import Warehouse
from larder.sources.feeds import feed_schema
from larder.workspace import Workspace
from suite.tpch import TpchFeeds
from tests.conftest import SMALL

D, TS = date(2025, 3, 1), datetime(2025, 3, 1, 9, 0)


def _items(spark, rows):
    return staging.stg_pos__order_items(spark.createDataFrame(
        [(o, k, b, q, 10.0, price, 2.0, 5.0, 3, None, False, D) for o, k, b, q, price in rows], feed_schema("pos_order_items")
    ))


def _returns(spark, rows):
    return staging.stg_pos__returns(spark.createDataFrame([(o, k, b, q, why, D, D) for o, k, b, q, why in rows], feed_schema("pos_returns")))


def _orders(spark, ids):
    return staging.stg_pos__orders(spark.createDataFrame([(o, "S", "C", TS, TS, TS, False, "upi", 1, D) for o in ids], feed_schema("pos_orders")))


def test_returns_meet_every_line_of_their_key_and_no_other(spark):
    sold = [("a", "K", "B", 4, 8.0), ("a", "K", "B", 4, 7.0), ("a", "K", None, 1, 8.0), ("a", "L", "B", 2, 8.0), ("a", "K", "B", -1, 8.0),
            (None, "K", "B", 3, 8.0), ("b", "K", "B", 0, 8.0)]
    back = [("a", "K", "B", 1, "late"), ("a", "K", "B", 2, "quality"), ("a", "K", "B", 1, "late"), ("a", "K", None, 9, "late"),
            (None, "K", "B", 9, "late"), ("b", "K", "B", 9, "late"), ("z", "K", "B", 9, "late")]
    lines = staging.stg_pos__order_lines(_items(spark, sold), _returns(spark, back)).collect()
    want = [("pos_order_items", "sale" if q > 0 else "return", o, k, b, q, p, None) for o, k, b, q, p in sold if q]
    want += [("pos_returns", "return", o, k, b, -n, p, why) for o, k, b, q, p in sold if q > 0 and o and b
             for ro, rk, rb, n, why in back if (ro, rk, rb) == (o, k, b)]
    got = [(r.source_feed, r.line_type, r.order_id, r.sku_id, r.batch_id, r.signed_qty, r.unit_realized_price, r.return_reason) for r in lines]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_items_returns_and_orders_shuffle_once_each(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lines = staging.stg_pos__order_lines(_items(spark, [("a", "K", "B", 4, 8.0)]), _returns(spark, [("a", "K", "B", 1, "late")]))
        fact = facts.fct_order_item(lines, _orders(spark, ["a", "b"]))
        plan = fact.groupBy("store_id", "sku_id", "date_day").agg(F.countDistinct("order_id").alias("n"))
        text = plan._jdf.queryExecution().executedPlan().toString()
        rows = plan.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning(") == 4  # items, returns, orders, and the sums by cell
    assert [tuple(r) for r in rows] == [("S", "K", D, 1)]


def test_daily_totals_write_no_single_lines_or_movements(spark, tmp_path):
    workspace = Workspace(spark, str(tmp_path))
    with Warehouse(spark, TpchFeeds(spark, SMALL), workspace) as wh:
        cells = wh("agg_store_sku_day").agg(F.sum("units_sold"), F.sum("received_units")).first()
        wide = {"stg_pos__orders", "stg_pos__order_items", "stg_pos__order_lines", "fct_order_item", "fct_inventory_movement"}
        assert not any(wh.has(t) for t in wide)
        items = wh("fct_order_item").agg(F.sum("signed_qty")).first()[0]
        moved = wh("fct_inventory_movement").filter(F.col("event_type").isin(*facts.RECEIPT_EVENTS)).agg(F.sum("qty_delta")).first()[0]
        assert tuple(cells) == (items, moved)
        singles = facts.fct_inventory_batch(wh("stg_wms__inventory_batches"), wh("stg_wms__inventory_movements"))
        assert singles.exceptAll(wh("fct_inventory_batch").select(*singles.columns)).isEmpty()


def test_joined_streams_keep_their_state_on_disk(spark, tmp_path):
    from larder.sources import feeds, tables
    from larder.streaming import live

    root, path, log = (str(tmp_path / n) for n in ("raw", "days", "log"))
    feeds.append_feed(spark.createDataFrame([("a", "S", "C", TS, TS, TS, False, "upi", 1, D)], feed_schema("pos_orders")), root, "pos_orders")
    line = ("a", "K", "B", 2, 5.0, 4.0, 1.0, 2.0, 3, None, False, D)
    feeds.append_feed(spark.createDataFrame([line, line], feed_schema("pos_order_items")), root, "pos_order_items")
    both = live.lines_with_orders(*[live.stream_feed(spark, root, n) for n in ("pos_orders", "pos_order_items")])
    live.upsert_sold_days(both, str(tmp_path / "lines"), log, lambda df: tables.replace_days(df, path)).awaitTermination()
    assert [(r.units_sold, r.net_revenue) for r in spark.read.parquet(path).collect()] == [(2, 8.0)]
    state = [f.suffix for f in (tmp_path / "log" / "state").rglob("*") if f.is_file() and f.suffix]
    assert ".changelog" in state and ".delta" not in state  # deltas are those of a state held in memory
    assert all(spark.conf.get(k, None) != v for k, v in live.STATE_ON_DISK.items() if k.endswith("providerClass"))
