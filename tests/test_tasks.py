"""Wide shuffles come in more tasks as tables grow, and still only once."""

import re
from datetime import date, datetime

from pyspark.sql import functions as F

from larder.functions.ordered import task_count
from larder.operators import facts, staging
from larder.plans import warehouse
from larder.sources.feeds import feed_schema
from larder.workspace import Workspace
from suite import tpch
from tests.conftest import SMALL

D, TS = date(2025, 3, 1), datetime(2025, 3, 1, 9, 0)
MANY = 23  # more than the session's shuffle partitions


def _shuffles(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [int(n) for n in re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", plan)]


def test_tasks_follow_the_rows(spark):
    least = spark.sparkContext.defaultParallelism
    assert [task_count(spark.range(n), 10) for n in (0, 1, 10 * least, 10 * least + 1, 995)] == [least, least, least, least + 1, 100]


def test_items_returns_and_orders_meet_in_the_tasks_asked_for(spark):
    items = spark.createDataFrame(
        [(o, "K", "B", 4, 10.0, 8.0, 2.0, 5.0, 3, None, False, D) for o in ("a", "a", "b", None)], feed_schema("pos_order_items")
    )
    orders = spark.createDataFrame([(o, "S", "C", TS, TS, TS, False, "upi", 1, D) for o in ("a", "b")], feed_schema("pos_orders"))
    back = staging.stg_pos__returns(spark.createDataFrame([("a", "K", "B", 1, "late", D, D)], feed_schema("pos_returns")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        lines = staging.stg_pos__order_lines(staging.stg_pos__order_items(items, MANY), back, MANY)
        fact = facts.fct_order_item(lines, staging.stg_pos__orders(orders, MANY))
        shuffles = _shuffles(fact)
        rows = fact.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffles == [MANY] * 3
    assert sorted((r.order_id, r.signed_qty) for r in rows) == [("a", -1), ("a", 4), ("b", 4)]


def test_a_warehouse_and_its_feeds_ask_for_tasks_by_rows(spark, tmp_path, monkeypatch):
    for module in (warehouse, tpch):
        monkeypatch.setattr(module, "task_count", lambda df: MANY if df.count() else 1)
    lines = [(o, 0, 0, n, 2.0, 1.0, 0.0, 0.0, "R", "F", TS) for o in range(9) for n in range(2)]
    given = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
                            "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"),
        "part": ([(0, "p", "Brand#11", "SMALL", 1, 900.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": ([(o, 0, "O", 1.0, datetime(1995, 3, 1), "1") for o in range(9)],
                   "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"),
        "customer": ([(0, "c", 0, 1.0, "m")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "nation": ([(0, "n", 0)], "n_nationkey int, n_name string, n_regionkey int"),
    }
    folder = str(tmp_path / "given")
    for name, (rows, schema) in given.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    feeds = tpch.TpchFeeds(spark, folder)
    assert MANY in _shuffles(feeds("sold"))
    with warehouse.Warehouse(spark, feeds, Workspace(spark, str(tmp_path / "kept"))) as wh:
        assert wh.order_tasks() == MANY
        for name in warehouse.BY_ORDER:
            assert MANY in _shuffles(wh.unwritten(name))
        # Four units of an order; of odd orders two return at most three in the feed, of even ones in the items.
        sold = wh.unwritten("fct_order_item").filter("line_type = 'sale'").agg(F.sum("signed_qty"), F.countDistinct("order_id")).first()
    assert tuple(sold) == (36, 9)


def test_orders_need_no_items_to_be_there(spark, tmp_path):
    orders = spark.createDataFrame([("a", "S", "C", TS, TS, TS, False, "upi", 1, D)] * 2, feed_schema("pos_orders"))
    with warehouse.Warehouse(spark, {"pos_orders": orders}.__getitem__, Workspace(spark, str(tmp_path / "kept"))) as wh:
        assert wh("stg_pos__orders").count() == 1


def test_units_by_order_come_in_tasks_by_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tpch, "task_count", lambda df: MANY if df.count() else 1)
    feeds = tpch.TpchFeeds(spark, SMALL, keep=Workspace(spark, str(tmp_path)).write)
    feeds("sold")
    assert MANY in _shuffles(feeds._pos_orders())
    assert feeds("pos_orders").filter("n_units > 0").select("order_id").distinct().count() == feeds("headers").count()
