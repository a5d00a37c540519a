"""Reading, writing, slicing and streaming on small folders."""

import os
import shutil
from datetime import date, datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder.plans import served
from larder.plans.warehouse import DAILY, Warehouse
from larder.sources import feeds, seeds, slices, tables
from larder.streaming import live
from larder.workspace import Workspace
from tests.conftest import SMALL

D = date(2025, 3, 1)


def order(oid, at, dt):
    return (oid, "S", "C", at, at, at, False, "upi", 1, dt)


def test_feed_round_trip_with_ragged_files(spark, tmp_path):
    rows = spark.createDataFrame([("B", "K", "S", "U", None, 5, 1.0, 9, D, D, D, D)], feeds.feed_schema("wms_inventory_batch"))
    feeds.append_feed(rows.drop("po_id"), str(tmp_path), "wms_inventory_batch")
    feeds.append_feed(rows.withColumns({"po_id": F.lit("PO"), "dt": F.lit(D + timedelta(1))}), str(tmp_path), "wms_inventory_batch")
    back = feeds.read_feed(spark, str(tmp_path), "wms_inventory_batch")
    assert {(r.dt, r.po_id) for r in back.collect()} == {(D, None), (D + timedelta(1), "PO")}
    merged = feeds.read_feed_merged(spark, str(tmp_path), "wms_inventory_batch")
    assert set(merged.columns) == set(back.columns)


def test_one_day_is_read_from_one_folder(spark, tmp_path):
    rows = [order(str(i), datetime(2025, 3, 1 + i), date(2025, 3, 1 + i)) for i in range(5)]
    feeds.append_feed(spark.createDataFrame(rows, feeds.feed_schema("pos_orders")), str(tmp_path), "pos_orders")
    one = feeds.read_feed(spark, str(tmp_path), "pos_orders").filter(F.col("dt") == date(2025, 3, 2))
    assert "PartitionFilters: [isnotnull(dt" in one._jdf.queryExecution().toString() and one.count() == 1


def test_a_heavy_day_is_written_by_several_tasks(spark, tmp_path):
    rows = spark.range(60_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.when(F.col("id") % 10 == 0, F.lit(D)).otherwise(F.lit(D + timedelta(1))).alias("date_day"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        tables.replace_days(rows, str(tmp_path / "t"))
        feeds.append_feed(rows.withColumnRenamed("date_day", "dt"), str(tmp_path), "f")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for folder, day in ((tmp_path / "t", "date_day"), (tmp_path / "f", "dt")):
        assert len(list((folder / f"{day}={D + timedelta(1)}").glob("*.parquet"))) > 3
    assert spark.read.parquet(str(tmp_path / "t")).count() == 60_000


def test_seeds_from_csv_equal_the_declared_rows(spark, tmp_path):
    path = str(tmp_path / "promotions")
    seeds.seed(spark, "promotions").coalesce(1).write.csv(path, header=True)
    assert sorted(seeds.read_seed_csv(spark, "promotions", path).collect(), key=str) == sorted(seeds.seed(spark, "promotions").collect(), key=str)


def test_only_rebuilt_days_are_replaced(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.replace_days(spark.createDataFrame([("a", 1, D), ("a", 1, D + timedelta(1))], "k string, v int, date_day date"), path)
    tables.replace_days(spark.createDataFrame([("a", 2, D + timedelta(1)), ("b", 3, D + timedelta(1))], "k string, v int, date_day date"), path)
    assert sorted((r.k, r.v, r.date_day) for r in spark.read.parquet(path).collect()) == [("a", 1, D), ("a", 2, D + timedelta(1)), ("b", 3, D + timedelta(1))]


def test_late_orders_move_earlier_days(warehouse, tmp_path):
    """As of a cutoff some orders had not arrived; the incremental rebuild brings their days up."""
    path, cutoff = str(tmp_path / "daily"), date(2025, 11, 30)
    asof = tables.incremental_store_sku_day(warehouse, path, cutoff=cutoff)
    before = {r.date_day: r.n for r in asof.filter("date_day >= date '2025-11-25'").groupBy("date_day").agg(F.sum("order_count").alias("n")).collect()}
    assert max(before) == cutoff
    full = warehouse("agg_store_sku_day")
    updated = tables.incremental_store_sku_day(warehouse, path)
    after = {r.date_day: r.n for r in updated.filter("date_day >= date '2025-11-25'").groupBy("date_day").agg(F.sum("order_count").alias("n")).collect()}
    assert after[cutoff] > before[cutoff] and after[cutoff - timedelta(1)] >= before[cutoff - timedelta(1)]
    assert after[date(2025, 11, 26)] == before[date(2025, 11, 26)]
    same = ["store_id", "sku_id", "date_day", "units_sold", "closing_units", "demand_imputation_method"]
    assert updated.select(*same).exceptAll(full.select(*same)).count() == 0 and updated.count() == full.count()


def test_a_rebuild_reads_the_folders_of_its_days_only(spark, warehouse):
    copies = {name: lambda wh, name=name: warehouse(name) for name in DAILY}
    start, same = date(2025, 11, 20), ["store_id", "sku_id", "date_day", "units_sold", "closing_units", "trailing_7d_avg_units", "browse_events"]
    with Warehouse(spark, warehouse.feed, Workspace(spark, "by day"), warehouse.params, copies, by_day=DAILY) as wh:
        for name in ("dim_promotion", "dim_product", "agg_intraday_arrival_curve"):
            wh.put(name, warehouse(name))
        rebuilt = wh.store_sku_day(rebuild_from=start)
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        plan = rebuilt._jdf.queryExecution().explainString(mode)
        filters = [line for line in plan.splitlines() if line.startswith("PartitionFilters") and "2025-11-13" in line]
        assert len(filters) == len(DAILY), plan
        assert all(wh(name).columns == warehouse(name).columns for name in DAILY)
        whole = warehouse.store_sku_day(rebuild_from=start).select(*same)
        assert rebuilt.select(*same).exceptAll(whole).count() == 0 and rebuilt.count() == whole.count() > 0
    with pytest.raises(ValueError):
        Warehouse(spark, warehouse.feed, Workspace(spark, "by day"), by_day=["dim_store"])


def test_slice_rules(spark, warehouse):
    picked = slices.pick_stores(warehouse("dim_store"), warehouse("fct_order"), 4).collect()
    assert [r.rank_in_tier for r in picked] == [1, 1, 1, 2] and len({r.catchment_tier for r in picked[:3]}) == 3
    stores = spark.createDataFrame([(picked[0].store_id,)], "store_id string")
    start, end = date(2025, 6, 1), date(2025, 6, 30)
    cut = slices.slice_tables(warehouse, stores, start, end, ["fct_order", "fct_price_history", "fct_inventory_batch"])
    bounds = cut["fct_order"].agg(F.min("date_day"), F.max("date_day"), F.countDistinct("store_id")).first()
    assert bounds[0] >= start and bounds[1] <= end and bounds[2] == 1
    assert cut["fct_price_history"].filter("effective_to_date <= date '2025-06-01' or effective_from_date > date '2025-06-30'").count() == 0
    assert cut["fct_inventory_batch"].filter("received_date < date '2025-06-01'").count() > 0


def test_served_lists_refuse_bad_requests(spark):
    df = spark.createDataFrame([(i, f"n{i}") for i in range(10)], "id int, name string")
    assert [r.id for r in served.browse(df, "id", descending=True, limit=3, offset=2).collect()] == [7, 6, 5]
    for bad in (lambda: served.browse(df, "id; drop"), lambda: served.browse(df, "id", limit=0), lambda: served.action_queue({}), lambda: served.action_queue({}, action_type="x")):
        with pytest.raises(ValueError):
            bad()


def test_action_queue_takes_what_is_built(spark):
    deals = spark.createDataFrame([("S", "K", 5.0, 2.0), ("S", "J", 9.0, 1.0)], "store_id string, sku_id string, slot_value double, expected_units double")
    got = served.action_queue({"rec_deal_slot": deals}).collect()
    assert [(r.action_type, r.value) for r in got] == [("deal_slot", 9.0), ("deal_slot", 5.0)]


def test_stream_drops_a_retry_that_lands_in_a_later_file(spark, tmp_path):
    root = str(tmp_path / "raw")
    at = datetime(2025, 3, 1, 10)
    first = spark.createDataFrame([order("a", at, D), order("b", at, D)], feeds.feed_schema("pos_orders"))
    feeds.append_feed(first, root, "pos_orders")
    out, log = str(tmp_path / "out"), str(tmp_path / "log")

    def advance():
        live.to_folder(live.deduplicated_orders(live.stream_feed(spark, root, "pos_orders")), out, log).awaitTermination()
        return sorted(r.order_id for r in spark.read.parquet(out).collect())

    assert advance() == ["a", "b"]
    feeds.append_feed(spark.createDataFrame([order("a", at, D + timedelta(1)), order("c", at, D + timedelta(1))], feeds.feed_schema("pos_orders")), root, "pos_orders")
    assert advance() == ["a", "b", "c"]


def test_stream_upsert_rewrites_the_touched_days_only(spark, tmp_path):
    root, path = str(tmp_path / "raw"), str(tmp_path / "days")
    seen = []

    def rebuild(days):
        seen.append(sorted(r.date_day for r in days.collect()))
        everything = feeds.read_feed(spark, root, "pos_orders").withColumn("date_day", F.col("order_ts").cast("date"))
        return everything.join(days, "date_day", "left_semi").groupBy("store_id", "date_day").agg(F.count("*").alias("n"))

    def advance(rows):
        feeds.append_feed(spark.createDataFrame(rows, feeds.feed_schema("pos_orders")), root, "pos_orders")
        live.upsert_days(live.stream_feed(spark, root, "pos_orders"), str(tmp_path / "log"), rebuild, lambda df: tables.replace_days(df, path)).awaitTermination()
        return {r.date_day: r.n for r in spark.read.parquet(path).collect()}

    day2 = datetime(2025, 3, 2, 9)
    assert advance([order("a", datetime(2025, 3, 1, 9), D), order("b", day2, date(2025, 3, 2))]) == {D: 1, date(2025, 3, 2): 1}
    assert advance([order("late", datetime(2025, 3, 1, 23), date(2025, 3, 3))]) == {D: 2, date(2025, 3, 2): 1}
    assert seen == [[D, date(2025, 3, 2)], [D]]


def test_lines_that_arrive_after_their_order_are_counted(spark, tmp_path):
    root, path = str(tmp_path / "raw"), str(tmp_path / "days")

    def line(oid, qty, dt):
        return (oid, "K", "B", qty, 5.0, 4.0, 1.0, 2.0, 3, None, False, dt)

    def advance(orders, items):
        for rows, name in ((orders, "pos_orders"), (items, "pos_order_items")):
            if rows:
                feeds.append_feed(spark.createDataFrame(rows, feeds.feed_schema(name)), root, name)
        both = live.lines_with_orders(*[live.stream_feed(spark, root, n) for n in ("pos_orders", "pos_order_items")])
        live.upsert_sold_days(both, str(tmp_path / "lines"), str(tmp_path / "log"), lambda df: tables.replace_days(df, path)).awaitTermination()
        return {(r.date_day, r.sku_id): (r.units_sold, r.net_revenue) for r in spark.read.parquet(path).collect()}

    day2, morning = date(2025, 3, 2), datetime(2025, 3, 1, 9)
    assert advance([order("a", morning, D), order("b", morning, D)], [line("a", 2, D)]) == {(D, "K"): (2, 8.0)}
    # The line of order b comes a day after it, that of order c a batch before it; a retried line and order count once.
    assert advance([], [line("b", 3, day2), line("a", 2, day2), line("c", 7, day2)]) == {(D, "K"): (5, 20.0)}
    assert advance([order("c", datetime(2025, 3, 2, 9), day2), order("a", morning, day2)], []) == {(D, "K"): (5, 20.0), (day2, "K"): (7, 28.0)}
    assert spark.conf.get(live.MERGE_SESSIONS, None) is None


def test_hourly_clicks_close_behind_the_watermark(spark, tmp_path):
    root = str(tmp_path / "raw")
    rows = [("S", "SKU_7", "pdp_view", True, datetime(2025, 3, 1, 10, m), D, D) for m in (1, 59)] + [("S", "SKU-00007", "pdp_view", True, datetime(2025, 3, 9), date(2025, 3, 9), date(2025, 3, 9))]
    feeds.append_feed(spark.createDataFrame(rows, feeds.feed_schema("clickstream")), root, "clickstream")
    live.to_folder(live.hourly_clicks(live.stream_feed(spark, root, "clickstream")), str(tmp_path / "o"), str(tmp_path / "l")).awaitTermination()
    assert [(r.sku_id, r.event_count) for r in spark.read.parquet(str(tmp_path / "o")).collect()] == [("SKU-00007", 2)]


def test_a_closed_warehouse_leaves_no_files(spark):
    from larder.plans.warehouse import Warehouse
    from larder.workspace import Workspace

    space = Workspace(spark, "closing")
    with Warehouse(spark, lambda name: spark.range(3), space) as wh:
        kept = wh.derive("numbers", lambda: spark.range(5))
        assert kept.count() == 5 and os.path.isdir(space.path("numbers"))
    assert not os.path.exists(space.root) and not wh.has("numbers")


def test_a_changed_folder_is_opened_anew(spark, tmp_path):
    from suite.tpch import open_tpch

    folder = f"{tmp_path}/given"
    shutil.copytree(SMALL, folder)
    first = open_tpch(spark, folder)
    before = first("dim_supplier").count()
    assert open_tpch(spark, folder) is first
    table = pd.read_parquet(f"{folder}/supplier.parquet")
    table.iloc[: len(table) // 2].to_parquet(f"{folder}/supplier.parquet")
    second = open_tpch(spark, folder)
    assert second is not first and second("dim_supplier").count() < before
