"""What a query leaves on disk, and in how many files, follows what it needs."""

import time
from datetime import date, datetime, timedelta
from pathlib import Path

from pyspark.sql import functions as F

from larder.operators import marts
from larder.plans.warehouse import Warehouse
from larder.quality import rules
from larder.sources import feeds, slices, tables
from larder.sources.feeds import feed_schema
from larder.streaming import live
from larder.workspace import FREE_SHUFFLES, Workspace, cut_lineage, in_turn
from suite.tpch import TpchFeeds
from tests.conftest import SMALL

D, TS = date(2025, 3, 1), datetime(2025, 3, 1, 9, 0)


def test_sold_days_come_in_a_file_a_day_and_no_line_is_kept_as_state(spark, tmp_path):
    root, path, facts, log = (str(tmp_path / n) for n in ("raw", "days", "lines", "log"))
    orders = [(f"o{n}", "S", "C", TS + timedelta(n % 3), TS, TS, False, "upi", 1, D + timedelta(n % 3)) for n in range(60)]
    # Lines two days before their order and four days after it count, those beyond do not; nor does one without an order.
    lags = [-3, -2, 0, 4, 5]
    items = [(f"o{n}", f"K{n}", "B", 2, 5.0, 4.0, 1.0, 2.0, 3, None, False, D + timedelta(n % 3 + lags[n % 5])) for n in range(60)]
    items += [(None, "K", "B", 2, 5.0, 4.0, 1.0, 2.0, 3, None, False, D)]
    for rows, name in ((orders, "pos_orders"), (items, "pos_order_items")):
        feeds.append_feed(spark.createDataFrame(rows, feed_schema(name)), root, name)
    both = live.lines_with_orders(*[live.stream_feed(spark, root, n) for n in ("pos_orders", "pos_order_items")])
    live.upsert_sold_days(both, facts, log, lambda df: tables.replace_days(df, path)).awaitTermination()
    got = {r.sku_id: (r.date_day, r.units_sold, r.net_revenue) for r in spark.read.parquet(path).collect()}
    # Orders come at nine in the morning and lines at midnight, so a line two days before is 57 hours early.
    assert got == {f"K{n}": (D + timedelta(n % 3), 2, 8.0) for n in range(60) if lags[n % 5] in (0, 4)}
    assert all(len([*day.glob("*.parquet")]) == 1 for day in (tmp_path / "days").glob("date_day=*"))
    assert not [*(tmp_path / "log" / "state").rglob("*keyWithIndex*")]  # what a join of streams keeps


def test_a_batch_that_runs_again_adds_its_lines_once(spark, tmp_path):
    facts = str(tmp_path)
    rows = [(0, "line", "a", None, "K", 2, 4.0, TS, D), (1, "order", "a", "S", None, None, None, TS, D), (1, "line", "a", None, "L", 1, 4.0, TS, D),
            (2, "line", "a", None, "M", 1, 4.0, TS, D)]
    shape = "batch long, kind string, order_id string, store_id string, sku_id string, qty int, unit_realized_price double, at timestamp, day date"
    spark.createDataFrame(rows, shape).write.partitionBy("batch", "day").parquet(f"{facts}/arrived")
    known = spark.read.schema(shape).parquet(f"{facts}/arrived")

    def added(number):
        return sorted(r.sku_id for r in live.sold_lines(known.filter(f"batch <= {number}"), number).collect())

    assert [added(n) for n in (0, 1, 2, 1)] == [[], ["K", "L"], ["M"], ["K", "L"]]


def _kept(wh):
    return {n for n in ("fct_order_item", "fct_order", "stg_pos__orders") if wh.has(n)}


def test_customers_and_store_picks_write_no_lines_and_no_orders(spark, tmp_path):
    from suite import sources

    with Warehouse(spark, TpchFeeds(spark, SMALL), Workspace(spark, str(tmp_path / "a"))) as wh:
        picked = slices.pick_stores(wh("dim_store"), wh.unwritten("fct_order"), 4)
        # The join with the lines does not change how many orders there are, so no line is read for it.
        assert "signed_qty" not in picked._jdf.queryExecution().optimizedPlan().toString()
        few = [tuple(r) for r in picked.collect()]
        people = wh("mart_customer_360")
        assert _kept(wh) == set()
        orders = wh("fct_order")
        assert few == [tuple(r) for r in slices.pick_stores(wh("dim_store"), orders, 4).collect()]
        from_written = marts.mart_customer_360(wh("dim_customer"), orders, wh.params)
        # Sums of money may differ in their last bits.
        a, b = [df.select(*[F.round(c, 4) if t == "double" else c for c, t in people.dtypes]) for df in (people, from_written)]
        assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
        assert not wh.has("fct_order_item")
        days = sources.streamed_upsert(wh)
        assert not wh.has("fct_order_item")
        assert days.agg(F.sum("units_sold")).first()[0] == wh("fct_order_item").agg(F.sum("signed_qty")).first()[0]


def test_values_that_follow_from_the_row_are_computed_on_reading(spark, tmp_path):
    workspace = Workspace(spark, str(tmp_path))
    with Warehouse(spark, TpchFeeds(spark, SMALL), workspace) as wh:
        for name, follows in (("stg_pos__orders", {"row_hash"}), ("stg_pos__order_items", {"row_hash"}), ("fct_order_item", {"order_item_key", "net_revenue", "cogs"})):
            plan, kept = wh.unwritten(name), wh(name)
            assert plan.columns == kept.columns
            assert not follows & set(spark.read.parquet(workspace.path(name)).columns)
            assert kept.exceptAll(plan).isEmpty() and plan.exceptAll(kept).isEmpty()


def test_a_written_table_and_a_cut_leave_no_shuffle_files(spark, tmp_path):
    def shuffled():
        time.sleep(1)  # files are removed in the background
        roots = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f.name for root in roots for f in Path(root).rglob("shuffle_*.data")}

    before = shuffled()
    rows = spark.range(20_000).groupBy((F.col("id") % 999).alias("k")).count()
    written = Workspace(spark, str(tmp_path)).write(rows, "counts")
    cut = cut_lineage(spark.range(20_000).repartition(5, "id"))
    assert not shuffled() - before
    assert (written.count(), cut.count()) == (999, 20_000)
    assert spark.conf.get(FREE_SHUFFLES) == "false"


def test_results_in_turn_are_all_there(spark):
    parts = [spark.range(n, n + 2) for n in range(0, 14, 2)]
    assert sorted(r.id for r in in_turn(parts, 3).collect()) == [*range(14)]
    assert "Union" not in in_turn(parts[:3], 3)._jdf.queryExecution().optimizedPlan().toString()


def test_checks_work_the_raw_lines_out_once(spark, tmp_path, monkeypatch):
    calls = []
    monkeypatch.setattr(rules, "_raw_lines", lambda wh, given=rules._raw_lines: (calls.append(1), given(wh))[1])
    with Warehouse(spark, TpchFeeds(spark, SMALL), Workspace(spark, str(tmp_path))) as wh:
        names = ["agg_revenue_ties_to_raw_order_totals", "order_items_tie_to_the_raw_feed", "returns_reconcile_across_encodings"]
        assert {(r.check_name, r.failed_rows) for r in rules.singular_tests(wh, names).collect()} == {(n, 0) for n in names}
        assert len(calls) == 1 and all(wh.has(t) for t in rules.LINE_TABLES)
