"""A check must be seen to fail: each is fed the row it exists to catch."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from larder.plans.warehouse import Warehouse
from larder.quality import contracts, figures, gate, results, rules
from larder.sources.feeds import feed_schema
from larder.workspace import Workspace
from suite.tpch import TpchFeeds
from tests.conftest import SMALL

D = date(2025, 3, 1)


def test_each_kind_of_contract_fails_on_its_own_row(spark):
    df = spark.createDataFrame(
        [("a", 1, "x", 0.5, 3, 2), ("a", 1, "y", 1.5, 1, 2), (None, 2, "x", 0.1, 5, 2)], "k string, n int, kind string, share double, hi int, lo int"
    )
    parents = spark.createDataFrame([("b",)], "k string")
    contract = contracts.Contract(
        unique=("k",), compound_unique=(("k", "n"),), references=(("k", "parent", "k"),), accepted={"kind": ("x",)}, between={"share": (0, 1)}, at_least=(("hi", "lo"),)
    )
    got = {(r.check_name, r.column_name): r.failed_rows for r in contracts.contract_results(df, "t", contract, lambda _: parents).collect()}
    assert got[("not_null", "k")] == 1 and got[("not_null", "n")] == 0
    assert got[("unique", "k")] == 1 and got[("compound_unique", "k,n")] == 1 and got[("relationships", "k")] == 2
    assert got[("accepted_values", "kind")] == 1 and got[("between", "share")] == 1 and got[("at_least", "hi,lo")] == 1


class Tables:
    """A warehouse of hand-built tables."""

    def __init__(self, tables, params=None):
        from larder.params import Params

        self.tables, self.params = tables, params or Params()

    def __call__(self, name):
        return self.tables[name]


def test_rules_catch_what_they_describe(spark, warehouse):
    items = warehouse("fct_order_item")
    cells = warehouse("agg_store_sku_day")

    def broken(**changed):
        class Patched:
            params = warehouse.params

            def __call__(self, name):
                return changed.get(name) if name in changed else warehouse(name)

            def feed(self, name):
                return changed.get(f"feed_{name}") if f"feed_{name}" in changed else warehouse.feed(name)

        return Patched()

    def fails(rule, **changed):
        return rules.RULES[rule](broken(**changed)).count() > 0

    first = F.col("sku_id") == "SKU-00010"
    assert fails("agg_revenue_ties_to_raw_order_totals", agg_store_sku_day=cells.withColumn("net_revenue", F.col("net_revenue") + 0.01))
    assert fails("availability_intervals_cover_every_carried_day", fct_availability_hour=warehouse("fct_availability_hour").filter("is_in_stock"))
    assert fails("clickstream_counts_tie_to_the_raw_feed", fct_clickstream=warehouse("fct_clickstream").filter("event_hour_ist <> 3"))
    assert fails("denormalised_store_and_day_match_the_order_header", fct_order_item=items.withColumn("store_id", F.lit("?")))
    assert fails("every_batch_resolves_to_a_supplier", dim_supplier=warehouse("dim_supplier").filter("not is_unknown_member"))
    late = warehouse("stg_pos__orders").withColumn("arrival_lag_days", F.lit(3))
    assert fails("late_arrivals_stay_within_the_lookback", stg_pos__orders=late)
    assert fails("the_lookback_window_covers_every_late_arrival", stg_pos__orders=late)
    assert fails("nothing_is_dropped_without_being_quarantined", stg_quarantine=warehouse("stg_quarantine").limit(0))
    assert fails("order_daily_denominators_are_consistent", mart_order_daily=warehouse("mart_order_daily").withColumn("placed_orders", F.lit(0)))
    assert fails("order_daily_ties_to_the_sku_aggregate", mart_order_daily=warehouse("mart_order_daily").withColumn("cogs", F.lit(0.0)))
    assert fails("order_items_tie_to_the_raw_feed", fct_order_item=items.filter("line_type = 'sale'"))
    assert fails("pack_size_is_physically_plausible", stg_catalog__products=warehouse.feed("catalog_snapshot"))
    spans = warehouse("fct_price_history")
    assert fails("price_intervals_expand_back_to_the_ledger", fct_price_history=spans.withColumn("effective_to_date", F.date_add("effective_to_date", 1)))
    versions = warehouse("dim_product_snapshot")
    assert fails("product_history_covers_every_sale", dim_product_snapshot=versions.filter(~first))
    assert fails("product_versions_are_contiguous", dim_product_snapshot=versions.filter("version_no <> 2"))
    assert fails("product_versions_expand_back_to_the_daily_catalogue", dim_product_snapshot=versions.withColumn("landed_cost", F.lit(1.0)))
    assert fails("returns_never_re_enter_the_stock_ledger", fct_inventory_movement=warehouse("fct_inventory_movement").withColumn("event_type", F.lit("return")))
    assert fails("returns_reconcile_across_encodings", stg_pos__returns=warehouse("stg_pos__returns").limit(0))
    assert fails("shelf_life_at_sale_is_possible", fct_order_item=items.withColumn("dte_at_sale", F.lit(-1)))
    ledger = warehouse("stg_catalog__price_history")
    assert fails("stacked_promotions_agree_on_price", stg_catalog__price_history=ledger.withColumn("realized_price", F.when(F.col("promo_id") == "PROMO-MD-30", 1.0).otherwise(2.0)))
    assert fails("stacked_promotions_attribute_to_the_price_setter", fct_price_history=spans.withColumn("promo_id", F.lit("PROMO-MD-30")))
    curve = warehouse("agg_intraday_arrival_curve")
    assert fails("the_arrival_curve_is_a_probability_distribution", agg_intraday_arrival_curve=curve.withColumn("arrival_share", F.col("arrival_share") * 1.001))
    assert fails("the_availability_fact_accounts_for_every_stockout", fct_availability_hour=warehouse("fct_availability_hour").filter("from_hour_ist <> 5"))
    assert fails("the_calendar_has_no_gaps", dim_date=warehouse("dim_date").filter("date_day <> date '2025-05-05'"))
    assert fails("the_promo_master_covers_every_promotion_run", dim_promotion=warehouse("dim_promotion").filter("promo_id <> 'PROMO-MD-50'"))
    assert fails("the_stock_ledger_reconciles_to_the_pos", stg_quarantine=warehouse("stg_quarantine").limit(0))
    assert fails("uncensoring_only_ever_adds_demand", agg_store_sku_day=cells.withColumn("units_demanded_imputed", F.col("units_demanded_imputed") - 1))
    assert fails("no_source_partition_is_missing_undeclared", dq_source_coverage=warehouse("dq_source_coverage").withColumn("is_missing_partition", F.lit(True)))


def test_the_derived_warehouse_breaks_only_what_it_should(warehouse):
    failed = {r.check_name for r in rules.singular_tests(warehouse, [n for n in rules.RULES if n != "readout_rows_are_measured_or_explained"]).collect() if r.failed_rows}
    # The derived click feed covers one month of the year.
    assert failed <= {"no_source_partition_is_missing_undeclared", "clickstream_demand_peaks_in_the_evening"}


def test_coverage_scan_turns_red(spark):
    row = ("f", D, D, True, True)
    schema = "source_name string, date_day date, last_seen_date date, is_missing_partition boolean, is_stale boolean"
    got = {r.check_name: r.status for r in results.coverage_scan(spark.createDataFrame([row], schema)).collect()}
    assert got == {"no_feed_is_stale": "fail", "no_partition_is_missing": "warn", "coverage_is_measured": "pass"}
    empty = {r.check_name: r.status for r in results.coverage_scan(spark.createDataFrame([], schema)).collect()}
    assert empty["coverage_is_measured"] == "fail"


def test_gate_explains_documented_defects(warehouse):
    found = {r.check_name: r for r in gate.raw_gate(warehouse.feed).collect()}
    assert found["lines_without_an_order"].status == "PASS" and found["duplicate_lines"].status == "FAIL"
    known = {n: found[n].figure for n in ("duplicate_lines", "late_arrivals", "unjoinable_skus")}
    again = {r.check_name: r.status for r in gate.raw_gate(warehouse.feed, known).collect()}
    assert {again[n] for n in known} == {"EXPLAINED"}
    off = {r.check_name: r.status for r in gate.raw_gate(warehouse.feed, {"duplicate_lines": known["duplicate_lines"] * 2}).collect()}
    assert off["duplicate_lines"] == "FAIL"


def test_fefo_replay_counts_units_out_of_order(spark):
    batches = spark.createDataFrame(
        [("old", "K", "S", "U", None, 5, 1.0, 9, D, D, date(2025, 3, 5), D), ("new", "K", "S", "U", None, 5, 1.0, 9, D, D, date(2025, 3, 9), D)],
        feed_schema("wms_inventory_batch"),
    )
    from datetime import datetime

    at = datetime(2025, 3, 1, 9)
    orders = spark.createDataFrame([(o, "S", "C", at, at, at, False, "upi", 5, D) for o in ("o1", "o2")], feed_schema("pos_orders"))

    def sold(*rows):
        items = spark.createDataFrame([(o, "K", b, q, 9.0, 9.0, 0.0, 1.0, 4, None, False, D) for o, b, q in rows], feed_schema("pos_order_items"))
        tables = {"wms_inventory_batch": batches, "pos_orders": orders, "pos_order_items": items}
        return gate.fefo_violations(lambda n: tables[n]).first().figure

    assert sold(("o1", "old", 5), ("o2", "new", 2)) == 0
    assert sold(("o1", "old", 1), ("o2", "new", 2)) == 2


def test_a_single_figure_of_the_lines_does_not_write_them(spark, tmp_path):
    with Warehouse(spark, TpchFeeds(spark, SMALL), Workspace(spark, str(tmp_path))) as wh:
        lines = [f for f in figures.ANCHORS if f.name == "order_items"]
        got = figures.figures(wh, lines).first()
        assert not wh.has("fct_order_item")
        assert got.value == wh("fct_order_item").count() > 0


def test_pinned_figures(spark):
    measured = spark.createDataFrame([("a", 10.0, "count"), ("m", 1.004, "money"), ("x", None, "count"), ("new", 1.0, "count")], "name string, value double, unit string")
    got = {r.name: r.status for r in figures.compare(measured, {"a": 11, "m": 1.0, "x": 3}).collect()}
    assert got == {"a": "moved", "m": "ok", "x": "missing", "new": "unpinned"}


def test_metrics_refuse_what_they_cannot_answer(warehouse):
    from larder.plans.metrics import METRICS, MetricError, metric, notes_for, validate_registry

    assert validate_registry() == []
    for bad in (
        lambda: metric(warehouse, "nothing"), lambda: metric(warehouse, "net_revenue", ["nowhere"]), lambda: metric(warehouse, "net_revenue", ["supplier"]),
        lambda: metric(warehouse, "net_revenue", limit=0), lambda: metric(warehouse, "net_revenue", filters=[("store", "like", "x")]),
        lambda: metric(warehouse, "net_revenue", filters=[("store", "in", [])]), lambda: metric(warehouse, "margin_recovery_rate"),
    ):
        with pytest.raises(MetricError):
            bad()
    assert notes_for(METRICS["net_revenue"], ["sku"]) and not notes_for(METRICS["net_revenue"], ["store"])
    assert notes_for(METRICS["basket_size_uplift"], []) == ["basket_size_uplift needs a holdout to be an effect"]


@pytest.mark.filterwarnings("ignore")
def test_metric_bounds_hold_on_the_derived_warehouse(warehouse):
    from larder.plans.metrics import out_of_bounds

    for name in ("gross_margin_pct", "fill_rate", "in_stock_pct_hours", "retention_90d", "private_label_gmv_share"):
        assert out_of_bounds(warehouse, name).count() == 0


def test_damaged_copies_break_every_rule(warehouse):
    from larder.quality.contracts import CONTRACTS
    from suite.contracts import contract_checks, shapes
    from suite.models import TABLES, model_queries

    model_queries()
    known = shapes(TABLES)
    assert len(known) >= len(CONTRACTS) - 1
    some = {t: TABLES[t] for t in ("fct_order", "fct_inventory_batch", "dim_store")}
    found = contract_checks(warehouse, some, damage=True).filter("table_name in ('fct_order', 'fct_inventory_batch', 'dim_store')").toPandas()
    hit = set(found[found["failed_rows"] > 0]["check_name"])
    assert hit == {"not_null", "unique", "relationships", "between", "at_least"}
    whole = contract_checks(warehouse, some).filter("table_name = 'fct_order'").toPandas()
    assert (whole["failed_rows"] == 0).all()
