"""Versions, intervals, availability, customers: hand-built histories with known answers."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from larder.functions.ranges import band_of, expand_days, in_force
from larder.operators import dimensions, facts, marts
from larder.params import Params
from larder.sources import seeds

D0 = date(2025, 1, 6)


def day(n):
    return D0 + timedelta(n)


def test_versions_break_on_change_and_close_on_the_next(spark):
    rows = [("K", day(i), 5.0 if i in (0, 1, 4) else 6.0, 10.0) for i in range(6)]
    history = spark.createDataFrame(rows, "sku_id string, snapshot_date date, landed_cost double, base_price double")
    got = [
        (r.version_no, r.valid_from_date, r.valid_to_date, r.days_effective, r.landed_cost_delta)
        for r in dimensions.dim_product_snapshot(history).orderBy("version_no").collect()
    ]
    assert got == [
        (1, day(0), day(2), 2, None), (2, day(2), day(4), 2, 1.0), (3, day(4), day(5), 1, -1.0), (4, day(5), None, 1, 1.0),
    ]


PRICES = "store_id string, sku_id string, effective_date date, base_price double, realized_price double, discount_pct double, promo_id string"
PROMOS = "promo_id string, observed_depth_pct double"


def spans(spark, rows):
    prices = spark.createDataFrame([("S", "K", day(d), 10.0, p, (10 - p) / 10, promo) for d, p, promo in rows], PRICES)
    promos = spark.createDataFrame([("P30", 0.3), ("P50", 0.5)], PROMOS)
    return prices, facts.fct_price_history(prices, promos).orderBy("interval_no").collect()


def test_a_gap_breaks_a_promotion(spark):
    _, got = spans(spark, [(0, 7.0, "P30"), (1, 7.0, "P30"), (2, 7.0, "P30"), (4, 7.0, "P30")])
    assert [(r.effective_from_date, r.effective_to_date, r.duration_days) for r in got] == [(day(0), day(3), 3), (day(4), day(5), 1)]
    assert [r.is_open_at_window_end for r in got] == [False, True]


def test_price_there_and_back_is_three_intervals(spark):
    _, got = spans(spark, [(0, 7.0, "P30"), (1, 5.0, "P50"), (2, 7.0, "P30")])
    assert [r.realized_price for r in got] == [7.0, 5.0, 7.0]


def test_stacked_promotions_go_to_the_deepest(spark):
    prices, got = spans(spark, [(0, 5.0, "P30"), (0, 5.0, "P50"), (1, 5.0, "P50")])
    assert [(r.promo_id, r.is_promo_stacked, r.stacked_promo_ids) for r in got] == [("P50", True, ["P30", "P50"])]
    frame = prices.sparkSession.createDataFrame(got)
    days = expand_days(frame, F.col("effective_from_date"), F.col("effective_to_date"), "d")
    assert {r.d for r in days.collect()} == {day(0), day(1)}


def test_point_in_time_join_is_half_open(spark):
    versions = spark.createDataFrame(
        [("K", 1, day(0), day(2)), ("K", 2, day(2), None)], "sku_id string, v int, a date, b date"
    )
    sales = spark.createDataFrame([("K", day(1)), ("K", day(2)), ("K", day(99))], "sku_id string, d date")
    got = {(r.d, r.v) for r in in_force(sales, versions, ["sku_id"], "d", "a", "b").collect()}
    assert got == {(day(1), 1), (day(2), 2), (day(99), 2)}


def test_bands_are_disjoint_and_half_open(spark):
    got = spark.range(0, 8).select(band_of(F.col("id"), seeds.DTE_BANDS).alias("b")).collect()
    assert [r.b for r in got] == ["0-1d", "1-2d", "2-3d", "3-5d", "3-5d", "5-7d", "5-7d", "7d+"]
    assert spark.range(1).select(band_of(F.lit(-1), seeds.DTE_BANDS).alias("b")).first().b is None


def test_calendar_takes_the_earliest_festival_of_a_day(spark):
    products = spark.createDataFrame([(date(2025, 10, 1),), (date(2025, 10, 3),)], "snapshot_date date")
    days = dimensions.dim_date(products, seeds.seed(spark, "calendar_events"), before=0, after=0).collect()
    second = next(r for r in days if r.date_day == date(2025, 10, 2))
    assert (second.festival_name, second.is_festival, second.is_salary_week) == ("Dussehra", True, True)
    first = next(r for r in days if r.date_day == date(2025, 10, 1))
    assert not first.is_festival and first.day_name == "Wednesday" and first.day_of_week == 3


def test_overlapping_festivals_are_counted(spark):
    events = spark.createDataFrame(
        [("Late", "festival", day(1), 3), ("Early", "festival", day(0), 3), ("Cup", "sports_season", day(2), 1)],
        seeds.SEED_SCHEMAS["calendar_events"],
    )
    products = spark.createDataFrame([(day(0),), (day(3),)], "snapshot_date date")
    got = {r.date_day: r for r in dimensions.dim_date(products, events, 0, 0).collect()}
    assert (got[day(2)].festival_name, got[day(2)].festivals_in_progress, got[day(2)].is_ipl_window) == ("Early", 2, True)
    assert (got[day(3)].festival_name, got[day(3)].is_ipl_window) == ("Late", False)


def availability(spark, hour):
    batches = spark.createDataFrame([("S", "K", day(0))], "store_id string, sku_id string, received_date date")
    moves = spark.createDataFrame([("S", "K", day(0), 5), ("S", "K", day(1), -2)], "store_id string, sku_id string, date_day date, qty_delta bigint")
    products = spark.createDataFrame([(day(2),)], "snapshot_date date")
    outs = spark.createDataFrame([("S", "K", day(1), hour)], "store_id string, sku_id string, stockout_date date, stockout_hour_ist int")
    rows = facts.fct_availability_hour(batches, moves, products, outs).orderBy("date_day", "from_hour_ist").collect()
    return [(r.date_day, r.from_hour_ist, r.to_hour_ist, r.is_in_stock, r.on_hand_units) for r in rows]


def test_a_stockout_splits_its_day(spark):
    assert availability(spark, 9) == [
        (day(0), 0, 24, True, 0), (day(1), 0, 9, True, 5), (day(1), 9, 24, False, 0), (day(2), 0, 24, True, 3),
    ]


def test_a_stockout_at_midnight_leaves_no_empty_interval(spark):
    assert [r for r in availability(spark, 0) if r[0] == day(1)] == [(day(1), 0, 24, False, 0)]


def test_customer_scores_and_segments(spark):
    people = spark.createDataFrame(
        [(f"c{i}", "S", date(2025, 1, 1), date(2025, 1, 1), "web", True) for i in range(6)],
        "customer_id string, home_store_id string, signup_date date, signup_cohort_month date, acquisition_channel string, is_member boolean",
    )
    orders = []
    for i in range(5):
        for n in range(i + 1):
            orders.append((f"c{i}", "S", f"o{i}{n}", date(2025, 6, 30) - timedelta(20 * (4 - i) + n), 10.0 * (i + 1), 1.0, 0.0, n == 0))
    facts_ = spark.createDataFrame(
        orders, "customer_id string, store_id string, order_id string, date_day date, gmv double, gross_margin double, discount_total double, has_promotion boolean"
    )
    got = {r.customer_id: r for r in marts.mart_customer_360(people, facts_, Params()).collect()}
    assert [got[f"c{i}"].r_score for i in range(5)] == [1, 2, 3, 4, 5]
    assert got["c4"].customer_segment == "champion" and got["c5"].customer_segment == "never_ordered"
    assert got["c5"].rfm_segment is None and got["c5"].ddi_band == "no_orders"
    assert got["c4"].ddi_band == "low" and got["c0"].ddi_band == "high"


def test_readout_presentation(spark):
    rows = [
        ("does_it_pay", "m1", 1234.5, None, None, "inr"), ("does_it_pay", "m2", -0.012, -0.02, -0.01, "rate"),
        ("elsewhere", "m3", None, -1.0, 1.0, "inr"), ("who_should_see_it", "m4", 2.0, 0.5, 3.0, "ratio"),
    ]
    df = spark.createDataFrame(rows, "page string, metric string, value double, ci_low double, ci_high double, unit string")
    got = {r.metric: (r.page_order, r.is_significant, r.display_value) for r in marts.mart_deal_readout(df).collect()}
    assert got["m1"][::2] == (1, "Rs 1,234") or got["m1"][::2] == (1, "Rs 1,235")
    assert got["m2"] == (1, True, "-1.20 pp") and got["m3"] == (9, False, "–") and got["m4"] == (2, True, "2.00x")
