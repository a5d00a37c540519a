"""Marts: store days, customers, cohorts, feed coverage, readout presentation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import month_start, months_between_starts, positive_ratio, row_hash, sum_where
from larder.functions.ordered import quantile_score, quantile_starts
from larder.params import Params

WINDOW_DAYS = 90


def mart_order_daily(orders: DataFrame) -> DataFrame:
    served = F.col("line_count") > 0

    def how_many(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    totals = [
        "discount_total", "cogs", "gross_margin", "net_units", "gross_units", "returned_units", "requested_units",
        "unfulfilled_units",
    ]
    return (
        orders.groupBy("store_id", "date_day")
        .agg(
            how_many(served).alias("orders_count"),
            F.count("*").alias("placed_orders"),
            how_many(~served).alias("unfulfilled_orders"),
            F.countDistinct("customer_id").alias("customers_count"),
            F.sum("gmv").alias("net_revenue"),
            *[F.sum(c).alias(c) for c in totals],
            F.sum("distinct_skus").alias("basket_skus"),
            how_many(F.col("is_late")).alias("late_orders"),
            how_many(F.col("is_short_filled")).alias("short_filled_orders"),
            how_many(F.col("has_promotion")).alias("promoted_orders"),
            how_many(F.col("has_return")).alias("orders_with_return"),
        )
        .withColumn("store_day_key", row_hash(["store_id", "date_day"]))
    )


def _order_bounds(orders: DataFrame) -> DataFrame:
    return orders.agg(
        F.max("date_day").alias("as_of"),
        month_start(F.min("date_day")).alias("first_month"),
        month_start(F.max("date_day")).alias("last_month"),
    )


def mart_customer_360(
    customers: DataFrame, orders: DataFrame, params: Params, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df
) -> DataFrame:
    """Recency, frequency, value, promotion dependency and segment of every customer.

    ``keep`` may write what is read more than once, so that the orders need not be: their bounds, and a row of each customer.
    """
    bounds = keep(_order_bounds(orders), "int_order_bounds")
    as_of, first_month, last_month = [bounds.select(c).scalar() for c in ("as_of", "first_month", "last_month")]
    age = F.datediff("as_of_date", "date_day")
    now, then = age < WINDOW_DAYS, (age >= WINDOW_DAYS) & (age < 2 * WINDOW_DAYS)
    next_month = F.add_months(month_start(F.col("signup_date")), 1)
    people = customers.select(
        "customer_id", F.col("home_store_id").alias("store_id"), "signup_date",
        F.col("signup_cohort_month").alias("cohort_month"), "acquisition_channel", "is_member",
    )
    history = (
        orders.select("customer_id", "date_day", "gmv", "gross_margin", "discount_total", "has_promotion")
        .withColumn("as_of_date", as_of)
        .join(people.select("customer_id", "signup_date"), "customer_id", "left")
        .groupBy("customer_id")
        .agg(
            F.count("*").alias("orders_lifetime"),
            F.round(F.sum("gmv"), 2).alias("gmv_lifetime"),
            F.min("date_day").alias("first_order_date"),
            F.max("date_day").alias("last_order_date"),
            F.min(age).alias("recency_days"),
            F.count(F.when(now, 1)).alias("orders_90d"),
            F.count(F.when(now & F.col("has_promotion"), 1)).alias("promo_orders_90d"),
            sum_where(F.col("gmv"), now).alias("gmv_90d"),
            sum_where(F.col("gross_margin"), now).alias("gross_margin_90d"),
            sum_where(F.col("discount_total"), now).alias("subsidy_90d"),
            F.count(F.when(then, 1)).alias("orders_prev_90d"),
            F.max(month_start(F.col("date_day")) == next_month).alias("ordered_m1"),
        )
    )
    history = keep(history, "int_customer_history")
    counts = ["orders_lifetime", "gmv_lifetime", "orders_90d", "promo_orders_90d", "gmv_90d", "gross_margin_90d",
              "subsidy_90d", "orders_prev_90d"]
    base = people.join(history, "customer_id", "left").fillna(0, counts).fillna(False, ["ordered_m1"])
    return score_customers(base.withColumn("as_of_date", as_of), first_month, last_month, params)


def score_customers(base: DataFrame, first_month: Column, last_month: Column, params: Params) -> DataFrame:
    """Fifth-of-the-base scores and the segment rules; the order of the rules matters."""
    active = base.filter("orders_lifetime > 0").withColumn("staleness", -F.col("recency_days"))
    measures = {"r_score": "staleness", "f_score": "orders_lifetime", "m_score": "gmv_lifetime"}
    # Four cut values per measure, found without sorting the customers into one task.
    starts = quantile_starts(active, list(measures.values()), 5)
    value = {"staleness": -F.col("recency_days")}
    scores = {
        name: F.when(F.col("orders_lifetime") > 0, quantile_score(value.get(m, F.col(m)), starts[m]))
        for name, m in measures.items()
    }
    cost = params.delivery_cost_per_order
    scored = base.withColumns(scores).withColumns(
        {
            "active_curr_90d": F.col("orders_90d") > 0,
            "active_prev_90d": F.col("orders_prev_90d") > 0,
            "delivery_cost_90d": F.col("orders_90d") * cost,
            "contribution_90d": F.col("gross_margin_90d") - F.col("orders_90d") * cost,
            "discount_dependency_index": positive_ratio(F.col("promo_orders_90d"), F.col("orders_90d")),
            "m1_observable": (F.col("cohort_month") >= first_month)
            & (F.add_months("cohort_month", 1) <= last_month),
        }
    )
    r, f, ddi = F.col("r_score"), F.col("f_score"), F.col("discount_dependency_index")
    lapsed = ~F.col("active_curr_90d")
    return scored.withColumns(
        {
            "rfm_segment": F.concat(r.cast("string"), f.cast("string"), F.col("m_score").cast("string")),
            "ddi_band": F.when(ddi.isNull(), "no_orders").when(ddi >= 0.6, "high").when(ddi >= 0.25, "medium").otherwise("low"),
            "customer_segment": F.when(F.col("orders_lifetime") == 0, "never_ordered")
            .when(lapsed & (f >= 3), "at_risk")
            .when(lapsed, "hibernating")
            .when((r >= 4) & (f >= 4), "champion")
            .when((r >= 4) & (f <= 2), "promising")
            .when((r >= 3) & (f >= 3), "loyal")
            .when((r <= 2) & (f >= 3), "at_risk")
            .when((r <= 2) & (f <= 2), "hibernating")
            .otherwise("needs_attention"),
        }
    )


def mart_cohort_retention(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Share of each signup cohort active in each month since, against the whole cohort."""
    bounds = _order_bounds(orders)
    first_month, last_month = [bounds.select(c).scalar() for c in ("first_month", "last_month")]
    cohorts = (
        customers.withColumns({"first_month": first_month, "last_month": last_month})
        .filter("cohort_month >= first_month")
        .groupBy("cohort_month", "last_month")
        .agg(F.count("*").alias("cohort_size"))
        .withColumn("months_observed", months_between_starts(F.col("cohort_month"), F.col("last_month")))
        .filter("months_observed >= 0")
    )
    grid = cohorts.withColumn("month_index", F.explode(F.sequence(F.lit(0), F.col("months_observed"))))
    activity = (
        orders.select("customer_id", month_start(F.col("date_day")).alias("month"))
        .distinct()
        .join(customers.select("customer_id", "cohort_month"), "customer_id")
        .groupBy("cohort_month", months_between_starts(F.col("cohort_month"), F.col("month")).alias("month_index"))
        .agg(F.count("*").alias("active_customers"))
    )
    return (
        grid.join(activity, ["cohort_month", "month_index"], "left")
        .fillna(0, ["active_customers"])
        .withColumn("retention_rate", F.col("active_customers") / F.col("cohort_size").cast("double"))
        .drop("last_month")
    )


# Feeds that are not expected to write every day.
NOT_DAILY = ("pos_returns", "customer_snapshot")


def dq_source_coverage(feeds: dict[str, tuple[DataFrame, str]], calendar: DataFrame, products: DataFrame) -> DataFrame:
    """Rows per feed and day; a daily feed is judged between its own first and last day."""
    counted = reduce(
        DataFrame.unionByName,
        [
            df.groupBy(F.col(day).alias("date_day"))
            .agg(F.count("*").alias("row_count"))
            .select(F.lit(name).alias("source_name"), "date_day", "row_count")
            for name, (df, day) in feeds.items()
        ],
    )
    bounds = products.agg(F.min("snapshot_date").alias("a"), F.max("snapshot_date").alias("b"))
    first, last = bounds.select("a").scalar(), bounds.select("b").scalar()
    window_end = calendar.withColumns({"a": first, "b": last}).filter("date_day between a and b").agg(F.max("date_day")).scalar()
    lives = (
        counted.groupBy("source_name")
        .agg(F.min("date_day").alias("first_seen_date"), F.max("date_day").alias("last_seen_date"))
        .withColumns({"expects_daily": ~F.col("source_name").isin(*NOT_DAILY), "a": first, "b": last, "end": window_end})
        .withColumn("from", F.greatest("first_seen_date", "a"))
        .withColumn("to", F.least("last_seen_date", "b"))
        .filter("from <= to")
    )
    expected = lives.withColumn("date_day", F.explode(F.sequence("from", "to")))
    daily = F.col("expects_daily")
    return expected.join(counted, ["source_name", "date_day"], "left").select(
        "source_name", "date_day", "expects_daily", "first_seen_date", "last_seen_date",
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
        F.col("row_count").isNotNull().alias("is_present"),
        (daily & F.col("row_count").isNull()).alias("is_missing_partition"),
        (daily & (F.col("last_seen_date") < F.col("end"))).alias("is_stale"),
    )


# Order and wording of the presented figures.
DEAL_PAGES = ["does_it_pay", "who_should_see_it", "what_runs_tomorrow"]
EXPERIMENT_METRICS = ["gm_awm_pct", "wastage_rate_value", "availability_pct", "markdown_subsidy_inr"]


def _position(value: Column, names: list[str]) -> Column:
    at = F.array_position(F.array(*[F.lit(n) for n in names]), value)
    return F.when(at > 0, at.cast("int")).otherwise(9)


def mart_deal_readout(readout: DataFrame) -> DataFrame:
    value, unit = F.col("value"), F.col("unit")
    size = F.abs(value)
    shown = (
        F.when(value.isNull(), "–")
        .when((unit == "inr") & (size < 1000), F.concat(F.lit("Rs "), F.format_number(value, 2)))
        .when(unit == "inr", F.concat(F.lit("Rs "), F.format_number(value, 0)))
        .when(
            unit == "rate",
            F.concat(F.when(value >= 0, "+").otherwise("-"), F.format_number(size * 100, 2), F.lit(" pp")),
        )
        .when(unit == "ratio", F.concat(F.format_number(value, 2), F.lit("x")))
        .when(unit == "count", F.format_number(value, 2))
        .otherwise(F.format_number(value, 1))
    )
    known = F.col("ci_low").isNotNull() & F.col("ci_high").isNotNull()
    return readout.withColumns(
        {
            "page_order": _position(F.col("page"), DEAL_PAGES),
            "is_significant": F.when(known, (F.col("ci_low") > 0) | (F.col("ci_high") < 0)),
            "display_value": shown,
        }
    )


def mart_experiment_readout(readout: DataFrame) -> DataFrame:
    scale = F.when(F.col("unit") == "ratio", 100.0).otherwise(1.0)
    return readout.withColumns(
        {
            "display_order": _position(F.col("metric"), EXPERIMENT_METRICS),
            "is_measured": F.col("not_applicable_reason").isNull(),
            **{f"display_{c}": F.round(F.col(c) * scale, 2) for c in ("policy_a", "policy_b", "delta")},
            "display_unit": F.when(F.col("unit") == "ratio", "pp").when(F.col("unit") == "money", "Rs").otherwise("n/a"),
        }
    )
