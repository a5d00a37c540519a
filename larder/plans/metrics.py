"""Declared metrics over any reachable dimension: ``metric(wh, "gm_awm", ["category"])``."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

S = F.sum
c = F.col


class MetricError(ValueError):
    """A request the registry cannot answer."""


def _distinct_customers(condition: Column | None = None) -> Column:
    return F.countDistinct("customer_id" if condition is None else F.when(condition, c("customer_id")))


@dataclass(frozen=True)
class Metric:
    name: str
    source: str
    grain: tuple[str, ...]
    expression: Callable[[], Column] | None = None
    numerator: Callable[[], Column] | None = None
    denominator: Callable[[], Column] | None = None
    direction: str = "up_is_good"
    bounds: tuple[float, float] | None = None
    guarded_by: str | None = None
    requires_experiment: bool = False

    def measure(self) -> Column:
        """A ratio divides two sums; it is never a mean of row ratios."""
        if self.expression is not None:
            return self.expression()
        return self.numerator().cast("double") / F.nullif(self.denominator().cast("double"), F.lit(0.0))


def _m(name, source, grain, num, den=None, **more) -> Metric:
    parts = {"expression": num} if den is None else {"numerator": num, "denominator": den}
    return Metric(name, source, tuple(grain.split()), **parts, **more)


CELL, C360, ACC = "agg_store_sku_day", "mart_customer_360", "mart_forecast_accuracy"
DOWN = {"direction": "down_is_good"}

METRICS: dict[str, Metric] = {
    m.name: m
    for m in [
        _m(
            "gm_awm", CELL, "store date_day",
            lambda: S(c("net_revenue") - c("cogs") - c("writeoff_value") - c("markdown_subsidy_platform")),
            lambda: S("net_revenue"), bounds=(-0.20, 0.60), guarded_by="retention_90d",
        ),
        _m("net_revenue", CELL, "store date_day", lambda: S("net_revenue")),
        _m("cogs_value", CELL, "store date_day", lambda: S("cogs"), **DOWN),
        _m("gross_margin_pct", CELL, "store date_day", lambda: S(c("net_revenue") - c("cogs")), lambda: S("net_revenue"), bounds=(-0.10, 0.70)),
        _m("aov", "mart_order_daily", "store date_day", lambda: S("net_revenue"), lambda: S("orders_count"), bounds=(50, 5000)),
        _m("wastage_rate_value", CELL, "store category week", lambda: S("writeoff_value"), lambda: S("received_value"), bounds=(0.0, 0.35), **DOWN),
        _m("wastage_value", CELL, "store category date_day", lambda: S("writeoff_value"), **DOWN),
        _m("sell_through_rate", CELL, "store sku week", lambda: S("units_sold"), lambda: S(c("opening_units") + c("received_units")), bounds=(0.0, 1.0)),
        # Days to expiry is a small integer, so the exact percentile's buffer is as wide as a shelf life.
        _m("dte_at_sale_p10", "fct_order_item", "store category week", lambda: F.percentile("dte_at_sale", F.lit(0.10)), bounds=(0, 60)),
        _m("expiry_value_at_risk", "mart_expiry_risk", "store category date_day", lambda: S(c("units_at_risk") * c("unit_landed_cost")), **DOWN),
        _m("in_stock_pct", "fct_availability_hour", "store sku date_day", lambda: F.count(F.when(c("on_hand_units") > 0, 1)), lambda: F.count("*"), bounds=(0.0, 1.0)),
        # The hours-weighted reading of the same question.
        _m("in_stock_pct_hours", "fct_availability_hour", "store sku date_day", lambda: S(F.when(c("is_in_stock"), c("hours_in_state")).otherwise(0)), lambda: S("hours_in_state"), bounds=(0.0, 1.0)),
        _m("fill_rate", CELL, "store sku date_day", lambda: S("units_sold"), lambda: S("units_demanded_imputed"), bounds=(0.0, 1.0)),
        _m("lost_sales_units", CELL, "store sku date_day", lambda: S(F.greatest(c("units_demanded_imputed") - c("units_sold"), F.lit(0.0))), **DOWN),
        _m("days_of_cover", CELL, "store sku date_day", lambda: S("closing_units"), lambda: S("trailing_7d_avg_units"), direction="neutral", bounds=(0, 400)),
        _m("forecast_wape", ACC, "store sku horizon_days date_day", lambda: S(F.abs(c("actual_units") - c("forecast_units"))), lambda: S("actual_units"), bounds=(0.0, 3.0), **DOWN),
        _m("forecast_bias", ACC, "store sku date_day", lambda: S(c("forecast_units") - c("actual_units")), lambda: S("actual_units"), direction="neutral", bounds=(-1.0, 1.0)),
        _m(
            "forecast_value_add", ACC, "abc_class xyz_class",
            lambda: S(F.abs(c("actual_units") - c("naive_units"))) - S(F.abs(c("actual_units") - c("forecast_units"))),
            lambda: S("actual_units"), bounds=(-1.0, 1.0),
        ),
        _m(
            "markdown_depth", CELL, "store category date_day",
            lambda: S((c("base_price_avg") - c("realized_price_avg")) * c("markdown_units")),
            lambda: S(c("base_price_avg") * c("markdown_units")), direction="neutral", bounds=(0.0, 0.90),
        ),
        _m("markdown_subsidy_value", CELL, "store category date_day", lambda: S("markdown_subsidy_platform"), **DOWN),
        _m("discount_leakage_value", "mart_markdown_perf", "store sku week", lambda: S(F.when(c("p_sell_full_price") > 0.80, c("discount_value")).otherwise(0)), bounds=(0, 1e7), **DOWN),
        _m("margin_recovery_rate", "mart_markdown_perf", "store category week", lambda: S(c("realized_revenue") - c("landed_cost_value")), lambda: S("landed_cost_value"), bounds=(-1.0, 2.0)),
        _m("subsidy_per_incremental_order", "mart_deal_slot_perf", "store week", lambda: S("subsidy_value"), lambda: S(c("orders") - c("control_implied_orders")), requires_experiment=True, **DOWN),
        _m("basket_size_uplift", "mart_deal_slot_perf", "store week", lambda: S("treated_basket_value") - S("control_basket_value"), lambda: S("control_basket_value"), requires_experiment=True),
        _m("private_label_gmv_share", CELL, "store category week", lambda: S(F.when(c("is_private_label"), c("net_revenue")).otherwise(0.0)), lambda: S("net_revenue"), bounds=(0.0, 1.0)),
        _m("retention_90d", C360, "store cohort_month", lambda: _distinct_customers(c("active_curr_90d") & c("active_prev_90d")), lambda: _distinct_customers(c("active_prev_90d")), bounds=(0.0, 1.0)),
        _m("retention_m1", C360, "cohort_month", lambda: _distinct_customers(c("ordered_m1")), lambda: _distinct_customers(c("m1_observable")), bounds=(0.0, 1.0)),
        _m("repeat_rate", C360, "store customer_segment", lambda: _distinct_customers(c("orders_90d") > 1), lambda: _distinct_customers(c("orders_90d") > 0), bounds=(0.0, 1.0)),
        _m("discount_dependency_index", C360, "customer_segment cohort_month", lambda: S("promo_orders_90d"), lambda: S("orders_90d"), bounds=(0.0, 1.0), **DOWN),
        _m("contribution_per_customer", C360, "store customer_segment ddi_band", lambda: S(c("gross_margin_90d") - c("delivery_cost_90d")), lambda: _distinct_customers(), bounds=(-2000, 20000)),
        _m("dq_test_pass_rate", "dq_test_results", "date_day test_severity", lambda: F.count(F.when(c("status") == "pass", 1)), lambda: F.count("*"), bounds=(0.0, 1.0)),
        _m("freshness_sla_breaches", "dq_test_results", "date_day source_name", lambda: F.count(F.when((c("check_type") == "freshness") & (c("status") == "fail"), 1)), **DOWN),
    ]
}
# These declare a formula but no job writes their table.
NEVER_BUILT = ("mart_markdown_perf", "mart_deal_slot_perf")


@dataclass(frozen=True)
class Dimension:
    name: str
    key: str
    attribute: str
    table: str | None = None


DIMENSIONS: dict[str, Dimension] = {
    d.name: d
    for d in [
        *[Dimension(n, "store_id", a, "dim_store") for n, a in [("store", "store_name"), ("locality", "locality"), ("store_tier", "catchment_tier")]],
        *[
            Dimension(n, "sku_id", a, "dim_product")
            for n, a in [
                ("sku", "sku_name"), ("category", "l1_category"), ("subcategory", "l2_subcategory"), ("brand", "brand"),
                ("is_private_label", "is_private_label"), ("temp_zone", "temp_zone"), ("abc_class", "abc_class"), ("xyz_class", "xyz_class"),
            ]
        ],
        *[
            Dimension(n, "date_day", a, "dim_date")
            for n, a in [
                ("week", "week_start_date"), ("month", "month_start_date"), ("day_of_week", "day_name"), ("is_festival", "is_festival"),
                ("is_monsoon", "is_monsoon"), ("is_salary_week", "is_salary_week"),
            ]
        ],
        *[Dimension(n, "customer_id", n, "mart_customer_360") for n in ("customer_segment", "cohort_month", "rfm_segment", "ddi_band")],
        *[Dimension(n, "promo_id", n, "dim_promotion") for n in ("promo_type", "funding_source")],
        Dimension("supplier", "supplier_id", "supplier_name", "dim_supplier"),
        *[Dimension(n, n, n) for n in ("date_day", "dte_band", "policy_arm", "horizon_days", "test_severity", "source_name")],
    ]
}


def validate_registry(metrics: dict[str, Metric] = METRICS, dimensions: dict[str, Dimension] = DIMENSIONS) -> list[str]:
    """What is wrong with the declarations; empty when nothing is."""
    problems = []
    for m in metrics.values():
        if (m.numerator is None) != (m.denominator is None):
            problems.append(f"{m.name}: a ratio needs a numerator and a denominator")
        if (m.expression is None) == (m.numerator is None):
            problems.append(f"{m.name}: exactly one of expression and ratio")
        problems += [f"{m.name}: unknown grain {g}" for g in m.grain if g not in dimensions]
        if m.guarded_by and m.guarded_by not in metrics:
            problems.append(f"{m.name}: unknown guard {m.guarded_by}")
        if m.bounds and m.bounds[0] > m.bounds[1]:
            problems.append(f"{m.name}: bounds are reversed")
    return problems


def _predicate(column: Column, op: str, value: Any) -> Column:
    simple = {
        "=": lambda: column == value, "!=": lambda: column != value, "<": lambda: column < value,
        "<=": lambda: column <= value, ">": lambda: column > value, ">=": lambda: column >= value,
    }
    if op in simple:
        return simple[op]()
    if op in ("in", "not in"):
        if not value:
            raise MetricError(f"'{op}' needs at least one value")
        return column.isin(*value) if op == "in" else ~column.isin(*value)
    if op == "between":
        return column.between(*value)
    raise MetricError(f"unknown operator {op!r}")


def notes_for(metric: Metric, dimensions: Sequence[str]) -> list[str]:
    """What a reader should know that is not an error."""
    beyond = sorted(set(dimensions) - set(metric.grain))
    notes = [f"sliced by {', '.join(beyond)}, outside the declared grain of {metric.name}"] if beyond else []
    if metric.requires_experiment:
        notes.append(f"{metric.name} needs a holdout to be an effect")
    return notes


def metric(
    wh,
    name: str,
    dimensions: Sequence[str] = (),
    filters: Sequence[tuple[str, str, Any]] = (),
    limit: int | None = None,
) -> DataFrame:
    """One row per combination of the dimensions' attributes, best first; a lazy plan."""
    if name not in METRICS:
        raise MetricError(f"unknown metric {name!r}")
    if limit is not None and limit <= 0:
        raise MetricError("limit must be positive")
    m = METRICS[name]
    if m.source in NEVER_BUILT:
        raise MetricError(f"'{name}' reads '{m.source}', a source that is not built")
    base = wh(m.source)
    used = list(dict.fromkeys([*dimensions, *[f[0] for f in filters]]))
    for d in used:
        if d not in DIMENSIONS:
            raise MetricError(f"unknown dimension {d!r}")
        if DIMENSIONS[d].key not in base.columns:
            raise MetricError(f"'{name}' cannot be sliced by '{d}': '{m.source}' has no '{DIMENSIONS[d].key}'")
    for note in notes_for(m, dimensions):
        warnings.warn(note, stacklevel=2)

    # Joined as (key, value) pairs under private names, so a formula can never bind to a
    # dimension's column and a key never matches twice.
    for d in used:
        dim = DIMENSIONS[d]
        if dim.table is None:
            base = base.withColumn(f"_d_{d}", c(dim.attribute))
            continue
        pairs = wh(dim.table).select(c(dim.key).alias(f"_k_{d}"), c(dim.attribute).alias(f"_d_{d}")).distinct()
        base = base.join(pairs, base[dim.key] == pairs[f"_k_{d}"], "left").drop(f"_k_{d}")
    if filters:
        base = base.filter(reduce(Column.__and__, [_predicate(c(f"_d_{d}"), op, v) for d, op, v in filters]))
    measured = base.groupBy(*[c(f"_d_{d}").alias(d) for d in dimensions]).agg(m.measure().alias(name))
    if dimensions:
        by = F.asc_nulls_last(name) if m.direction == "down_is_good" else F.desc_nulls_last(name)
        measured = measured.orderBy(by, *dimensions)
    return measured.limit(limit) if limit is not None else measured


def out_of_bounds(wh, name: str, dimensions: Sequence[str] = ()) -> DataFrame:
    """Rows of a metric outside its declared bounds."""
    m = METRICS[name]
    rows = metric(wh, name, dimensions)
    if m.bounds is None:
        return rows.filter(F.lit(False))
    return rows.filter(~c(name).between(*m.bounds))
