"""Dimensions: current members, version history, the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.columns import changed, month_start, positive_ratio, row_hash
from larder.functions.ordered import global_running, islands, latest_per_key, run_window


def int_product_sales_profile(lines: DataFrame, orders: DataFrame, products: DataFrame) -> DataFrame:
    """ABC by cumulative revenue share, XYZ by variation over the days a SKU sold."""
    sold = lines.join(orders.select("order_id", F.col("order_date_ist").alias("date_day")), "order_id").select(
        "sku_id", "date_day", F.col("signed_qty").alias("units_sold"),
        (F.col("signed_qty") * F.col("unit_realized_price")).alias("net_revenue"),
    )
    return sales_profile(sold, products)


def sales_profile(sold: DataFrame, products: DataFrame) -> DataFrame:
    """The same from units and revenue per SKU and day, in as many parts as there are (such as ``int_daily_sales``)."""
    daily = sold.groupBy("sku_id", "date_day").agg(
        F.sum("units_sold").alias("units"), F.sum("net_revenue").alias("revenue")
    )
    per_sku = daily.groupBy("sku_id").agg(
        F.sum("revenue").alias("net_revenue"),
        F.sum("units").alias("net_units"),
        F.count("*").alias("selling_days"),
        F.avg("units").alias("mean_units"),
        F.stddev_samp("units").alias("sd_units"),
        F.lit(True).alias("has_sales"),
    )
    profile = (
        products.select("sku_id").distinct().join(per_sku, "sku_id", "left")
        .fillna(0, ["net_revenue", "net_units", "selling_days"])
        .fillna(False, ["has_sales"])
        .withColumn("demand_cv", positive_ratio(F.col("sd_units"), F.col("mean_units")))
    )
    # Cents, so that the order of addition cannot move a SKU across a threshold.
    running = global_running(
        profile,
        [F.col("net_revenue").desc(), F.col("sku_id").asc()],
        {"running_revenue": F.round("net_revenue", 2)},
    )
    total = running.agg(F.sum(F.round("net_revenue", 2))).scalar()
    share = F.col("running_revenue") / F.nullif(F.col("total_revenue"), F.lit(0.0))
    return (
        running.withColumn("total_revenue", total)
        .withColumn("share", share)
        .withColumn("cumulative_revenue_share", F.round("share", 6))
        .withColumn(
            "abc_class",
            F.when(~F.col("has_sales"), "C")
            .when(F.col("share") <= 0.80, "A")
            .when(F.col("share") <= 0.95, "B")
            .otherwise("C"),
        )
        .withColumn(
            "xyz_class",
            F.when(F.col("demand_cv") < 0.5, "X").when(F.col("demand_cv") < 1.0, "Y").otherwise("Z"),
        )
        .drop("mean_units", "sd_units", "running_revenue", "total_revenue", "share")
    )


def dim_product(products: DataFrame, profile: DataFrame) -> DataFrame:
    latest = latest_per_key(products.drop("arrival_date", "pack_qty_was_repaired"), ["sku_id"], ["snapshot_date"])
    sales = profile.select(
        "sku_id", "abc_class", "xyz_class", F.concat("abc_class", "xyz_class").alias("abc_xyz_class"), "has_sales",
        F.col("net_revenue").alias("net_revenue_ltd"), F.col("net_units").alias("net_units_ltd"),
        "selling_days", "demand_cv",
    )
    return latest.join(sales, "sku_id", "left").withColumnsRenamed(
        {"deal_eligible": "deal_eligible_flag", "snapshot_date": "attributes_as_of_date"}
    )


def dim_product_snapshot(products: DataFrame) -> DataFrame:
    """SCD2 versions out of daily history: one row per maximal run of equal cost and price."""
    day = run_window(["sku_id"], "snapshot_date")
    first = F.row_number().over(day) == 1
    breaks = (
        first
        | changed(F.col("landed_cost"), F.lag("landed_cost").over(day))
        | changed(F.col("base_price"), F.lag("base_price").over(day))
    )
    numbered = islands(
        products.select("sku_id", "snapshot_date", "landed_cost", "base_price"),
        ["sku_id"], "snapshot_date", breaks, "version_no",
    )
    versions = numbered.groupBy("sku_id", "version_no").agg(
        F.min("snapshot_date").alias("valid_from_date"),
        F.max("snapshot_date").alias("last_seen_date"),
        F.min("landed_cost").alias("landed_cost"),
        F.min("base_price").alias("base_price"),
    )
    in_order = run_window(["sku_id"], "version_no")
    bounded = versions.withColumns(
        {
            "valid_to_date": F.lead("valid_from_date").over(in_order),
            "landed_cost_delta": F.col("landed_cost") - F.lag("landed_cost").over(in_order),
            "base_price_delta": F.col("base_price") - F.lag("base_price").over(in_order),
        }
    )
    return bounded.withColumns(
        {
            "dbt_scd_id": row_hash(["sku_id", "valid_from_date"]),
            "dbt_valid_from": F.col("valid_from_date").cast("timestamp_ntz"),
            "dbt_valid_to": F.col("valid_to_date").cast("timestamp_ntz"),
            "is_current": F.col("valid_to_date").isNull(),
            "days_effective": F.datediff(
                F.coalesce("valid_to_date", F.date_add("last_seen_date", 1)), "valid_from_date"
            ),
            "unit_margin": F.col("base_price") - F.col("landed_cost"),
            "gross_margin_pct": positive_ratio(F.col("base_price") - F.col("landed_cost"), F.col("base_price")),
        }
    )


def dim_customer(snapshots: DataFrame) -> DataFrame:
    latest = latest_per_key(snapshots, ["customer_id"], ["snapshot_date"])
    return latest.withColumnRenamed("snapshot_date", "attributes_as_of_date").withColumns(
        {
            "signup_cohort_month": month_start(F.col("signup_date")),
            "is_churned": F.col("churn_date").isNotNull(),
            "days_to_churn": F.datediff("churn_date", "signup_date"),
        }
    )


def dim_date(products: DataFrame, calendar_events: DataFrame, before: int = 30, after: int = 90) -> DataFrame:
    """A calendar around the observed days, with festivals, seasons and pay-cycle flags."""
    spine = products.agg(
        F.date_sub(F.min("snapshot_date"), before).alias("a"), F.date_add(F.max("snapshot_date"), after).alias("b")
    ).select(F.explode(F.sequence("a", "b")).alias("date_day"))
    # The seed list is short and expands to one row per covered day, so this is an equi join.
    covered = calendar_events.select(
        "event_name", "event_type", "start_date",
        F.explode(F.expr("sequence(start_date, date_add(start_date, duration_days - 1))")).alias("date_day"),
    )
    festival = covered["event_type"] == "festival"
    by_day = covered.groupBy("date_day").agg(
        F.min_by(F.when(festival, F.col("event_name")), F.when(festival, F.struct("start_date", "event_name"))).alias(
            "festival_name"
        ),
        F.count(F.when(festival, 1)).alias("festivals_in_progress"),
        F.max(F.col("event_type") == "sports_season").alias("is_ipl_window"),
    )
    day = F.col("date_day")
    return (
        spine.join(F.broadcast(by_day), "date_day", "left")
        .fillna(0, ["festivals_in_progress"])
        .fillna(False, ["is_ipl_window"])
        .withColumns(
            {
                "day_name": F.date_format(day, "EEEE"),
                "day_of_week": F.weekday(day) + 1,
                "day_of_month": F.dayofmonth(day),
                "week_start_date": F.trunc(day, "week"),
                "month_start_date": month_start(day),
                "month_name": F.date_format(day, "MMMM"),
                "quarter_of_year": F.quarter(day),
                "calendar_year": F.year(day),
                "is_weekend": F.weekday(day) >= 5,
                "is_salary_week": F.dayofmonth(day) <= 7,
                "is_month_end": F.dayofmonth(day) >= 25,
                "is_monsoon": F.month(day).between(6, 9),
                "is_festival": F.col("festival_name").isNotNull(),
            }
        )
    )


def dim_dte_band(bands: DataFrame) -> DataFrame:
    return bands.withColumnRenamed("band", "dte_band")


def dim_promotion(promotions: DataFrame, prices: DataFrame) -> DataFrame:
    seen = prices.filter(F.col("promo_id").isNotNull()).groupBy("promo_id").agg(
        F.min("effective_date").alias("first_seen_date"),
        F.max("effective_date").alias("last_seen_date"),
        F.count("*").alias("priced_store_sku_days"),
        F.round(F.avg("discount_pct"), 4).alias("observed_depth_pct"),
        F.round(F.min("discount_pct"), 4).alias("observed_depth_pct_min"),
        F.round(F.max("discount_pct"), 4).alias("observed_depth_pct_max"),
        F.lit(True).alias("was_ever_run"),
    )
    return promotions.join(seen, "promo_id", "left").fillna(False, ["was_ever_run"]).withColumns(
        {
            "start_ts": F.col("first_seen_date").cast("timestamp_ntz"),
            "end_ts": F.date_add("last_seen_date", 1).cast("timestamp_ntz"),
        }
    )


def dim_store(stores: DataFrame) -> DataFrame:
    total = F.col("chilled_capacity_units") + F.col("ambient_capacity_units")
    affinity = F.col("category_affinity")
    return stores.withColumns(
        {
            "total_capacity_units": total,
            "chilled_capacity_share": F.col("chilled_capacity_units") / F.nullif(total.cast("double"), F.lit(0.0)),
            "affinity_dairy_eggs": affinity.getItem("Dairy & Eggs"),
            "affinity_fruits_vegetables": affinity.getItem("Fruits & Vegetables"),
            "affinity_ready_to_eat": affinity.getItem("Ready to Eat & Frozen"),
        }
    ).drop("category_affinity", "daily_operating_hours", "arrival_date")


def dim_supplier(suppliers: DataFrame) -> DataFrame:
    """Suppliers plus the member that opening stock belongs to.

    The freshness list is ``[mean, sd]``; the three outputs summarise it as a list, whatever it
    holds.
    """
    spread = F.col("inbound_freshness_pct")
    known = suppliers.select(
        "supplier_id", "supplier_name", "categories", "lead_time_mean_days", "lead_time_sd_days", "otif_rate",
        "monsoon_otif_penalty", "cost_index",
        F.coalesce("private_label_only", F.lit(False)).alias("is_private_label_only"),
        F.aggregate(spread, F.lit(0.0), lambda a, x: a + x, lambda a: a / F.size(spread)).alias(
            "inbound_freshness_pct_mean"
        ),
        F.array_min(spread).alias("inbound_freshness_pct_min"),
        F.array_max(spread).alias("inbound_freshness_pct_max"),
        F.lit(False).alias("is_unknown_member"),
    )
    unknown = suppliers.sparkSession.createDataFrame(
        [("SUP-OPENING", "Opening balance (no supplier)", False, True)],
        "supplier_id string, supplier_name string, is_private_label_only boolean, is_unknown_member boolean",
    )
    return known.unionByName(unknown, allowMissingColumns=True)
