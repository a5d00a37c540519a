"""The fourteen retail feeds, derived from TPC-H-style tables by Spark.

The order book of the given tables is folded onto one trading year, stores are the regions of
the customers, SKUs are brand and type. The derived feeds carry the dirt the staging layer
must repair: late and duplicated rows, two return encodings, two SKU id formats, UTC clicks,
movements that lost their batch, drifting pack units. Every given row is kept.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.functions.ordered import by_key, task_count
from larder.params import Params
from larder.plans.warehouse import Warehouse
from larder.workspace import Workspace
from suite.trials import trial

# The derivation is only comparable when both sides use the same ones.
FIRST_DAY = date(2025, 1, 1)
LAST_DAY = date(2025, 12, 31)
ORDER_BOOK_START = date(1995, 1, 1)
YEAR_DAYS = 365
BATCH_DAYS = 15
PART_TYPES = ["STANDARD", "ECONOMY", "MEDIUM", "PROMO", "LARGE", "SMALL"]
DEAL_PRICE = 11.0
ASSIGNED_DATE = date(2025, 7, 1)
# Sequence numbers pack (day, kind, key, sku); every field has room for far larger tables.
SEQ_KEY_SPAN = 1 << 40
SEQ_SKU_SPAN = 512
# Rows of one batch inside this much sequence: at most 2^20 order keys of one day and SKU.
LEDGER_SLICE_WIDTH = SEQ_SKU_SPAN << 20

# Feeds that several models read are written once, as the raw layer of a warehouse is.
# Items and movements are row by row projections of what was sold: whoever reads them takes the columns wanted.
LANDED = {"skus", "sold", "receipts", "pos_orders", "price_history", "catalog_snapshot"}

PROMO_BY_RULE = (
    "case when rule = 0 and dw < 5 then 'PROMO-MD-30' when rule = 1 and dw < 3 then 'PROMO-MD-50' "
    "when rule = 2 and dw < 4 and day_idx between 182 and 321 then 'PROMO-DEAL11' when rule = 3 and dw < 2 then 'PROMO-MD-50' "
    "when rule = 4 and dw in (0, 1, 2, 4) then 'PROMO-MD-30' end"
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _day(index: Column) -> Column:
    return F.date_add(F.lit(FIRST_DAY), index.cast("int"))


def _store_id(store_no: Column) -> Column:
    return F.concat(F.lit("STR-"), store_no.cast("string"))


def _sku_id(sku_no: Column) -> Column:
    return F.concat(F.lit("SKU-"), F.lpad(sku_no.cast("string"), 5, "0"))


def _batch_id(store_no: Column, sku_no: Column, block: Column) -> Column:
    return F.concat_ws("-", F.lit("B"), store_no, sku_no, block)


def _sku_number() -> Column:
    kind = F.array_position(F.array(*[F.lit(t) for t in PART_TYPES]), F.col("p_type")).cast("int") - 1
    return F.substring("p_brand", 7, 9).cast("int") * 10 + kind


def _shelf_life() -> Column:
    return F.lit(16) + F.pmod(F.col("sku_no"), F.lit(4)) * 8


def _prices(df: DataFrame) -> DataFrame:
    """Catalogue prices of a row holding sku_no, base0 and day_idx."""
    return df.withColumn(
        "base_price", F.expr("base0 + case when (day_idx div 45 + sku_no) % 3 = 0 then 1.0D else 0.0D end")
    ).withColumn("landed_cost", F.expr("round(base0 * 0.6D, 2) + 0.5D * ((day_idx div 60 + sku_no) % 2)"))


def _promotions(df: DataFrame) -> DataFrame:
    """Promotion rule, code and posted price of a row holding store_no, sku_no, day_idx, base_price."""
    ruled = df.withColumns(
        {
            "rule": F.expr("(sku_no * 31 + store_no * 17 + (day_idx div 7) * 13) % 20"),
            "dw": F.expr("day_idx % 7"),
        }
    )
    return ruled.withColumn("promo_id", F.expr(PROMO_BY_RULE)).withColumn(
        "realized_price",
        F.when(F.col("promo_id") == "PROMO-MD-30", F.round(F.col("base_price") * 0.72, 2))
        .when(F.col("promo_id") == "PROMO-MD-50", F.round(F.col("base_price") * 0.52, 2))
        .when(F.col("promo_id") == "PROMO-DEAL11", F.lit(DEAL_PRICE))
        .otherwise(F.col("base_price")),
    )


class TpchFeeds:
    """Derived feeds by name; ``keep`` is called on the few that several others read."""

    def __init__(self, spark: SparkSession, folder: str, keep=lambda df, name: df):
        self.spark, self.folder, self._keep = spark, folder, keep
        self._made: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            made = getattr(self, f"_{name}")()
            self._made[name] = self._keep(made, f"tpch_{name}") if name in LANDED else made
        return self._made[name]

    def _read(self, name: str) -> DataFrame:
        return _table(self.spark, self.folder, name)

    def _skus(self) -> DataFrame:
        part = self._read("part").withColumn("sku_no", _sku_number())
        return part.groupBy("sku_no", "p_brand", "p_type").agg(
            (F.round(F.min("p_retailprice") / 30, 2) + F.pmod(F.col("sku_no") * 7, F.lit(60))).alias("base0")
        )

    def _headers(self) -> DataFrame:
        home = (
            self._read("customer")
            .join(self._read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", F.col("n_regionkey").alias("store_no"))
        )
        day = F.pmod(F.datediff("o_orderdate", F.lit(ORDER_BOOK_START)), F.lit(YEAR_DAYS))
        return (
            self._read("orders")
            .join(home, F.col("o_custkey") == F.col("c_custkey"))
            .select("o_orderkey", "o_custkey", "store_no", day.alias("day_idx"))
        )

    def _sold(self) -> DataFrame:
        part = self._read("part").select("p_partkey", _sku_number().alias("sku_no"))
        given = self._read("lineitem")
        lines = (
            given
            .join(part, F.col("l_partkey") == F.col("p_partkey"))
            # By order alone, so that grouping and the join with the headers share one shuffle.
            .repartition(task_count(given), "l_orderkey")
            .groupBy("l_orderkey", "sku_no")
            .agg(
                F.sum("l_quantity").cast("int").alias("qty"),
                F.max(F.col("l_returnflag") == "R").alias("is_returned"),
                F.min("l_suppkey").alias("suppkey"),
            )
        )
        rows = lines.join(self("headers"), F.col("l_orderkey") == F.col("o_orderkey")).join(
            self("skus").select("sku_no", "base0"), "sku_no"
        )
        priced = _promotions(_prices(rows)).withColumn("block", F.expr(f"day_idx div {BATCH_DAYS}"))
        return priced.select(
            "o_orderkey", "o_custkey", "store_no", "sku_no", "day_idx", "block", "qty", "is_returned",
            "suppkey", "base_price", "landed_cost", "promo_id", "realized_price",
        )

    def _assortment_days(self) -> DataFrame:
        """Every day of every store-SKU that ever sold: stores x SKUs x one year."""
        pairs = self("sold").select("store_no", "sku_no").distinct()
        return pairs.withColumn("day_idx", F.explode(F.sequence(F.lit(0), F.lit(YEAR_DAYS - 1))))

    def _pos_orders(self) -> DataFrame:
        sold = self("sold")
        # By order, in tasks that follow the rows; the headers come to them.
        served = by_key(sold.select("o_orderkey", "qty"), "o_orderkey", task_count(sold)).groupBy("o_orderkey").agg(
            F.sum("qty").alias("served")
        )
        key = F.col("o_orderkey")
        minute = key.cast("long") % 1440
        slack = F.lit(12) + (key * 7) % 20
        ordered = _day(F.col("day_idx")).cast("timestamp_ntz") + F.make_dt_interval(
            F.lit(0), F.lit(0), minute.cast("int")
        )

        def later(minutes: Column) -> Column:
            return F.col("order_ts") + F.make_dt_interval(F.lit(0), F.lit(0), minutes.cast("int"))

        copies = F.when(key % 40 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return (
            self("headers")
            .join(served, "o_orderkey", "left")
            .withColumn("order_ts", ordered)
            .withColumn("copy", F.explode(copies))
            .select(
                F.concat(F.lit("ORD-"), key.cast("string")).alias("order_id"),
                _store_id(F.col("store_no")).alias("store_id"),
                F.concat(F.lit("CUS-"), F.col("o_custkey").cast("string")).alias("customer_id"),
                "order_ts",
                later(F.lit(20)).alias("promised_ts"),
                later(slack).alias("delivered_ts"),
                (slack > 20).alias("is_late"),
                F.element_at(
                    F.array(*[F.lit(m) for m in ("upi", "card", "cod", "wallet")]), (key % 4 + 1).cast("int")
                ).alias("payment_mode"),
                F.when(F.col("served").isNull(), key % 5 + 1)
                .otherwise(F.col("served") + F.when(key % 3 == 0, 2).otherwise(0))
                .cast("long")
                .alias("n_units"),
                F.date_add(_day(F.col("day_idx")), (key % 3 + F.col("copy")).cast("int")).alias("dt"),
            )
        )

    def _pos_order_items(self) -> DataFrame:
        key = F.col("o_orderkey")
        turned = F.col("is_returned") & (key % 2 == 0)
        signed = F.when(
            turned, F.array(F.col("qty"), -F.least(F.col("qty"), (key % 3 + 1).cast("int")))
        ).otherwise(F.array(F.col("qty")))
        copies = F.when(key % 50 == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return (
            self("sold")
            .withColumn("signed", F.explode(signed))
            .withColumn("copy", F.explode(copies))
            .select(
                F.concat(F.lit("ORD-"), key.cast("string")).alias("order_id"),
                _sku_id(F.col("sku_no")).alias("sku_id"),
                _batch_id(F.col("store_no"), F.col("sku_no"), F.col("block")).alias("batch_id"),
                F.col("signed").alias("qty"),
                F.col("base_price").alias("unit_base_price"),
                F.col("realized_price").alias("unit_realized_price"),
                F.round(F.col("base_price") - F.col("realized_price"), 2).alias("discount_amt"),
                F.col("landed_cost").alias("unit_cogs"),
                (_shelf_life() - F.col("day_idx") % BATCH_DAYS).cast("int").alias("dte_at_sale"),
                "promo_id",
                (key % 11 == 0).alias("is_substitution"),
                F.date_add(_day(F.col("day_idx")), (key % 3 + F.col("copy")).cast("int")).alias("dt"),
            )
        )

    def _pos_returns(self) -> DataFrame:
        key = F.col("o_orderkey")
        matched = self("sold").filter(F.col("is_returned") & (key % 2 == 1)).withColumn("stray", F.lit(False))
        stray = self("sold").filter(key % 89 == 5).withColumn("stray", F.lit(True))
        reasons = F.array(*[F.lit(r) for r in ("damaged", "wrong_item", "quality", "late")])
        back = F.date_add(_day(F.col("day_idx")), 2)
        return matched.unionByName(stray).select(
            F.concat(F.lit("ORD-"), key.cast("string")).alias("order_id"),
            F.when(F.col("stray"), F.lit("SKU-99999")).otherwise(_sku_id(F.col("sku_no"))).alias("sku_id"),
            _batch_id(F.col("store_no"), F.col("sku_no"), F.col("block")).alias("batch_id"),
            F.least(F.col("qty"), (key % 3 + 1).cast("int")).alias("qty"),
            F.element_at(reasons, (key % 4 + 1).cast("int")).alias("reason"),
            back.alias("return_date"),
            back.alias("dt"),
        )

    def _receipts(self) -> DataFrame:
        """One row per batch: units in, units left over, dates."""
        grouped = self("sold").groupBy("store_no", "sku_no", "block").agg(
            F.sum("qty").alias("sold_units"), F.min("suppkey").alias("suppkey")
        )
        dated = grouped.withColumns(
            {
                "day_idx": (F.col("block") * BATCH_DAYS).cast("int"),
                "leftover": F.pmod(F.col("sku_no") * 3 + F.col("block"), F.lit(6)) * 4,
                "shelf": _shelf_life(),
            }
        ).withColumn("expiry_idx", F.col("day_idx") + F.col("shelf"))
        return _prices(dated.join(self("skus").select("sku_no", "base0"), "sku_no")).drop("base0", "base_price")

    def _wms_inventory_batch(self) -> DataFrame:
        opening = F.col("block") == 0
        batch = _batch_id(F.col("store_no"), F.col("sku_no"), F.col("block"))
        received = _day(F.col("day_idx"))
        return self("receipts").select(
            batch.alias("batch_id"),
            _sku_id(F.col("sku_no")).alias("sku_id"),
            _store_id(F.col("store_no")).alias("store_id"),
            F.when(opening, F.lit("SUP-OPENING"))
            .otherwise(F.concat(F.lit("SUP-"), F.col("suppkey").cast("string")))
            .alias("supplier_id"),
            F.when(~opening, F.concat(F.lit("PO-"), batch)).alias("po_id"),
            (F.col("sold_units") + F.col("leftover")).cast("long").alias("qty_received"),
            F.col("landed_cost").alias("unit_landed_cost"),
            F.col("shelf").cast("int").alias("usable_days"),
            F.date_sub(received, 2).alias("mfg_date"),
            received.alias("received_date"),
            _day(F.col("expiry_idx")).alias("expiry_date"),
            received.alias("dt"),
        )

    def _wms_inventory_movement(self) -> DataFrame:
        def seq(kind: int, key: Column) -> Column:
            day = F.col("at_idx").cast("long")
            return ((day * 4 + kind) * SEQ_KEY_SPAN + key) * SEQ_SKU_SPAN + F.col("sku_no")

        def rows(df: DataFrame, kind: int, key: Column, batch: Column, event: Column, delta: Column):
            return df.select(
                seq(kind, key).alias("movement_seq"),
                batch.alias("batch_id"),
                event.alias("event_type"),
                delta.cast("long").alias("qty_delta"),
                _day(F.col("at_idx")).alias("event_date"),
                _day(F.col("at_idx")).alias("dt"),
            )

        batch = _batch_id(F.col("store_no"), F.col("sku_no"), F.col("block"))
        holder = F.col("store_no").cast("long") * 1000 + F.col("block")
        receipts = self("receipts")
        inbound = rows(
            receipts.withColumn("at_idx", F.col("day_idx")), 0, holder, batch,
            F.when(F.col("block") == 0, F.lit("opening_balance")).otherwise(F.lit("inbound")),
            F.col("sold_units") + F.col("leftover"),
        )
        key = F.col("o_orderkey")
        sales = rows(
            self("sold").withColumn("at_idx", F.col("day_idx")), 1, key,
            F.when(key % 97 != 0, batch), F.lit("sale"), -F.col("qty"),
        )
        scrapped = receipts.filter(
            (F.col("leftover") > 0) & (F.col("sku_no") % 2 == 0) & (F.col("expiry_idx") < YEAR_DAYS)
        )
        expired = rows(
            scrapped.withColumn("at_idx", F.col("expiry_idx")), 2, holder, batch,
            F.lit("expiry_writeoff"), -F.col("leftover"),
        )
        return inbound.unionByName(sales).unionByName(expired)

    def _wms_purchase_orders(self) -> DataFrame:
        batch = _batch_id(F.col("store_no"), F.col("sku_no"), F.col("block"))
        received = _day(F.col("day_idx"))
        units = (F.col("sold_units") + F.col("leftover")).cast("long")
        short = F.col("block") % 4 == 0
        late = F.col("block") % 2 == 1
        return self("receipts").filter(F.col("block") > 0).select(
            F.concat(F.lit("PO-"), batch).alias("po_id"),
            _store_id(F.col("store_no")).alias("store_id"),
            _sku_id(F.col("sku_no")).alias("sku_id"),
            F.concat(F.lit("SUP-"), F.col("suppkey").cast("string")).alias("supplier_id"),
            (units + F.when(short, 3).otherwise(0)).alias("ordered_qty"),
            units.alias("received_qty"),
            (F.lit(0.8) + F.pmod(F.col("sku_no"), F.lit(15)) / 100).alias("inbound_freshness_pct"),
            F.date_sub(received, (F.col("sku_no") % 3 + 3).cast("int")).alias("ordered_date"),
            F.date_sub(received, late.cast("int")).alias("expected_date"),
            received.alias("received_date"),
            short.alias("is_short"),
            late.alias("is_late"),
            received.alias("dt"),
        )

    def _wms_stockout_interval(self) -> DataFrame:
        days = self("assortment_days").withColumn("r", F.expr("(store_no * 13 + sku_no * 7 + day_idx * 3) % 23"))
        hour = F.when(F.col("r") == 0, F.expr("(sku_no + day_idx) % 24")).when(
            (F.col("r") == 3) & (F.col("sku_no") % 2 == 0), F.lit(0)
        )
        return days.withColumn("hour_out", hour.cast("int")).filter("hour_out is not null").select(
            _store_id(F.col("store_no")).alias("store_id"),
            _sku_id(F.col("sku_no")).alias("sku_id"),
            _day(F.col("day_idx")).alias("event_date"),
            "hour_out",
            _day(F.col("day_idx")).alias("dt"),
        )

    def _catalog_snapshot(self) -> DataFrame:
        days = self("skus").withColumn("day_idx", F.explode(F.sequence(F.lit(0), F.lit(YEAR_DAYS - 1))))
        sku, day = F.col("sku_no"), F.col("day_idx")
        brand = F.floor(sku / 10)
        drifted = (day >= 200) & (sku % 8 == 0)
        return _prices(days).select(
            _sku_id(sku).alias("sku_id"),
            F.concat(F.lit("Item "), sku.cast("string")).alias("sku_name"),
            F.col("p_brand").alias("brand"),
            (brand == 1).alias("is_private_label"),
            F.col("p_type").alias("l1_category"),
            F.concat(F.col("p_type"), F.lit("-"), (brand % 5).cast("string")).alias("l2_subcategory"),
            F.element_at(F.array(*[F.lit(z) for z in ("ambient", "chilled", "frozen")]), (sku % 3 + 1).cast("int")).alias(
                "temp_zone"
            ),
            F.element_at(F.array(*[F.lit(u) for u in ("g", "kg", "ml", "pc")]), (sku % 4 + 1).cast("int")).alias("uom"),
            F.when(sku % 4 == 0, F.when(drifted, F.lit(0.5)).otherwise(F.lit(500.0)))
            .when(sku % 4 == 1, F.lit(1.0))
            .when(sku % 4 == 2, F.lit(250.0))
            .otherwise(F.lit(6.0))
            .alias("pack_qty"),
            _shelf_life().cast("int").alias("shelf_life_days"),
            (F.col("base_price") + 10).alias("mrp"),
            "base_price",
            "landed_cost",
            F.lit(0.05).alias("gst_rate"),
            (sku % 3 == 0).alias("deal_eligible"),
            _day(day).alias("snapshot_date"),
            _day(day).alias("dt"),
        )

    def _price_history(self) -> DataFrame:
        days = self("assortment_days").join(self("skus").select("sku_no", "base0"), "sku_no")
        posted = _promotions(_prices(days)).filter("promo_id is not null")
        stacked = F.when(
            F.col("rule") == 3, F.array(F.lit("PROMO-MD-30"), F.lit("PROMO-MD-50"))
        ).otherwise(F.array("promo_id"))
        return posted.withColumn("promo_id", F.explode(stacked)).select(
            _store_id(F.col("store_no")).alias("store_id"),
            _sku_id(F.col("sku_no")).alias("sku_id"),
            _day(F.col("day_idx")).alias("effective_date"),
            "base_price",
            "realized_price",
            "promo_id",
            _day(F.col("day_idx")).alias("dt"),
        )

    def _clickstream(self) -> DataFrame:
        event, user = F.col("event_id"), F.col("user_id")
        number = ((user % 2 + 1) * 10 + event % 6).cast("int")
        at = F.col("ts") + F.make_dt_interval(F.lit(366))
        return (
            self._read("events")
            .withColumn("event_ts_utc", at)
            .select(
                _store_id(F.floor(user / 2) % 5).alias("store_id"),
                F.when(event % 4 == 0, F.concat(F.lit("SKU_"), number.cast("string")))
                .otherwise(_sku_id(number))
                .alias("sku_id"),
                F.when(F.col("event_type") == "error", F.lit("notify_me")).otherwise(F.lit("pdp_view")).alias("event_type"),
                ((F.col("event_type") != "error") & (F.col("value") >= 5)).alias("was_in_stock"),
                "event_ts_utc",
                F.col("event_ts_utc").cast("date").alias("event_date"),
                F.col("event_ts_utc").cast("date").alias("dt"),
            )
        )

    def _customer_snapshot(self) -> DataFrame:
        key = F.col("c_custkey")
        quarters = F.sequence(F.lit(FIRST_DAY), F.lit(LAST_DAY), F.expr("interval 3 months"))
        signup = F.date_add(F.lit(date(2024, 9, 1)), (key * 37 % 420).cast("int"))
        return (
            self._read("customer")
            .join(self._read("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .withColumn("signup_date", signup)
            .withColumn("snapshot_date", F.explode(quarters))
            .select(
                F.concat(F.lit("CUS-"), key.cast("string")).alias("customer_id"),
                _store_id(F.col("n_regionkey")).alias("home_store_id"),
                F.lower("c_mktsegment").alias("acquisition_channel"),
                F.element_at(F.array(*[F.lit(d) for d in ("android", "ios", "web")]), (key % 3 + 1).cast("int")).alias(
                    "device"
                ),
                ((key + F.quarter("snapshot_date")) % 2 == 0).alias("is_member"),
                "signup_date",
                F.when(key % 10 == 3, F.date_add("signup_date", 120)).alias("churn_date"),
                F.col("snapshot_date").alias("dt"),
            )
        )

    def _crm_deal_exposure(self) -> DataFrame:
        key = F.col("c_custkey")
        return self._read("customer").select(
            F.concat(F.lit("CUS-"), key.cast("string")).alias("customer_id"),
            F.when(key % 5 == 0, F.lit("holdout")).otherwise(F.lit("exposed")).alias("deal_arm"),
            F.lit(ASSIGNED_DATE).alias("assigned_date"),
            F.lit(0.2).alias("holdout_share"),
        )

    def _ref_stores(self) -> DataFrame:
        no = F.col("r_regionkey")
        return self._read("region").select(
            _store_id(no).alias("store_id"),
            F.concat(F.lit("Store "), F.col("r_name")).alias("store_name"),
            F.col("r_name").alias("locality"),
            (F.lit(411001) + no).cast("string").alias("pincode"),
            F.element_at(F.array(F.lit("premium"), F.lit("mid"), F.lit("value")), no % 3 + 1).alias("catchment_tier"),
            (F.lit(18.5) + no * 0.02).alias("lat"),
            (F.lit(73.8) + no * 0.03).alias("lon"),
            (F.lit(1.0) + no * 0.1).alias("demand_index"),
            F.lit(3.0).alias("serviceable_radius_km"),
            (F.lit(4000) + no * 500).alias("chilled_capacity_units"),
            (F.lit(9000) + no * 100).alias("ambient_capacity_units"),
            (F.lit(1500)).alias("frozen_capacity_units"),
            F.lit(24).alias("daily_operating_hours"),
            F.map_from_arrays(
                F.array(F.lit("Dairy & Eggs"), F.lit("Fruits & Vegetables")),
                F.array(F.lit(1.0) + no * 0.05, F.lit(1.2) - no * 0.05),
            ).alias("category_affinity"),
            F.lit(FIRST_DAY).alias("opened_date"),
            F.lit(FIRST_DAY).alias("dt"),
        )

    def _ref_suppliers(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self._read("supplier").select(
            F.concat(F.lit("SUP-"), key.cast("string")).alias("supplier_id"),
            F.col("s_name").alias("supplier_name"),
            F.lit("all").alias("categories"),
            (key % 4 + 1).cast("double").alias("lead_time_mean_days"),
            F.lit(0.5).alias("lead_time_sd_days"),
            (F.lit(0.9) + (key % 10) / 100).alias("otif_rate"),
            F.lit(0.1).alias("monsoon_otif_penalty"),
            F.array((F.lit(0.7) + (key % 20) / 100), F.lit(0.05)).alias("inbound_freshness_pct"),
            F.lit(1.0).alias("cost_index"),
            F.when(key % 7 == 0, F.lit(True)).alias("private_label_only"),
            F.lit(FIRST_DAY).alias("dt"),
        )


_OPEN: dict[tuple[str, str], tuple[list, Warehouse]] = {}


def _state(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """Name, size and time of change of everything in the folder, by Spark's own file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in found)


def open_tpch(spark: SparkSession, folder: str) -> Warehouse:
    """The warehouse over one folder of given tables; built once per Spark application and state of the files.

    Its served forecast is the moving average, which SQL can repeat; ``jobs.served_forecast`` is compared
    by itself.
    """
    key, state = (spark.sparkContext.applicationId, folder), _state(spark, folder)
    if key in _OPEN and _OPEN[key][0] != state:
        _OPEN.pop(key)[1].close()
    if key not in _OPEN:
        workspace = Workspace(spark, folder)
        feeds = TpchFeeds(spark, folder, keep=workspace.write)
        params = Params(ledger_slice_width=LEDGER_SLICE_WIDTH, demand_model="baseline")
        _OPEN[key] = state, Warehouse(spark, feeds, workspace, params, {"experiment_panel": trial})
    return _OPEN[key][1]
