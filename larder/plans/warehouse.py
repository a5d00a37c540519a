"""The warehouse: every table by name, built from feeds on first use.

Wide tables that many jobs read are written once to the shared workspace; everything else stays
a lazy plan.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from larder.functions.ordered import task_count
from larder.operators import aggregates, dimensions, facts, marts, staging
from larder.params import Params
from larder.plans.jobs import job_builders
from larder.sources import seeds
from larder.workspace import Workspace

FEED_OF_STAGING = {
    "stg_pos__orders": "pos_orders",
    "stg_pos__order_items": "pos_order_items",
    "stg_pos__returns": "pos_returns",
    "stg_catalog__products": "catalog_snapshot",
    "stg_catalog__price_history": "price_history",
    "stg_web__clickstream": "clickstream",
    "stg_wms__inventory_movements": "wms_inventory_movement",
    "stg_wms__inventory_batches": "wms_inventory_batch",
    "stg_wms__purchase_orders": "wms_purchase_orders",
    "stg_wms__stockout_intervals": "wms_stockout_interval",
    "stg_crm__customers": "customer_snapshot",
    "stg_crm__deal_exposure": "crm_deal_exposure",
    "stg_ref__stores": "ref_stores",
    "stg_ref__suppliers": "ref_suppliers",
}

# Deduplicated by order, in a number of tasks that grows with the rows.
BY_ORDER = ("stg_pos__orders", "stg_pos__order_items")

# Layer edges: read by several tables, so written once.
KEPT = {
    "stg_pos__orders", "stg_pos__order_lines", "stg_pos__order_items", "stg_quarantine", "dq_source_coverage", "dim_product", "dim_date", "dim_promotion",
    "fct_order_item", "fct_order", "fct_inventory_movement", "fct_inventory_batch", "fct_availability_hour",
    "int_daily_sales", "int_movement_day",
    "fct_clickstream", "fct_price_history", "agg_store_sku_day", "agg_intraday_arrival_curve", "mart_customer_360",
    "mart_forecast_accuracy", "mart_demand_forecast", "mart_demand_baseline", "mart_expiry_risk", "elasticity_panel", "mart_price_elasticity",
    "rec_markdown", "rec_deal_slot", "rec_transfer_order", "rec_purchase_order", "event_panel", "uplift_panel", "dq_test_results",
}

# Columns of kept tables that follow from the rest of their row are computed on reading: hashes do not compress, and would be
# most of what is written.
ON_READ = {
    "stg_pos__orders": staging.order_hash, "stg_pos__order_items": staging.item_hash, "fct_order_item": facts.line_values,
}

# What the rebuild of ``agg_store_sku_day`` reads: facts with a ``date_day`` that grow with every day.
DAILY = ("fct_order_item", "fct_inventory_movement", "fct_availability_hour", "fct_clickstream")


class Warehouse:
    def __init__(
        self,
        spark: SparkSession,
        feed: Callable[[str], DataFrame],
        workspace: Workspace,
        params: Params = Params(),
        own: Mapping[str, Callable[[Warehouse], DataFrame]] | None = None,
        by_day: Collection[str] = (),
    ):
        """``own`` adds tables that no feed holds, such as ``experiment_panel``, or replaces built ones.

        Kept tables named in ``by_day`` (``DAILY``, where a day holds enough rows for files of its own) are partitioned
        by ``date_day``, so a rebuild of the last days opens no older file.
        """
        if unfit := set(by_day) - set(DAILY):
            raise ValueError(f"no table by day: {sorted(unfit)}")
        self._by_day = frozenset(by_day)
        self.spark, self.feed, self.workspace, self.params = spark, feed, workspace, params
        self._own = dict(own or {})
        self._tables: dict[str, DataFrame] = {}
        self._order_tasks: int | None = None

    def __call__(self, name: str) -> DataFrame:
        if name not in self._tables:
            df = self._build(name)
            day = "date_day" if name in self._by_day else None
            follows = ON_READ[name]() if name in ON_READ and name not in self._own else {}
            if name in KEPT:
                df = self.workspace.write(df.drop(*follows), name, day).withColumns(follows).select(*df.columns)
            self._tables[name] = df
        return self._tables[name]

    def unwritten(self, name: str, tasks: int | None = None) -> DataFrame:
        """The table if it is there, else its plan: a reader of a few columns neither writes the others nor shuffles again.

        ``tasks`` is for tables by order: those that are joined come in one number, or they would shuffle again.
        """
        return self._tables[name] if name in self._tables else self._build(name, tasks)

    def derive(self, name: str, build: Callable[[], DataFrame], keep: bool = True) -> DataFrame:
        """A job's table, built once under ``name``."""
        if name not in self._tables:
            df = build()
            self._tables[name] = self.workspace.write(df, name) if keep else df
        return self._tables[name]

    def close(self) -> None:
        """Forget all tables and delete those that were written; results that are still wanted must be stored before."""
        self._tables.clear()
        self._order_tasks = None
        self.workspace.remove()

    def __enter__(self) -> Warehouse:
        return self

    def __exit__(self, *failure) -> None:
        self.close()

    def put(self, name: str, df: DataFrame) -> None:
        self._tables[name] = df

    def has(self, name: str) -> bool:
        return name in self._tables

    def order_tasks(self) -> int:
        """In how many tasks items, their orders and their returns meet."""
        if self._order_tasks is None:
            there = [n for n in ("stg_pos__order_lines", "stg_pos__order_items") if n in self._tables or n in self._own]
            self._order_tasks = task_count(self.unwritten(there[0]) if there else self.feed("pos_order_items"))
        return self._order_tasks

    def _build(self, name: str, tasks: int | None = None) -> DataFrame:
        t, u = self, self.unwritten
        if name in self._own:
            return self._own[name](self)
        if name in BY_ORDER:
            raw = self.feed(FEED_OF_STAGING[name])
            return getattr(staging, name)(raw, tasks or task_count(raw))
        if name in FEED_OF_STAGING:
            return getattr(staging, name)(self.feed(FEED_OF_STAGING[name]))
        if name in seeds.SEED_ROWS:
            return seeds.seed(self.spark, name)
        builders: dict[str, Callable[[], DataFrame]] = {
            "stg_pos__order_lines": lambda: staging.stg_pos__order_lines(
                u("stg_pos__order_items", self.order_tasks()), t("stg_pos__returns"), self.order_tasks()
            ),
            "stg_quarantine": lambda: staging.stg_quarantine(
                self.feed("wms_inventory_movement"), t("stg_pos__returns"), t("stg_pos__order_items")
            ),
            "int_daily_sales": lambda: aggregates.daily_sales(u("fct_order_item"), t("dim_promotion")),
            "int_movement_day": lambda: facts.int_movement_day(t("stg_wms__inventory_movements")),
            "int_stock_day": lambda: facts.int_stock_day(t("int_movement_day"), t("stg_wms__inventory_batches")),
            "int_product_sales_profile": lambda: dimensions.sales_profile(t("int_daily_sales"), t("stg_catalog__products")),
            "dim_product": lambda: dimensions.dim_product(t("stg_catalog__products"), t("int_product_sales_profile")),
            "dim_product_snapshot": lambda: dimensions.dim_product_snapshot(t("stg_catalog__products")),
            "dim_customer": lambda: dimensions.dim_customer(t("stg_crm__customers")),
            "dim_date": lambda: dimensions.dim_date(t("stg_catalog__products"), t("calendar_events")),
            "dim_dte_band": lambda: dimensions.dim_dte_band(t("dte_bands")),
            "dim_promotion": lambda: dimensions.dim_promotion(t("promotions"), t("stg_catalog__price_history")),
            "dim_store": lambda: dimensions.dim_store(t("stg_ref__stores")),
            "dim_supplier": lambda: dimensions.dim_supplier(t("stg_ref__suppliers")),
            "fct_order_item": lambda: facts.fct_order_item(
                u("stg_pos__order_lines"), u("stg_pos__orders", self.order_tasks())
            ),
            "fct_order": lambda: facts.fct_order(
                # Not written yet, items come by order, and orders meet them in their tasks.
                u("stg_pos__orders", None if "fct_order_item" in self._tables else self.order_tasks()), u("fct_order_item")
            ),
            "fct_inventory_movement": lambda: facts.fct_inventory_movement(
                t("stg_wms__inventory_movements"), t("stg_wms__inventory_batches"), self.params.ledger_slice_width
            ),
            "fct_inventory_batch": lambda: facts.fct_inventory_batch(
                t("stg_wms__inventory_batches"), t("int_movement_day")
            ),
            "fct_availability_hour": lambda: facts.fct_availability_hour(
                t("fct_inventory_batch"), t("int_stock_day"), t("stg_catalog__products"),
                t("stg_wms__stockout_intervals"),
            ),
            "fct_clickstream": lambda: facts.fct_clickstream(t("stg_web__clickstream")),
            "fct_price_history": lambda: facts.fct_price_history(
                t("stg_catalog__price_history"), t("dim_promotion")
            ),
            "agg_intraday_arrival_curve": lambda: aggregates.agg_intraday_arrival_curve(
                t("fct_clickstream"), t("dim_product")
            ),
            "agg_store_sku_day": lambda: self.store_sku_day(),
            "mart_order_daily": lambda: marts.mart_order_daily(t("fct_order")),
            "mart_customer_360": lambda: marts.mart_customer_360(
                t("dim_customer"), u("fct_order"), self.params, lambda df, part: self.derive(part, lambda: df)
            ),
            "mart_cohort_retention": lambda: marts.mart_cohort_retention(t("fct_order"), t("mart_customer_360")),
            "dq_source_coverage": lambda: self._coverage(),
        }
        builders.update(job_builders(self))
        if name not in builders:
            raise KeyError(f"no such table: {name}")
        return builders[name]()

    def store_sku_day(self, rebuild_from=None, cutoff=None) -> DataFrame:
        t = self
        if rebuild_from is None and (cutoff or self.params.arrival_cutoff_date) is None:
            parts = [
                t("int_daily_sales"), aggregates.daily_stock(t("int_stock_day")),
                aggregates.daily_availability(t("fct_availability_hour")), aggregates.daily_browsing(t("fct_clickstream")),
            ]
            return aggregates.store_sku_days(parts, t("dim_product"), t("agg_intraday_arrival_curve"), self.params)
        params = replace(self.params, arrival_cutoff_date=cutoff) if cutoff else self.params
        return aggregates.agg_store_sku_day(
            t("fct_order_item"), t("fct_inventory_movement"), t("fct_availability_hour"), t("fct_clickstream"),
            t("dim_promotion"), t("dim_product"), t("agg_intraday_arrival_curve"), params, rebuild_from,
        )

    def _coverage(self) -> DataFrame:
        daily = {feed: (self(stg), "arrival_date") for stg, feed in FEED_OF_STAGING.items()
                 if not feed.startswith(("ref_", "crm_", "customer_"))}
        daily["customer_snapshot"] = (self("stg_crm__customers"), "snapshot_date")
        return marts.dq_source_coverage(daily, self("dim_date"), self("stg_catalog__products"))

