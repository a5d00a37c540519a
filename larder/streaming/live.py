"""The batch operators that make sense on arrival: late-aware streams over the same feeds."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from larder.functions.columns import conformed_sku_id, row_hash, utc_instant, utc_wall_time
from larder.operators.staging import ITEM_COLUMNS, ORDER_COLUMNS
from larder.sources.feeds import feed_schema

LATENESS = "48 hours"
LINE, ORDER = "line", "order"
MERGE_SESSIONS = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
# State that grows with the rows of two days, or of a first batch that holds them all, does not fit a heap; RocksDB keeps it on disk.
# Counting its rows would cost a read with every write, and a batch need store only what it changed.
STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}

# A stream's own session has adaptive execution off, for the plans that hold state. What is done with a finished batch may adapt:
# else the hint to bring days together is ignored, and every task writes a file of every day.
ADAPTIVE = {"spark.sql.adaptive.enabled": "true"}


@contextmanager
def started_with(spark: SparkSession, settings: Mapping[str, str]) -> Iterator[None]:
    """A query takes the session's settings when it starts, so those it needs are set for that moment only."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_feed(spark: SparkSession, root: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(feed_schema(name))
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{root}/{name}")


def deduplicated_orders(orders: DataFrame) -> DataFrame:
    """Orders retried within the allowed lateness, once each; state is bounded by the watermark."""
    return (
        orders.withColumns({"row_hash": row_hash(ORDER_COLUMNS), "event_time": utc_instant(F.col("order_ts"))})
        .withWatermark("event_time", LATENESS)
        .dropDuplicatesWithinWatermark(["row_hash"])
    )


def hourly_clicks(clicks: DataFrame) -> DataFrame:
    """Events per store, SKU and UTC hour, emitted when the watermark has passed the hour."""
    return (
        clicks.withColumns({"event_time": utc_instant(F.col("event_ts_utc")), "sku_id": conformed_sku_id(F.col("sku_id"))})
        .withWatermark("event_time", LATENESS)
        .groupBy(F.window("event_time", "1 hour"), "store_id", "sku_id", "event_type", "was_in_stock")
        .agg(F.count("*").alias("event_count"))
        .select(utc_wall_time(F.col("window.start")).alias("hour_utc"), "store_id", "sku_id", "event_type", "was_in_stock", "event_count")
    )


def browse_sessions(clicks: DataFrame, gap: str = "1 hour", min_span_hours: int = 2) -> DataFrame:
    """Views with no pause of an hour, kept when they span hours enough.

    A session ends after an hour of silence, so its boundaries differ from runs of whole hours. Started by ``to_folder``,
    events of a task are merged into sessions before the shuffle, so a much-viewed product sends few rows.
    """
    sessions = (
        clicks.filter(F.col("event_type") == "pdp_view")
        .withColumns({"event_time": utc_instant(F.col("event_ts_utc")), "sku_id": conformed_sku_id(F.col("sku_id"))})
        .withWatermark("event_time", LATENESS)
        .groupBy(F.session_window("event_time", gap), "store_id", "sku_id")
        .agg(F.count("*").alias("events"), F.min("event_time").alias("first_event"), F.max("event_time").alias("last_event"))
    )
    hours = (F.unix_timestamp("last_event") - F.unix_timestamp("first_event")) / 3600.0
    return sessions.filter(hours >= min_span_hours).select("store_id", "sku_id", "first_event", "last_event", "events")


def to_folder(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what has arrived, then stop; a restart resumes from the checkpoint."""
    with started_with(df.sparkSession, {MERGE_SESSIONS: "true"}):
        return (
            df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode(mode).trigger(availableNow=True).start()
        )


def lines_with_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Sold lines and orders as they arrive, retries within the allowed lateness dropped; ``upsert_sold_days`` joins them.

    Only what tells a retry from a new row is kept as state, bounded by the watermarks. Joined as streams, every line and
    order would be state too, at several reads and writes each of a key-value store; so a batch joins them as tables.
    """
    placed = deduplicated_orders(orders).select(
        F.lit(ORDER).alias("kind"), "order_id", "store_id", F.col("event_time").alias("at"), F.col("order_ts").cast("date").alias("day")
    )
    landed = (
        items.withColumns({"line_hash": row_hash(ITEM_COLUMNS), "arrived": F.col("dt").cast("timestamp")})
        .withWatermark("arrived", LATENESS).dropDuplicatesWithinWatermark(["line_hash"])
        .select(F.lit(LINE).alias("kind"), "order_id", "sku_id", "qty", "unit_realized_price", F.col("arrived").alias("at"), F.col("dt").alias("day"))
    )
    return landed.unionByName(placed, allowMissingColumns=True)


def sold_lines(arrivals: DataFrame, number: int) -> DataFrame:
    """Lines with the store and day of their order, of which batch ``number`` brought the line, the order or both.

    A line belongs to an order it comes up to two days before or four days after. Arrivals lie in folders by day, so what a
    batch does not reach is not read.
    """
    lines, orders = arrivals.filter(F.col("kind") == LINE), arrivals.filter(F.col("kind") == ORDER)
    line = lines.select(F.col("order_id").alias("of_order"), "sku_id", "qty", "unit_realized_price", F.col("at").alias("arrived"), F.col("day").alias("line_day"), F.col("batch").alias("line_batch"))
    order = orders.select("order_id", "store_id", F.col("at").alias("event_time"), F.col("day").alias("date_day"), "batch")
    near = (F.col("arrived") >= F.col("event_time") - F.expr("interval 2 days")) & (F.col("arrived") <= F.col("event_time") + F.expr("interval 4 days"))
    same = (F.col("of_order") == F.col("order_id")) & near

    def days(rows: DataFrame, before: int, after: int, name: str) -> DataFrame:
        """The days about those of ``rows``, one more each way for the hours that a zone shifts an instant."""
        reach = F.sequence(F.date_sub("day", before + 1), F.date_add("day", after + 1))
        return rows.filter(F.col("batch") == number).select("day").distinct().select(F.explode(reach).alias(name)).distinct()

    new_lines = line.filter(F.col("line_batch") == number).join(order.join(days(lines, 4, 2, "date_day"), "date_day", "left_semi"), same)
    new_orders = line.filter(F.col("line_batch") < number).join(days(orders, 2, 4, "line_day"), "line_day", "left_semi").join(order.filter(F.col("batch") == number), same)
    sold = ["store_id", "sku_id", "date_day", "qty", "unit_realized_price"]
    return new_lines.select(*sold).unionByName(new_orders.select(*sold))


def upsert_sold_days(lines: DataFrame, facts: str, checkpoint: str, write: Callable[[DataFrame], None]) -> StreamingQuery:
    """Units and revenue per store, SKU and day, from the lines that have arrived so far.

    ``lines`` are those of ``lines_with_orders``. A batch stores what arrived under its own number, by day, and the sums of
    the lines it made sold; days it touched are rebuilt from all stored sums of those days; ``write`` replaces them. A
    replayed batch overwrites its own files and reads none of later ones, so the result stays the same.
    """
    number_of = StructType([StructField("batch", LongType())])
    came = StructType([*lines.schema, *number_of])
    cell = ["store_id", "sku_id", "date_day"]

    def on_batch(batch: DataFrame, number: int) -> None:
        with started_with(batch.sparkSession, ADAPTIVE):
            upsert(batch, number)

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # The one run of the batch: it commits the state.
        batch.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(f"{facts}/arrived/batch={number}")
        arrivals = spark.read.schema(came).parquet(f"{facts}/arrived").filter(F.col("batch") <= number)
        added = sold_lines(arrivals, number).groupBy(*cell).agg(
            F.sum("qty").alias("units_sold"), F.sum(F.col("qty") * F.col("unit_realized_price")).alias("net_revenue")
        )
        added.hint("rebalance", "date_day").write.mode("overwrite").partitionBy("date_day").parquet(f"{facts}/sold/batch={number}")
        known = spark.read.schema(StructType([*added.schema, *number_of])).parquet(f"{facts}/sold").filter(F.col("batch") <= number)
        touched = known.filter(F.col("batch") == number).select("date_day").distinct()
        rows = known.join(touched, "date_day", "left_semi").groupBy(*cell)
        write(rows.agg(F.sum("units_sold").alias("units_sold"), F.sum("net_revenue").alias("net_revenue")))

    with started_with(lines.sparkSession, STATE_ON_DISK):
        return lines.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_days(
    orders: DataFrame, checkpoint: str, rebuild: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None]
) -> StreamingQuery:
    """Rebuild exactly the days each batch touched, late ones included.

    ``rebuild`` takes the touched days and returns their rows; ``write`` replaces those days.
    Both are whole-day operations, so a replayed batch leaves the same result.
    """

    def on_batch(batch: DataFrame, _: int) -> None:
        touched = batch.select(F.col("order_ts").cast("date").alias("date_day")).distinct()
        write(rebuild(touched))

    return (
        orders.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
