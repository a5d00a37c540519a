"""Writing tables: whole, by rebuilt day, clustered, pruned."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_table(df: DataFrame, name: str, path: str | None = None) -> None:
    """Replace a catalogue table as a whole; with ``path`` its files live there."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)


def replace_days(df: DataFrame, path: str, day: str = "date_day") -> None:
    """Overwrite only the days present in ``df``; every other day's files stay as they are. Rows come together
    by day, and adaptive execution splits a day that is larger than the advisory partition size."""
    (
        df.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(day).parquet(path)
    )


def incremental_store_sku_day(wh, path: str, cutoff=None) -> DataFrame:
    """Rebuild the last days of the daily table at ``path``, or all of it the first time.

    Only days from ``lookback`` before the last stored one are rewritten; the rebuild reads a
    trailing window further back, never the whole history.
    """
    spark: SparkSession = wh.spark
    stored = _read_days(spark, path)
    rebuild_from = None
    if stored is not None:
        last = stored.agg(F.max("date_day")).first()[0]
        rebuild_from = spark.range(1).select(F.date_sub(F.lit(last), wh.params.late_arrival_lookback_days)).first()[0]
    replace_days(wh.store_sku_day(rebuild_from=rebuild_from, cutoff=cutoff), path)
    return _read_days(spark, path)


def _read_days(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.parquet(path)
        return found if found.columns else None
    except AnalysisException:
        return None


def write_clustered(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Files that each hold one range of ``keys``, sorted: small after encoding, prunable by statistics."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def write_pruned(df: DataFrame, path: str, without: Sequence[str]) -> None:
    df.drop(*without).write.mode("overwrite").parquet(path)


def policy_bundle(
    elasticity: DataFrame, bands: DataFrame, purchases: DataFrame, products: DataFrame, dispersion: DataFrame, daily: DataFrame,
    constants: Mapping[str, Mapping[str, float | Sequence[float]]],
) -> DataFrame:
    """What a policy may know, in rows (section, name, item, value): fitted parameters, the constants of each engine, and which
    build they come from. No recommendation of any day is in it.

    Lead times by category and over all come from one pass with grouping sets; every section is an aggregate, at most as long
    as there are cells, so nothing of the data's size is collected. ``bundle_json`` renders the rows.
    """
    spark = elasticity.sparkSession

    def rows(df: DataFrame, section: str, name: Column, values: Mapping[str, Column]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(k).alias("item"), v.cast("double").alias("value")) for k, v in values.items()])
        return df.select(F.lit(section).alias("section"), name.alias("name"), F.explode(each).alias("x")).select("section", "name", "x.*")

    cells = elasticity.join(bands.select("dte_band", "min_days", "max_days"), "dte_band")
    usable = F.when(F.col("is_identified"), F.col("elasticity_raw"))
    slopes = rows(cells, "elasticity", F.concat_ws(" | ", "l1_category", "dte_band"), {
        "min_days": F.col("min_days"), "max_days": F.col("max_days"), "elasticity_raw": F.col("elasticity_raw"), "standard_error": F.col("standard_error"),
        "is_identified": F.col("is_identified"), "elasticity_usable": usable,
    })
    timed = purchases.filter("lead_time_days is not null").join(products.select("sku_id", "l1_category"), "sku_id", "left").filter("l1_category is not null")
    lead = timed.groupingSets([["l1_category"], []], "l1_category").agg(
        F.grouping("l1_category").alias("pooled"), F.percentile("lead_time_days", F.lit(0.9)).alias("p90"), F.avg("lead_time_days").alias("mean"), F.count("*").alias("observations")
    )
    leads = rows(lead, "lead_time_days", F.when(F.col("pooled") == 1, "all").otherwise(F.col("l1_category")), {c: F.col(c) for c in ("p90", "mean", "observations")})
    spread = rows(dispersion, "demand", F.lit("dispersion"), {"k": F.col("k")})
    build = rows(daily.agg(F.count("*").alias("rows"), F.round(F.sum("net_revenue"), 2).alias("revenue")), "provenance", F.lit("agg_store_sku_day"), {"rows": F.col("rows"), "net_revenue": F.col("revenue")})
    sizes = rows(elasticity.agg(F.count("*").alias("n"), F.count(F.when(F.col("is_identified"), 1)).alias("i")), "provenance", F.lit("elasticity"), {"cells": F.col("n"), "identified": F.col("i")})
    fixed = [
        (section, name, None if not isinstance(value, (list, tuple)) else str(i), float(v))
        for section, items in constants.items() for name, value in items.items() for i, v in enumerate(value if isinstance(value, (list, tuple)) else [value])
    ]
    plain = spark.createDataFrame(fixed, "section string, name string, item string, value double")
    return slopes.unionByName(leads).unionByName(spread).unionByName(build).unionByName(sizes).unionByName(plain)


def bundle_json(bundle: DataFrame) -> DataFrame:
    """One JSON object a section: names, and under each its items (or its one value). Sections are at most as long as there are cells."""
    items = bundle.groupBy("section", "name").agg(
        F.max("item").alias("some"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("item", F.lit("value")).alias("k"), "value")))).alias("m")
    )
    body = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "m")))), {"ignoreNullFields": "false"})
    return items.groupBy("section").agg(body.alias("body"))
