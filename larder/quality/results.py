"""Every check of a run as one table, ``dq_test_results``, and the coverage scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.quality import contracts, rules

MISSING_FAIL = 1000


def coverage_scan(coverage: DataFrame) -> DataFrame:
    """Stale feeds fail; missing partitions warn, and fail past a bound; no rows at all fails."""
    sums = coverage.agg(
        F.countDistinct(F.when(F.col("is_stale"), F.struct("source_name", "last_seen_date"))).alias("stale"),
        F.count(F.when(F.col("is_missing_partition"), 1)).alias("missing"), F.count("*").alias("n"),
    )
    missing = F.col("missing")

    def check(name: str, value, status):
        return F.struct(F.lit(name).alias("check_name"), value.alias("value"), status.alias("status"))

    rows = F.array(
        check("no_feed_is_stale", F.col("stale"), F.when(F.col("stale") > 0, "fail").otherwise("pass")),
        check("no_partition_is_missing", missing, F.when(missing > MISSING_FAIL, "fail").when(missing > 0, "warn").otherwise("pass")),
        check("coverage_is_measured", F.col("n"), F.when(F.col("n") > 0, "pass").otherwise("fail")),
    )
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def dq_test_results(wh) -> DataFrame:
    """One row per check and source: what failed, how many rows, how severe."""
    for table in rules.LINE_TABLES:
        wh(table)
    day = wh("agg_store_sku_day").agg(F.max("date_day")).scalar()
    generic = contracts.generic_tests(wh).select(
        F.concat_ws(":", "check_name", "column_name").alias("check_name"), F.lit("generic").alias("check_type"),
        F.col("table_name").alias("source_name"), F.lit("error").alias("test_severity"), "failed_rows",
    )
    singular = rules.singular_tests(wh).select(
        "check_name", F.lit("singular").alias("check_type"), F.lit("warehouse").alias("source_name"),
        F.lit("error").alias("test_severity"), "failed_rows",
    )
    coverage = wh("dq_source_coverage")
    fresh = coverage.groupBy("source_name").agg(F.count(F.when(F.col("is_stale"), 1)).alias("failed_rows")).select(
        F.lit("fresh").alias("check_name"), F.lit("freshness").alias("check_type"), "source_name", F.lit("error").alias("test_severity"), "failed_rows"
    )
    complete = coverage.groupBy("source_name").agg(F.count(F.when(F.col("is_missing_partition"), 1)).alias("failed_rows")).select(
        F.lit("complete").alias("check_name"), F.lit("completeness").alias("check_type"), "source_name", F.lit("warn").alias("test_severity"), "failed_rows"
    )
    every = generic.unionByName(singular).unionByName(fresh).unionByName(complete)
    status = F.when(F.col("failed_rows") == 0, "pass").when(F.col("test_severity") == "warn", "warn").otherwise("fail")
    return every.withColumns({"status": status, "date_day": day})
