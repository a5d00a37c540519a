"""Column builders: hashing, id and time-zone conformance, guarded arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# They make a row hash equal to one computed elsewhere over the same text.
HASH_SEPARATOR = "\x1f"
HASH_NULL = "\\N"

IST = "Asia/Kolkata"


def row_hash(names: Sequence[str]) -> Column:
    """md5 over the text of several columns; a null is not the empty string."""
    return F.md5(
        F.concat_ws(
            HASH_SEPARATOR,
            *[F.coalesce(F.col(n).cast("string"), F.lit(HASH_NULL)) for n in names],
        )
    )


def conformed_sku_id(sku: Column) -> Column:
    """``SKU_42`` becomes ``SKU-00042``; anything else is left as it is."""
    number = F.regexp_extract(sku, r"^SKU_([0-9]+)$", 1)
    width = F.greatest(F.length(number), F.lit(5))
    return F.when(number != "", F.concat(F.lit("SKU-"), F.lpad(number, width, "0"))).otherwise(sku)


def utc_to_ist(ts: Column) -> Column:
    """A zoneless UTC timestamp as a zoneless Indian timestamp."""
    return F.convert_timezone(F.lit("UTC"), F.lit(IST), ts)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields null, not an error, on a zero denominator."""
    return F.when(denominator != 0, numerator.cast("double") / denominator)


def positive_ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator > 0, numerator.cast("double") / denominator)


def changed(now: Column, before: Column) -> Column:
    return ~now.eqNullSafe(before)


def minute_number(ts: Column) -> Column:
    """Whole minutes of a zoneless timestamp since 1970, whatever the session's time zone."""
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 1440 + F.hour(ts) * 60 + F.minute(ts)


def hour_number(ts: Column) -> Column:
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 24 + F.hour(ts)


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed from start to end."""
    return minute_number(end) - minute_number(start)


def utc_instant(ts: Column) -> Column:
    """A zoneless UTC timestamp as an instant."""
    return F.concat(ts.cast("string"), F.lit("Z")).cast("timestamp")


def utc_wall_time(instant: Column) -> Column:
    """An instant as a zoneless UTC timestamp."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.unix_micros(instant) / F.lit(1e6))


def months_between_starts(start: Column, end: Column) -> Column:
    """Month boundaries crossed from start to end."""
    return (F.year(end) * 12 + F.month(end) - F.year(start) * 12 - F.month(start)).cast("int")


def at_hour(day: Column, hour: Column) -> Column:
    """Midnight of ``day`` plus a number of hours, without a time zone."""
    return day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour)


def zero_if_null(*names: str) -> dict[str, Column]:
    return {n: F.coalesce(F.col(n), F.lit(0)) for n in names}


def sum_where(value: Column, condition: Column) -> Column:
    return F.sum(F.when(condition, value))


def month_start(day: Column) -> Column:
    return F.trunc(day, "month")
