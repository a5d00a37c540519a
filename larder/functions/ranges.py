"""Joins on intervals, always keyed on an equality first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END_OF_TIME = "2999-12-31"


def in_force(
    facts: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    day: str,
    valid_from: str,
    valid_to: str,
    how: str = "inner",
) -> DataFrame:
    """Point-in-time join to half-open versions ``[valid_from, valid_to)``; an open one never ends."""
    f, v = facts.alias("f"), versions.alias("v")
    condition = F.lit(True)
    for key in keys:
        condition = condition & (F.col(f"f.{key}") == F.col(f"v.{key}"))
    condition = (
        condition
        & (F.col(f"f.{day}") >= F.col(f"v.{valid_from}"))
        & (F.col(f"f.{day}") < F.coalesce(F.col(f"v.{valid_to}"), F.lit(END_OF_TIME).cast("date")))
    )
    kept = [F.col(f"v.{c}") for c in versions.columns if c not in keys]
    if how in ("left_semi", "left_anti"):
        return f.join(v, condition, how)
    return f.join(v, condition, how).select("f.*", *kept)


def expand_days(df: DataFrame, start: Column, end_exclusive: Column, name: str) -> DataFrame:
    """One row per day of ``[start, end)``; an empty interval gives no row."""
    days = F.when(end_exclusive > start, F.sequence(start, F.date_sub(end_exclusive, 1)))
    return df.withColumn(name, F.explode(days))


def band_of(value: Column, bands: Sequence[tuple]) -> Column:
    """Name of the half-open band holding ``value``: the bands are a fixed short list."""
    out = F.lit(None).cast("string")
    for name, low, high, _ in reversed(bands):
        out = F.when((value >= low) & (value < high), F.lit(name)).otherwise(out)
    return out
