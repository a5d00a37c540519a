"""Difference-in-differences over repeated store experiments, and the reports built on it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.functions.columns import ratio
from larder.functions.stats import student_quantile, t_cdf

METRICS = ["units_expired", "writeoff_value", "units_lost", "revenue", "margin"]
TRENDS_ALPHA = 0.05


def with_margin(panel: DataFrame) -> DataFrame:
    """Margin added, repeated runs of one seed, store and day kept once."""
    keys = [k for k in ("component", "param", "value", "seed", "store_id", "day_rel") if k in panel.columns]
    return panel.withColumn("margin", F.col("revenue") - F.col("cogs")).dropDuplicates(keys)


def _long(panel: DataFrame, metrics: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per metric and run: the four cell means, from a single aggregate of the panel."""
    cells = []
    for m in metrics:
        for post in (0, 1):
            for treated in (0, 1):
                cond = (F.col("post").cast("int") == post) & (F.col("treated").cast("int") == treated)
                cells.append(F.avg(F.when(cond, F.col(m))).alias(f"{m}|{post}{treated}"))
    wide = panel.groupBy(*by, "seed").agg(*cells)
    packed = F.array(
        *[F.struct(F.lit(m).alias("metric"), *[F.col(f"{m}|{k}").alias(f"c{k}") for k in ("00", "01", "10", "11")]) for m in metrics]
    )
    return wide.select(*by, "seed", F.explode(packed).alias("x")).select(*by, "seed", "x.*")


def seed_did(panel: DataFrame, metrics: Sequence[str] = METRICS, by: Sequence[str] = ()) -> DataFrame:
    """Change among treated less change among controls, per seed."""
    effect = (F.col("c11") - F.col("c01")) - (F.col("c10") - F.col("c00"))
    return _long(panel, metrics, by).select(*by, "seed", "metric", effect.alias("did"))


def _p_values(df: DataFrame, t: str, n: str, name: str) -> DataFrame:
    """Two-sided Student p-values; the frame has one row per metric and setting."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            p = [
                2 * (1 - t_cdf(abs(a), int(b) - 1)) if b and b > 1 and a == a and a is not None else None
                for a, b in zip(rows[t], rows[n], strict=True)
            ]
            yield rows.assign(**{name: pd.Series(p, dtype="float64", index=rows.index)})

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields) + f", {name} double"
    return df.mapInPandas(run, schema)


def estimate(panel: DataFrame, metrics: Sequence[str] = METRICS, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the per-seed effects with a Student interval over seeds."""
    over = seed_did(panel, metrics, by).groupBy(*by, "metric").agg(
        F.avg("did").alias("effect"), F.stddev_samp("did").alias("sd"), F.count("did").alias("seeds")
    )
    control = F.col("post") & ~F.col("treated")
    base = panel.groupBy(*by).agg(*[F.avg(F.when(control, F.col(m))).alias(m) for m in metrics])
    bases = base.select(
        *by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("base")) for m in metrics])).alias("x")
    ).select(*by, "x.*")
    se = F.col("sd") / F.sqrt(F.col("seeds").cast("double"))
    half = student_quantile(0.975, F.col("seeds")) * se
    out = over.join(bases, [*by, "metric"]).select(
        *by, "metric", "effect", (ratio(F.col("effect"), F.col("base")) * 100).alias("relative"),
        (F.col("effect") - half).alias("ci_low"), (F.col("effect") + half).alias("ci_high"), "seeds",
        F.when(se > 0, F.col("effect") / se).alias("t"),
    )
    return _p_values(out, "t", "seeds", "p_value").drop("t")


def pre_trend_gap(panel: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Per seed, how much faster the treated group was moving before treatment."""
    daily = panel.filter(~F.col("post")).groupBy("seed", "day_rel", "treated").agg(*[F.avg(m).alias(m) for m in metrics])
    slopes = daily.groupBy("seed").agg(
        *[
            F.regr_slope(F.when(F.col("treated") == side, F.col(m)), F.when(F.col("treated") == side, F.col("day_rel"))).alias(f"{m}|{int(side)}")
            for m in metrics
            for side in (True, False)
        ]
    )
    packed = F.array(*[F.struct(F.lit(m).alias("metric"), (F.col(f"{m}|1") - F.col(f"{m}|0")).alias("gap")) for m in metrics])
    return slopes.select("seed", F.explode(packed).alias("x")).select("seed", "x.*")


def trends_are_parallel(gaps: DataFrame, alpha: float = TRENDS_ALPHA) -> DataFrame:
    """Whether the mean slope gap over seeds can be told from zero; needs three seeds."""
    over = gaps.groupBy("metric").agg(F.avg("gap").alias("mean_gap"), F.stddev_samp("gap").alias("sd"), F.count("gap").alias("seeds"))
    se = F.col("sd") / F.sqrt(F.col("seeds").cast("double"))
    tested = _p_values(over.withColumn("t", F.when(se > 0, F.col("mean_gap") / se)), "t", "seeds", "p_value")
    enough = F.col("seeds") >= 3
    return tested.select(
        "metric", "mean_gap", "seeds", F.when(enough, F.col("p_value")).alias("p_value"),
        (enough & (F.col("p_value") > alpha)).alias("parallel"),
    )


# What the readout reports, in which unit, and what it cannot report.
READOUT = [("wastage_rate_value", "ratio"), ("gm_awm_pct", "ratio"), ("availability_pct", "ratio"), ("markdown_subsidy_inr", "money")]
NOT_APPLICABLE = {
    "retention_90d": "stores were randomised, not customers",
    "forecast_wape": "only one of the policies forecasts",
}


def _derived(panel: DataFrame) -> DataFrame:
    served = F.col("units_sold") + F.col("units_lost")
    derived = {
        "wastage_rate_value": ratio(F.col("writeoff_value"), F.col("revenue")),
        "gm_awm_pct": ratio(F.col("revenue") - F.col("cogs") - F.col("writeoff_value"), F.col("revenue")),
        "availability_pct": 1 - ratio(F.col("units_lost"), served),
    }
    if "markdown_subsidy" in panel.columns:
        derived["markdown_subsidy_inr"] = F.col("markdown_subsidy")
    return panel.withColumns(derived)


def experiment_readout(panel: DataFrame) -> DataFrame:
    """Both policies, the difference and its interval per metric; what is not measured says why."""
    spark, derived = panel.sparkSession, _derived(panel)
    present = [m for m, _ in READOUT if m in derived.columns]
    unit = F.create_map(*[F.lit(x) for pair in READOUT for x in pair])
    arms = derived.filter("post").agg(
        *[F.avg(F.when(F.col("treated") == side, F.col(m))).alias(f"{m}|{int(side)}") for m in present for side in (False, True)]
    )
    packed = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"{m}|0").alias("policy_a"), F.col(f"{m}|1").alias("policy_b")) for m in present]
    )
    means = arms.select(F.explode(packed).alias("x")).select("x.*")
    measured = means.join(estimate(derived, present), "metric").select(
        "metric", unit[F.col("metric")].alias("unit"), "policy_a", "policy_b", F.col("effect").alias("delta"), "ci_low", "ci_high",
        ((F.col("ci_low") > 0) | (F.col("ci_high") < 0)).alias("significant"), "seeds",
    )
    missing = {m: "the panel predates this metric" for m, _ in READOUT if m not in present}
    reasons = spark.createDataFrame(
        [(m, "n/a", r) for m, r in {**missing, **NOT_APPLICABLE}.items()],
        "metric string, unit string, not_applicable_reason string",
    )
    return measured.unionByName(reasons, allowMissingColumns=True)


FULL = "full"


def attribution(panel: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Each component's contribution: the full policy's effect less the effect without it.

    The residual row is what the components do together.
    """
    effects = estimate(panel, metrics, ["component"]).select("component", "metric", "relative")
    full = effects.filter(F.col("component") == FULL).select("metric", F.col("relative").alias("total"))
    parts = effects.filter(F.col("component") != FULL).join(full, "metric").select(
        "metric", "component", (F.col("total") - F.col("relative")).alias("contribution"), "total"
    )
    rest = parts.groupBy("metric").agg(F.first("total").alias("total"), F.sum("contribution").alias("s")).select(
        "metric", F.lit("residual").alias("component"), (F.col("total") - F.col("s")).alias("contribution"), "total"
    )
    return parts.unionByName(rest)


def one_horizon(panel: DataFrame) -> DataFrame:
    """Settings whose runs span other days than the rest: they cannot be compared."""
    spans = panel.groupBy("param", "value").agg(F.min("day_rel").alias("first_day"), F.max("day_rel").alias("last_day"))
    bounds = spans.agg(F.min("first_day").alias("a"), F.max("last_day").alias("b"))
    first, last = bounds.select("a").scalar(), bounds.select("b").scalar()
    return spans.withColumns({"a": first, "b": last}).filter("first_day <> a or last_day <> b").drop("a", "b")


def sensitivity(panel: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Does an effect keep its sign and significance at every setting of each parameter."""
    if not one_horizon(panel).isEmpty():
        raise ValueError("the runs span different days; compare only runs of one horizon")
    settings = estimate(panel, metrics, ["param", "value"])
    return settings.groupBy("param", "metric").agg(
        F.count("*").alias("settings"), F.min("effect").alias("lowest"), F.max("effect").alias("highest"),
        F.max("p_value").alias("worst_p"),
        (
            (F.count("*") >= 2)
            & (F.min(F.col("effect") > 0) == F.max(F.col("effect") > 0))
            & F.min(F.coalesce(F.col("p_value") < 0.05, F.lit(False)))
        ).alias("survives"),
    )


def arm_totals(panel: DataFrame) -> DataFrame:
    sums = ["units_sold", "units_expired", "writeoff_value", "revenue", "cogs"]
    return panel.groupBy("arm").agg(
        F.sum(F.col("units_sold") + F.col("units_lost")).alias("units_demanded"), *[F.sum(c).alias(c) for c in sums]
    )


def experiment_panel(daily: DataFrame, start, seed: Column, treated: Column) -> DataFrame:
    """A store experiment read off the daily table: one row per seed, store and day."""
    return (
        daily.groupBy(seed.alias("seed"), "store_id", "date_day")
        .agg(
            F.sum("units_sold").alias("units_sold"), F.sum("writeoff_units").alias("units_expired"),
            F.sum("writeoff_value").alias("writeoff_value"),
            F.sum(F.greatest(F.col("units_demanded_imputed") - F.col("units_sold"), F.lit(0.0))).alias("units_lost"),
            F.sum("net_revenue").alias("revenue"), F.sum("cogs").alias("cogs"),
            F.sum("markdown_subsidy_platform").alias("markdown_subsidy"), F.sum("order_count").alias("orders"),
        )
        .withColumns({"day_rel": F.datediff("date_day", F.lit(start)), "treated": treated})
        .withColumn("post", F.col("day_rel") >= 0)
        .drop("date_day")
    )


def stack(frames: dict[str, DataFrame], name: str) -> DataFrame:
    """Runs of several settings in one panel, labelled."""
    return reduce(DataFrame.unionByName, [df.withColumn(name, F.lit(k)) for k, df in frames.items()])
