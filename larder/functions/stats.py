"""Intervals from sums: Welch for two arms, Student for a handful of repetitions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Z_95 = 1.96
Z_POWER = 0.84


def welch(df, arm: str, treated, outcomes: list[str]):
    """One row per outcome: arm means, difference, 95% interval, smallest detectable effect.

    One pass: every outcome's mean, variance and count per arm come from a single aggregate.
    """
    is_treated = F.col(arm) == treated
    parts = []
    for o in outcomes:
        for tag, cond in (("t", is_treated), ("c", ~is_treated)):
            v = F.when(cond, F.col(o).cast("double"))
            parts += [
                F.avg(v).alias(f"{o}_m{tag}"), F.var_samp(v).alias(f"{o}_v{tag}"), F.count(v).alias(f"{o}_n{tag}"),
            ]
    wide = df.agg(*parts)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(o).alias("outcome"),
                    *[F.col(f"{o}_{s}").alias(s) for s in ("mt", "mc", "vt", "vc")],
                    *[F.col(f"{o}_{s}").cast("long").alias(s) for s in ("nt", "nc")],
                )
                for o in outcomes
            ]
        )
    )
    se = F.sqrt(F.col("vt") / F.nullif(F.col("nt"), F.lit(0)) + F.col("vc") / F.nullif(F.col("nc"), F.lit(0)))
    diff = F.col("mt") - F.col("mc")
    return wide.select(rows.alias("r")).select("r.*").select(
        "outcome", F.col("mt").alias("exposed_mean"), F.col("mc").alias("holdout_mean"), diff.alias("diff"),
        (diff - Z_95 * se).alias("ci_low"), (diff + Z_95 * se).alias("ci_high"),
        ((Z_95 + Z_POWER) * se).alias("mde"), (F.abs(diff) > Z_95 * se).alias("is_significant"),
        F.col("nt").alias("n_exposed"), F.col("nc").alias("n_holdout"),
    )


def t_cdf(t: float, df: float) -> float:
    """Student's distribution function, for any degrees of freedom, from the incomplete beta function."""
    tail = _beta_share(df / (df + t * t), df / 2, 0.5) / 2
    return 1 - tail if t > 0 else tail


def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction, in the half where that converges fast."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    c, fraction, m = 1.0, d, 1
    while True:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        change = 1.0
        for term in (even, odd):
            d = 1 + term * d
            c = 1 + term / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            change = c * d
            fraction *= change
        if abs(change - 1) < 1e-15:
            return front * fraction
        m += 1


def t_quantile(p: float, df: float) -> float:
    low, high = -1e4, 1e4
    while t_cdf(high, df) < p:
        high *= 10
    while t_cdf(low, df) > p:
        low *= 10
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def student_quantile(p: float, n: Column) -> Column:
    """Student quantile for ``n - 1`` degrees of freedom; null for fewer than two. For a few result rows."""

    @F.pandas_udf("double")
    def run(counts: pd.Series) -> pd.Series:
        known = {d: t_quantile(p, d - 1) for d in counts.dropna().unique() if d > 1}
        return counts.map(known).astype("float64")

    return run(n.cast("long"))
