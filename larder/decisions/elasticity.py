"""Price elasticity by category and freshness: a panel, and Poisson fits of all cells at once."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.ranges import band_of, expand_days
from larder.sources.seeds import DTE_BANDS
from larder.workspace import Workspace, cut_lineage

SERIES = ["store_id", "sku_id"]
UNDISCOUNTED = 0.99
MIN_PRICE_RATIO = 0.15
MIN_UNDISCOUNTED_DAYS = 10
MIN_POOLED_DISCOUNTED = 200
MIN_CELL_DISCOUNTED = 30
POOLED = "*"
DESIGN = ["intercept", "log_price", "days_to_expiry", "log_on_hand", "is_weekend", "is_festival", "is_salary_week"]


def elasticity_panel(
    movements: DataFrame, batches: DataFrame, products: DataFrame, calendar: DataFrame, daily: DataFrame, prices: DataFrame
) -> DataFrame:
    """Stocked, uncensored store-SKU-days with the posted price and freshness on offer."""
    moved = movements.groupBy("batch_id", "date_day").agg(F.sum("qty_delta").alias("delta"))
    life = Window.partitionBy("batch_id").orderBy("date_day").rowsBetween(Window.unboundedPreceding, 0)
    on_offer = (
        moved.withColumn("on_hand", F.sum("delta").over(life))
        .filter("on_hand > 0")
        .join(batches.select("batch_id", *SERIES, "expiry_date"), "batch_id")
        .groupBy(*SERIES, "date_day")
        .agg(F.min(F.datediff("expiry_date", "date_day")).alias("days_to_expiry"), F.sum("on_hand").alias("units_on_hand"))
    )
    posted = (
        expand_days(prices, F.col("effective_from_date"), F.col("effective_to_date"), "date_day")
        .groupBy(*SERIES, "date_day").agg(F.min("realized_price").alias("posted"))
    )
    rows = (
        daily.filter(~F.col("is_censored")).select(*SERIES, "date_day", "units_sold")
        .join(on_offer, [*SERIES, "date_day"])
        .join(posted, [*SERIES, "date_day"], "left")
        .join(products.select("sku_id", "l1_category", "abc_class", "base_price"), "sku_id")
        .join(calendar.select("date_day", "is_weekend", "is_festival", "is_salary_week"), "date_day")
        .withColumn("price_ratio", F.coalesce("posted", "base_price") / F.nullif("base_price", F.lit(0.0)))
        .withColumn("dte_band", band_of(F.col("days_to_expiry"), DTE_BANDS))
    )
    series = Window.partitionBy(*SERIES)
    regular = F.round("price_ratio", 9) >= UNDISCOUNTED
    return (
        rows.withColumns(
            {
                "baseline_units": F.avg(F.when(regular, F.col("units_sold"))).over(series),
                "undiscounted_days": F.count(F.when(regular, 1)).over(series),
            }
        )
        .filter(F.round("price_ratio", 9).between(MIN_PRICE_RATIO, 1.0))
        .filter((F.col("baseline_units") > 0) & (F.col("undiscounted_days") >= MIN_UNDISCOUNTED_DAYS))
        .drop("posted", "base_price")
    )


def _design(panel: DataFrame) -> DataFrame:
    """Each row once for its category and once for its cell, with the regressors as doubles."""
    discounted = F.round("price_ratio", 9) < UNDISCOUNTED
    return panel.select(
        "l1_category",
        F.explode(F.array(F.lit(POOLED), F.col("dte_band"))).alias("dte_band"),
        F.concat_ws("|", *SERIES).alias("cluster"),
        F.greatest(F.col("units_sold").cast("double"), F.lit(0.0)).alias("y"),
        F.log("baseline_units").alias("offset"),
        discounted.alias("discounted"),
        F.lit(1.0).alias("intercept"),
        F.log("price_ratio").alias("log_price"),
        F.col("days_to_expiry").cast("double").alias("days_to_expiry"),
        F.log(F.col("units_on_hand") + 1.0).alias("log_on_hand"),
        *[F.col(f).cast("double").alias(f) for f in ("is_weekend", "is_festival", "is_salary_week")],
    ).filter("dte_band is not null")


CELL = ["l1_category", "dte_band"]


PAIRS = [(i, j) for i in range(len(DESIGN)) for j in range(i, len(DESIGN))]
PRICE = DESIGN.index("log_price")
_STATE = (
    "l1_category string, dte_band string, n long, n_discounted long, clusters long, used array<boolean>, beta array<double>, status string"
)
_STATE_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def _matrix(sums) -> np.ndarray:
    m = np.zeros((len(DESIGN), len(DESIGN)))
    for (i, j), v in zip(PAIRS, sums, strict=True):
        m[i, j] = m[j, i] = v
    return m


def _newton(tolerance: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One Newton step for each cell that is still being fitted, from its own sums."""
        for part in parts:
            betas, status = [], []
            for r in part.itertuples(index=False):
                beta, now = np.array(r.beta, float), r.status
                if now == "fitting":
                    used = np.flatnonzero(r.used)
                    cross, score = _matrix(r.cross)[np.ix_(used, used)], np.array(r.score)[used]
                    try:
                        step = np.linalg.solve(cross, score)
                    except np.linalg.LinAlgError:
                        step, now = np.zeros(len(used)), "singular"
                    if not np.isfinite(step).all():
                        step, now = np.zeros(len(used)), "diverged"
                    # A capped step keeps the first moves from overshooting; the optimum is unchanged.
                    largest = np.abs(step).max()
                    beta[used] += step * min(1.0, 2.0 / largest) if largest > 0 else 0.0
                    now = "fitted" if now == "fitting" and largest < tolerance else now
                betas.append(beta)
                status.append(now)
            yield part[_STATE_NAMES].assign(beta=betas, status=status)

    return run


def _errors(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Clustered standard error of the price slope of each fitted cell."""
    for part in parts:
        found = []
        for r in part.itertuples(index=False):
            used = np.flatnonzero(r.used)
            inverse = np.linalg.pinv(_matrix(r.cross)[np.ix_(used, used)])
            correction = r.clusters / (r.clusters - 1) * (r.n - 1) / max(r.n - len(used), 1)
            cov = correction * inverse @ _matrix(r.meat)[np.ix_(used, used)] @ inverse
            at = int(np.flatnonzero(used == PRICE)[0])
            found.append((r.l1_category, r.dte_band, float(np.sqrt(max(cov[at, at], 0.0)))))
        yield pd.DataFrame(found, columns=["l1_category", "dte_band", "se"])


def fit_cells(panel: DataFrame, iterations: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """Poisson fits with an offset and clustered errors, all cells in each Spark aggregate.

    Every iteration is one grouped sum of weighted cross products; the small systems, one per category
    and band, are solved in tasks and their coefficients stay a written table. Controls that do not
    vary inside a cell are left out of its design. Every cell has a row: ``status`` says ``fitted``, or
    why there is no slope (``too_few_discounts``, ``one_cluster``, ``singular``, ``diverged``, ``not_converged``).
    """
    space = Workspace(panel.sparkSession, f"elasticity {uuid.uuid4()}")
    data = cut_lineage(_design(panel))
    clusters = data.select(*CELL, "cluster").distinct().groupBy(*CELL).agg(F.count("*").alias("clusters"))
    ranges = data.groupBy(*CELL).agg(
        F.count("*").alias("n"), F.count(F.when(F.col("discounted"), 1)).alias("n_discounted"),
        F.array(*[F.lit(x in ("intercept", "log_price")) | (F.min(x) != F.max(x)) for x in DESIGN]).alias("used"),
    )
    need = F.when(F.col("dte_band") == POOLED, MIN_POOLED_DISCOUNTED).otherwise(MIN_CELL_DISCOUNTED)
    start = F.when(F.col("n_discounted") < need, "too_few_discounts").when(F.col("clusters") < 2, "one_cluster").otherwise("fitting")
    state = ranges.join(clusters, CELL).select(
        *CELL, "n", "n_discounted", "clusters", "used", F.array_repeat(F.lit(0.0), len(DESIGN)).alias("beta"), start.alias("status")
    )
    eta = F.col("offset")
    for i, x in enumerate(DESIGN):
        eta = eta + F.col("beta")[i] * F.col(x)

    def fitted(cells: DataFrame) -> DataFrame:
        return data.join(cells.select(*CELL, "beta"), CELL).withColumn("mu", F.exp(eta))

    cross = F.array(*[F.sum(F.col("mu") * F.col(DESIGN[i]) * F.col(DESIGN[j])) for i, j in PAIRS]).alias("cross")
    score = F.array(*[F.sum((F.col("y") - F.col("mu")) * F.col(x)) for x in DESIGN]).alias("score")
    state = space.write(state, "round_0")
    for n in range(1, iterations + 1):
        sums = fitted(state.filter("status = 'fitting'")).groupBy(*CELL).agg(cross, score)
        state = space.write(state.join(sums, CELL, "left").mapInPandas(_newton(tolerance), _STATE), f"round_{n}")
        if state.filter("status = 'fitting'").isEmpty():
            break
    state = state.withColumn("status", F.when(F.col("status") == "fitting", "not_converged").otherwise(F.col("status")))
    rows = fitted(state.filter("status = 'fitted'"))
    bread = rows.groupBy(*CELL).agg(cross)
    residuals = [F.sum((F.col("y") - F.col("mu")) * F.col(x)).alias(f"s_{i}") for i, x in enumerate(DESIGN)]
    outer = F.array(*[F.sum(F.col(f"s_{i}") * F.col(f"s_{j}")) for i, j in PAIRS]).alias("meat")
    meat = rows.groupBy(*CELL, "cluster").agg(*residuals).groupBy(*CELL).agg(outer)
    parts = state.join(bread, CELL).join(meat, CELL)
    errors = parts.mapInPandas(_errors, "l1_category string, dte_band string, se double")
    slope = F.when(F.col("status") == "fitted", F.col("beta")[PRICE])
    return state.join(errors, CELL, "left").select(*CELL, "n", "n_discounted", slope.alias("beta"), "se", "status", F.col("beta").alias("coefficients"))


def estimate(panel: DataFrame) -> DataFrame:
    """``mart_price_elasticity``: a cell's own slope, its category's, or none, never a guess. Cells without a
    fit, and cells of categories without one, stay with their ``status``."""
    fits = fit_cells(panel).drop("coefficients")
    pooled = fits.filter(F.col("dte_band") == POOLED).select(
        "l1_category", F.col("beta").alias("category_elasticity"), F.col("se").alias("category_standard_error"),
        F.col("n").alias("category_observations"), F.col("status").alias("category_status"),
    )
    gap = F.pow(F.col("beta") - F.col("category_elasticity"), 2)
    spread = gap + F.pow(F.col("se"), 2)
    return (
        fits.filter(F.col("dte_band") != POOLED)
        .join(pooled, "l1_category", "left")
        .withColumns(
            {
                "is_identified": F.coalesce(F.col("beta") + 1.96 * F.col("se") < 0, F.lit(False)),
                "category_is_identified": F.coalesce(F.col("category_elasticity") + 1.96 * F.col("category_standard_error") < 0, F.lit(False)),
                # Without a pooled slope there is nothing to shrink to: a cell keeps its own.
                "signal_weight": F.when(F.col("category_elasticity").isNull() & F.col("beta").isNotNull(), 1.0)
                .when(spread > 0, gap / spread).otherwise(0.0),
            }
        )
        .withColumn(
            "elasticity_shrunk",
            F.col("signal_weight") * F.col("beta") + (1 - F.col("signal_weight")) * F.coalesce("category_elasticity", F.lit(0.0)),
        )
        .withColumns(
            {
                "elasticity": F.when(F.col("is_identified"), F.col("elasticity_shrunk")).when(
                    F.col("category_is_identified"), F.col("category_elasticity")
                ),
                "elasticity_basis": F.when(F.col("is_identified"), "cell")
                .when(F.col("category_is_identified"), "category")
                .otherwise("none"),
            }
        )
        .withColumnsRenamed(
            {"n": "observations", "n_discounted": "discounted_observations", "beta": "elasticity_raw", "se": "standard_error"}
        )
    )
