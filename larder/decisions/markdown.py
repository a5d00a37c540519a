"""Markdown depth per at-risk batch: a price grid, its concave frontier, a budget per store."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.ordered import running_sum
from larder.functions.ranges import band_of
from larder.sources.seeds import DTE_BANDS
from larder.workspace import Workspace, cut_lineage

DEPTHS = [round(0.05 * i, 2) for i in range(13)]
BUDGET_PER_STORE_DAY = 1000.0
# Why a batch gets no depth.
NOT_ESTIMATED = "no slope was fitted for this category and freshness band"
NO_SLOPE = "the fitted slope cannot be told from zero"
NO_HEADROOM = "no price fits between cost and the one already posted"


def posted_prices(prices: DataFrame, as_of: Column) -> DataFrame:
    """Lowest posted and highest base price in force on one day, half-open intervals."""
    return (
        prices.filter((F.col("effective_from_date") <= as_of) & (F.col("effective_to_date") > as_of))
        .groupBy("store_id", "sku_id")
        .agg(F.min("realized_price").alias("posted_price"), F.max("base_price").alias("posted_base"))
    )


def priced_batches(risk: DataFrame, prices: DataFrame, products: DataFrame) -> DataFrame:
    """Batches at risk with their freshness band, list price and the price posted that day."""
    as_of = risk.agg(F.max("date_day")).scalar()
    at_risk = risk.filter((F.col("risk_state") == "at_risk") & (F.col("qty_remaining") > 0)).withColumn(
        "dte_band", band_of(F.col("days_to_expiry"), DTE_BANDS)
    )
    return (
        at_risk.join(products.select("sku_id", F.col("base_price").alias("list_price")), "sku_id")
        .join(posted_prices(prices, as_of), ["store_id", "sku_id"], "left")
        .withColumns(
            {"base_price": F.coalesce("posted_base", "list_price"), "posted_price": F.coalesce("posted_price", "list_price")}
        )
        .drop("posted_base", "list_price")
    )


def markdown_decisions(risk: DataFrame, prices: DataFrame, products: DataFrame, elasticity: DataFrame) -> DataFrame:
    slopes = elasticity.select("l1_category", "dte_band", "elasticity_raw", "is_identified", "elasticity_basis")
    return priced_batches(risk, prices, products).join(slopes, ["l1_category", "dte_band"], "left")


def evaluate(decisions: DataFrame, beta: Column, depths=DEPTHS, disposal_cost: float = 0.0) -> DataFrame:
    """Demand, units, margin and spend of every feasible price of every batch.

    A price above the posted one or below landed cost is not a candidate. Older stock sells
    first, so the batch sells only what demand leaves after the queue ahead of it.
    """
    now = F.col("posted_price") / F.col("base_price")
    r, base, cost, q = F.col("price_ratio"), F.col("base_price"), F.col("unit_landed_cost"), F.col("qty_remaining")
    grid = decisions.filter("base_price > 0").withColumn(
        "price_ratio", F.explode(F.array(*[F.lit(round(1.0 - d, 2)) for d in depths]))
    )
    feasible = grid.filter((r <= now + 1e-9) & (r * base >= cost))
    ahead = F.col("units_ahead_in_queue")
    priced = feasible.withColumns(
        {"now": now, "demand": F.col("horizon_demand_mean") * F.pow(r / now, beta)}
    ).withColumns(
        {
            "batch_sold": F.least(F.greatest(F.col("demand") - ahead, F.lit(0.0)), q.cast("double")),
            "total_sold": F.least(F.col("demand"), (ahead + q).cast("double")),
        }
    )
    return priced.withColumns(
        {
            "depth": F.round(1.0 - r, 4),
            "price": base * r,
            "margin": F.col("total_sold") * (base * r - cost) - (q - F.col("batch_sold")) * (cost + disposal_cost),
            "spend": F.col("total_sold") * base * (F.col("now") - r),
        }
    ).drop("now")


POINT = ["spend", "margin", "depth", "price", "batch_sold"]


def concave_frontier(points: DataFrame) -> DataFrame:
    """Per batch, the points of its upper concave hull in order of spend, as an array ``steps``.

    At most one point per depth, so the array is short and every comparison stays in one row.
    """
    ordered = F.array_sort(F.collect_list(F.struct(*POINT)))
    curves = points.groupBy("store_id", "batch_id").agg(
        ordered.alias("points"),
        F.max_by(F.struct("depth"), F.struct(F.col("margin"), (-F.col("depth")).alias("shallow"))).alias("best"),
    )

    def slope_at_least(a: Column, b: Column, i: Column) -> Column:
        """slope(a, b) >= slope(a, i), with flat runs kept finite."""
        run_b = F.greatest(b["spend"] - a["spend"], F.lit(1e-9))
        run_i = F.greatest(i["spend"] - a["spend"], F.lit(1e-9))
        return (b["margin"] - a["margin"]) * run_i >= (i["margin"] - a["margin"]) * run_b

    rises = F.filter(
        "points",
        lambda x, n: (n == 0)
        | ~F.exists(F.slice(F.col("points"), F.lit(1), n), lambda e: e["margin"] >= x["margin"]),
    )
    hull = F.filter(
        "rises",
        lambda x, n: (n == 0)
        | ~F.exists(
            F.slice(F.col("rises"), F.lit(1), n),
            lambda a: F.exists(
                F.slice(F.col("rises"), n + 2, F.size("rises")), lambda b: slope_at_least(a, b, x)
            ),
        ),
    )
    return curves.withColumn("rises", rises).withColumn("steps", hull).select(
        "store_id", "batch_id", "steps", F.col("best.depth").alias("unconstrained_depth")
    )


def allocate(frontier: DataFrame, budget: float) -> DataFrame:
    """Steps taken per batch: best margin per rupee first, within each store's budget.

    A step that does not fit is passed over and ends its batch; later, cheaper steps may still
    fit. Each round takes, in every store at once, the longest affordable run of steps in order
    and drops what can no longer fit; spending only grows, so a dropped step stays dropped. Every
    round but the last buys a step in some store or ends batches, so there are at most as many rounds as
    the fullest store has steps; what a round buys is written to a table, so plans do not grow.
    """
    space, rounds = Workspace(frontier.sparkSession, f"markdown {uuid.uuid4()}"), []
    opening = frontier.groupBy("store_id").agg(F.sum(F.element_at("steps", 1)["spend"]).alias("spent"))
    exploded = frontier.select("store_id", "batch_id", F.posexplode("steps").alias("step", "s")).select(
        "store_id", "batch_id", "step", "s.spend", "s.margin"
    )
    chain = Window.partitionBy("store_id", "batch_id").orderBy("step")
    steps = exploded.withColumns(
        {
            "cost": F.col("spend") - F.lag("spend").over(chain),
            "gain": F.col("margin") - F.lag("margin").over(chain),
        }
    ).filter("step > 0").withColumn("ratio", F.col("gain") / F.greatest("cost", F.lit(1e-9)))
    open_steps = cut_lineage(steps.filter("gain > 0 and cost > 0"))
    spent = cut_lineage(opening)
    while True:
        fitting = open_steps.join(spent, "store_id").withColumn("left", F.lit(budget) - F.col("spent"))
        # A batch stops at its first step that cannot fit.
        blocked = F.max(F.when(F.col("cost") > F.col("left"), 1).otherwise(0)).over(
            chain.rowsBetween(Window.unboundedPreceding, 0)
        )
        live = fitting.withColumn("blocked", blocked).filter("blocked = 0").drop("blocked")
        bought = running_sum(
            live.withColumn("worth", -F.col("ratio")), ["store_id"], F.floor(F.log2(F.col("ratio")) * -8),
            ["worth", "batch_id", "step"], "cost", "upto",
        )
        bought = cut_lineage(bought)
        now = space.write(bought.filter("upto <= left").select("store_id", "batch_id", "step", "cost"), f"round_{len(rounds)}")
        if now.isEmpty():
            break
        rounds.append(space.path(f"round_{len(rounds)}"))
        open_steps = bought.filter("upto > left").select("store_id", "batch_id", "step", "cost", "gain", "ratio")
        spent = cut_lineage(spent.unionByName(now.select("store_id", F.col("cost").alias("spent"))).groupBy("store_id").agg(F.sum("spent").alias("spent")))
    if not rounds:
        return frontier.select("store_id", "batch_id", F.lit(0).alias("position"))
    taken = frontier.sparkSession.read.schema(now.schema).parquet(*rounds)
    reached = taken.groupBy("store_id", "batch_id").agg(F.max("step").alias("position"))
    return frontier.select("store_id", "batch_id").join(reached, ["store_id", "batch_id"], "left").fillna(0, ["position"])


def optimise(decisions: DataFrame, budget: float = BUDGET_PER_STORE_DAY, disposal_cost: float = 0.0) -> DataFrame:
    """``rec_markdown``: a depth for every at-risk batch, or the reason there is none.

    Only a cell that measured its own downward slope is priced, at its raw coefficient.
    """
    usable = F.coalesce("is_identified", F.lit(False)) & F.col("elasticity_raw").isNotNull()
    split = cut_lineage(decisions.withColumn("beta", F.when(usable, F.col("elasticity_raw"))))
    frontier = cut_lineage(concave_frontier(evaluate(split.filter("beta is not null"), F.col("beta"), disposal_cost=disposal_cost)))
    chosen = frontier.join(allocate(frontier, budget), ["store_id", "batch_id"])
    picked, hold = F.element_at("steps", F.col("position") + 1), F.element_at("steps", 1)
    results = chosen.select(
        "store_id", "batch_id", picked["depth"].alias("recommended_depth"), picked["price"].alias("recommended_price"),
        "unconstrained_depth", (picked["depth"] < F.col("unconstrained_depth") - 1e-9).alias("is_budget_constrained"),
        picked["batch_sold"].alias("expected_units_sold"), picked["spend"].alias("expected_markdown_spend"),
        picked["margin"].alias("expected_margin"), (picked["margin"] - hold["margin"]).alias("margin_vs_do_nothing"),
    )
    joined = split.join(results, ["store_id", "batch_id"], "left")
    priced = F.col("recommended_price").isNotNull()
    zeros = [
        "recommended_depth", "unconstrained_depth", "expected_units_sold", "expected_markdown_spend", "expected_margin",
        "margin_vs_do_nothing",
    ]
    return joined.withColumns(
        {
            "decline_reason": F.when(priced, F.lit(None).cast("string"))
            .when(F.col("elasticity_raw").isNull(), NOT_ESTIMATED)
            .when(F.col("beta").isNull(), NO_SLOPE)
            .otherwise(NO_HEADROOM),
            "decision": F.when(~priced, "no_recommendation")
            .when(F.col("recommended_price") < F.col("posted_price") - 1e-9, "markdown")
            .otherwise("hold_price"),
            "elasticity_used": F.when(priced, F.col("beta")),
            "elasticity_basis": F.when(priced, F.lit("cell")).otherwise(F.col("elasticity_basis")),
            "recommended_price": F.coalesce("recommended_price", "posted_price"),
            "is_budget_constrained": F.coalesce("is_budget_constrained", F.lit(False)),
            **{z: F.coalesce(z, F.lit(0.0)) for z in zeros},
        }
    ).drop("beta")


def depth_profile(
    batches: DataFrame, beta: Column, daily_demand: float = 12.0, qty: float = 120.0, base_price: float = 100.0, cost: float = 60.0
) -> DataFrame:
    """Best depth of one standard batch for each row's days to expiry and coefficient."""
    standard = batches.withColumns(
        {
            "base_price": F.lit(base_price), "posted_price": F.lit(base_price), "unit_landed_cost": F.lit(cost),
            "qty_remaining": F.lit(qty), "units_ahead_in_queue": F.lit(0.0),
            "horizon_demand_mean": F.lit(daily_demand) * F.greatest("days_to_expiry", F.lit(1)),
        }
    )
    keys = batches.columns
    curve = evaluate(standard, beta)
    best = F.max_by(F.struct("depth", "margin"), F.struct(F.round("margin", 9), (-F.col("depth")).alias("d"))).alias("b")
    return curve.groupBy(*keys).agg(best).select(*keys, F.col("b.depth").alias("depth"), F.col("b.margin").alias("margin"))


def check_monotonicity(days: DataFrame, beta: float = -1.6) -> DataFrame:
    """Depth against days to expiry at a fixed daily rate and an elastic coefficient."""
    return depth_profile(days.select("days_to_expiry").distinct(), F.lit(beta))


def measured_depth_profile(decisions: DataFrame) -> DataFrame:
    """The same batch under each cell's fitted coefficient; cells without a slope have no depth."""
    cells = decisions.filter("elasticity_raw is not null").groupBy("l1_category", "dte_band").agg(
        F.min("days_to_expiry").alias("days_to_expiry"), F.first("elasticity_raw").alias("elasticity"),
        F.first("is_identified").alias("is_identified"),
    )
    fitted = depth_profile(cells.filter("is_identified"), F.col("elasticity"))
    return fitted.unionByName(cells.filter("not is_identified"), allowMissingColumns=True)
