"""Forecasting: rolling-origin backtest, origin-anchored features, a fitted demand model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.decisions import boosting
from larder.functions.columns import positive_ratio
from larder.functions.ranges import expand_days
from larder.params import Params

SERIES = ["store_id", "sku_id"]
LAGS = (7, 14, 28)
SEASON_DAYS = 7
BASELINE_NAME = "moving_average_7d"
MODEL_NAME = "glm_tweedie"
BOOSTED_NAME = "boosted_tweedie"
NEVER_SOLD = 999

NUMERIC = [
    "horizon_days", "demand_at_origin", "roll_mean_7", "roll_mean_28", "roll_std_7", "zero_share_28",
    "days_since_last_sale", *[f"lag_{n}" for n in LAGS], "discount_pct", "day_of_week",
]
FLAGS = ["is_weekend", "is_salary_week", "is_monsoon", "is_festival", "is_ipl_window", "is_month_end", "is_on_promo"]
CATEGORICAL = ["store_id", "l1_category", "abc_class", "xyz_class"]


def _last_day(daily: DataFrame):
    return daily.agg(F.max("date_day")).scalar()


def eval_origins(daily: DataFrame, p: Params) -> DataFrame:
    """Forecast origins walking back from the last day with a whole horizon of actuals."""
    steps = daily.sparkSession.range(p.eval_origin_count).withColumn("last", _last_day(daily))
    back = (F.lit(p.max_horizon_days) + F.col("id") * p.eval_origin_step_days).cast("int")
    return steps.select(F.date_sub("last", back).alias("origin_date"))


def train_origins(daily: DataFrame, p: Params, step_days: int = 7) -> DataFrame:
    """Weekly origins with enough history, ending a horizon before the first evaluated one."""
    first = daily.agg(F.min("date_day")).scalar()
    lead = (p.eval_origin_count - 1) * p.eval_origin_step_days + 2 * p.max_horizon_days
    bounds = daily.sparkSession.range(1).select(
        F.date_add(first, p.train_history_days).alias("a"), F.date_sub(_last_day(daily), lead).alias("b")
    ).filter("a <= b")
    return bounds.select(F.explode(F.expr(f"sequence(a, b, interval {step_days} days)")).alias("origin_date"))


def _targets(origins: DataFrame, p: Params) -> DataFrame:
    ahead = origins.withColumn("horizon_days", F.explode(F.sequence(F.lit(1), F.lit(p.max_horizon_days))))
    return ahead.withColumn("date_day", F.date_add("origin_date", F.col("horizon_days")))


def moving_average(daily: DataFrame, origins: DataFrame, p: Params) -> DataFrame:
    """Mean demand of the week ending at each origin: an equality join on the days of that week."""
    week = origins.withColumn(
        "date_day", F.explode(F.sequence(F.date_sub("origin_date", p.trailing_window_days - 1), "origin_date"))
    )
    return (
        daily.select(*SERIES, "date_day", "units_demanded_imputed")
        .join(F.broadcast(week), "date_day")
        .groupBy("origin_date", *SERIES)
        .agg(F.avg("units_demanded_imputed").alias("forecast_units"))
    )


def backtest(daily: DataFrame, products: DataFrame, p: Params) -> DataFrame:
    """``mart_forecast_accuracy``: baseline and seasonal-naive, scored on days that were not censored.

    Origins times horizons is a fixed small table, so it is the broadcast side; everything else
    joins on the series.
    """
    origins = eval_origins(daily, p)
    season = daily.select(
        *SERIES, F.date_add("date_day", SEASON_DAYS).alias("date_day"), F.col("units_demanded_imputed").alias("naive")
    )
    actual = daily.filter(~F.col("is_censored")).select(*SERIES, "date_day", F.col("units_sold").alias("actual_units"))
    baseline = moving_average(daily, origins, p)
    days = _targets(origins, p).select("date_day").distinct()
    return (
        actual.join(F.broadcast(days), "date_day", "left_semi")
        .join(season.join(F.broadcast(days), "date_day", "left_semi"), [*SERIES, "date_day"], "left")
        .join(F.broadcast(_targets(origins, p)), "date_day")
        .join(baseline, ["origin_date", *SERIES], "left")
        .join(products.select("sku_id", "abc_class", "xyz_class", "abc_xyz_class"), "sku_id")
        .withColumns(
            {
                "forecast_units": F.coalesce("forecast_units", F.lit(0.0)),
                "baseline_units": F.coalesce("forecast_units", F.lit(0.0)),
                "naive_units": F.coalesce("naive", F.lit(0.0)),
                "model_name": F.lit(BASELINE_NAME),
            }
        )
        .drop("naive")
    )


def accuracy_report(accuracy: DataFrame, by: str = "abc_xyz_class") -> DataFrame:
    """WAPE, naive WAPE, bias and value added per class or per horizon; ratios of sums."""
    actual, forecast, naive = F.col("actual_units"), F.col("forecast_units"), F.col("naive_units")
    total = F.nullif(F.sum(actual).cast("double"), F.lit(0.0))
    wape, naive_wape = F.sum(F.abs(actual - forecast)) / total, F.sum(F.abs(actual - naive)) / total
    return accuracy.groupBy(by).agg(
        F.count("*").alias("cells"), F.sum(actual).alias("actual_units"), wape.alias("wape"), naive_wape.alias("naive_wape"),
        (F.sum(forecast - actual) / total).alias("bias"), (naive_wape - wape).alias("fva"),
    )


def feature_frame(
    daily: DataFrame, prices: DataFrame, calendar: DataFrame, products: DataFrame, origins: DataFrame, p: Params
) -> DataFrame:
    """One row per series, origin and horizon; everything but calendar and price is as at the origin.

    Rolling state and the target's lags are calendar-range windows over one partitioning of the
    daily table, so no lag costs a join.
    """
    ordinal = F.datediff("date_day", F.lit("1970-01-01").cast("date"))
    series = Window.partitionBy(*SERIES).orderBy("ordinal")
    demand = F.col("units_demanded_imputed")

    def last(days: int):
        return series.rangeBetween(-(days - 1), 0)

    sold_on = F.max(F.when(demand > 0, F.col("date_day"))).over(series.rangeBetween(Window.unboundedPreceding, 0))
    state = daily.withColumn("ordinal", ordinal).select(
        *SERIES, "date_day", "units_sold", "is_censored", demand.alias("demand"),
        F.avg(demand).over(last(7)).alias("roll_mean_7"),
        F.avg(demand).over(last(28)).alias("roll_mean_28"),
        F.coalesce(F.stddev_samp(demand).over(last(7)), F.lit(0.0)).alias("roll_std_7"),
        F.avg(F.when(demand == 0, 1.0).otherwise(0.0)).over(last(28)).alias("zero_share_28"),
        F.coalesce(F.datediff("date_day", sold_on), F.lit(NEVER_SOLD)).alias("days_since_last_sale"),
        *[F.coalesce(F.max(demand).over(series.rangeBetween(-n, -n)), F.lit(0.0)).alias(f"lag_{n}") for n in LAGS],
    )
    targets = F.broadcast(_targets(origins, p))
    anchor = state.select(
        *SERIES, F.col("date_day").alias("origin_date"), F.col("demand").alias("demand_at_origin"), "roll_mean_7",
        "roll_mean_28", "roll_std_7", "zero_share_28", "days_since_last_sale",
    ).join(F.broadcast(origins), "origin_date", "left_semi")
    target = state.select(
        *SERIES, "date_day", F.col("demand").alias("target_demand"), "units_sold", "is_censored", *[f"lag_{n}" for n in LAGS]
    ).join(targets, "date_day")
    posted = (
        expand_days(prices, F.col("effective_from_date"), F.col("effective_to_date"), "date_day")
        .groupBy(*SERIES, "date_day")
        .agg(F.max("discount_pct").alias("discount_pct"), F.max(F.col("promo_id").isNotNull()).alias("is_on_promo"))
    )
    return (
        target.join(anchor, [*SERIES, "origin_date"])
        .join(posted, [*SERIES, "date_day"], "left")
        .fillna(0.0, ["discount_pct"])
        .fillna(False, ["is_on_promo"])
        .join(
            calendar.select(
                "date_day", "day_of_week", "is_weekend", "is_salary_week", "is_monsoon", "is_festival", "is_ipl_window", "is_month_end"
            ),
            "date_day",
        )
        .join(products.select("sku_id", "l1_category", "abc_class", "xyz_class", "abc_xyz_class"), "sku_id")
    )


def baseline_forecast(daily: DataFrame, p: Params) -> DataFrame:
    """``mart_demand_forecast`` of the moving average: flat over the horizon."""
    origins = eval_origins(daily, p)
    flat = moving_average(daily, origins, p)
    return _targets(flat, p).withColumn("model_name", F.lit(BASELINE_NAME))


def train_demand(training: DataFrame):
    """A Tweedie regression with log link on the training features.

    Stores enter through their mean demand, so the design is as wide as the category lists, not
    as the number of stores.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    short = ["l1_category", "abc_class", "xyz_class"]
    index = StringIndexer(inputCols=short, outputCols=[f"{c}_ix" for c in short], handleInvalid="keep")
    encode = OneHotEncoder(inputCols=[f"{c}_ix" for c in short], outputCols=[f"{c}_oh" for c in short])
    inputs = [*NUMERIC, *[f"{f}_n" for f in FLAGS], "store_mean", *[f"{c}_oh" for c in short]]
    assemble = VectorAssembler(inputCols=inputs, outputCol="features")
    model = GeneralizedLinearRegression(
        family="tweedie", variancePower=1.1, linkPower=0.0, labelCol="target_demand", featuresCol="features",
        maxIter=25, regParam=1e-3,
    )
    means = training.groupBy("store_id").agg(F.avg("target_demand").alias("store_mean"))
    fitted = Pipeline(stages=[index, encode, assemble, model]).fit(_numeric_flags(training).join(means, "store_id"))
    return fitted, means


def _numeric_flags(features: DataFrame) -> DataFrame:
    return features.withColumns({f"{f}_n": F.col(f).cast("double") for f in FLAGS})


def predict_demand(fitted, means: DataFrame, features: DataFrame) -> DataFrame:
    scored = fitted.transform(_numeric_flags(features).join(means, "store_id"))
    return scored.select(
        *SERIES, "date_day", "origin_date", "horizon_days",
        F.greatest(F.lit(0.0), F.col("prediction")).alias("forecast_units"), F.lit(MODEL_NAME).alias("model_name"),
    )


def train_boosted(training: DataFrame, **shape) -> boosting.Booster | None:
    """Boosted trees on the same features; stores are categories of their own."""
    return boosting.fit(training, "target_demand", [*NUMERIC, *FLAGS], CATEGORICAL, **shape)


def predict_boosted(fitted: boosting.Booster | None, features: DataFrame) -> DataFrame:
    """As ``predict_demand``; without a model no row."""
    if fitted is None:
        scored = features.limit(0).withColumn("forecast_units", F.lit(0.0))
    else:
        scored = features.withColumn("forecast_units", fitted.predict(features))
    return scored.select(*SERIES, "date_day", "origin_date", "horizon_days", "forecast_units", F.lit(BOOSTED_NAME).alias("model_name"))


def forecast_value(accuracy: DataFrame, regression: DataFrame) -> DataFrame:
    """The accuracy report of the served model by class, with the regression's error beside it."""
    report = accuracy_report(accuracy)
    other = accuracy_report(regression).select("abc_xyz_class", F.col("wape").alias("regression_wape"))
    return report.join(other, "abc_xyz_class")


def swap_forecast(accuracy: DataFrame, forecast: DataFrame) -> DataFrame:
    """The model's numbers where it has one; the baseline and its name stay elsewhere."""
    keys = [*SERIES, "date_day", "origin_date", "horizon_days"]
    better = forecast.select(*keys, F.col("forecast_units").alias("new"), F.col("model_name").alias("new_name"))
    return (
        accuracy.join(better, keys, "left")
        .withColumns(
            {"forecast_units": F.coalesce("new", "forecast_units"), "model_name": F.coalesce("new_name", "model_name")}
        )
        .drop("new", "new_name")
    )


def fit_dispersion(accuracy: DataFrame) -> DataFrame:
    """One row, one column ``k``: the spread the forecast's own errors show; null means Poisson."""
    sums = accuracy.agg(
        F.avg("actual_units").alias("a"), F.var_samp(F.col("actual_units") - F.col("forecast_units")).alias("v"),
        F.avg("forecast_units").alias("f"),
    )
    return sums.select(positive_ratio(F.pow("f", F.lit(2.0)), F.col("v") - F.col("a")).alias("k"))
