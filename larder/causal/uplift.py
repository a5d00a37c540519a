"""Who responds: learners of individual effects, and curves that judge them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.functions.ordered import global_running

NUMERIC = [
    "is_member", "tenure_days", "orders_pre", "margin_pre", "revenue_pre", "units_pre", "skus_pre", "active_days_pre",
    "promo_units_pre", "recency_pre", "promo_share_pre", "basket_pre",
]
CATEGORICAL = ["acquisition_channel", "device"]
SEED = 42
TEST_TENTHS = 3


def split(panel: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training and scoring customers by a hash of their id: the same split on every run."""
    tenth = F.pmod(F.xxhash64("customer_id", F.lit(SEED)), F.lit(10))
    return panel.filter(tenth >= TEST_TENTHS), panel.filter(tenth < TEST_TENTHS)


def _features(train: DataFrame):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    index = StringIndexer(inputCols=CATEGORICAL, outputCols=[f"{c}_ix" for c in CATEGORICAL], handleInvalid="keep")
    store = StringIndexer(inputCol="home_store_id", outputCol="store_ix", handleInvalid="keep", stringOrderType="alphabetAsc")
    gather = VectorAssembler(inputCols=[*NUMERIC, *[f"{c}_ix" for c in CATEGORICAL], "store_ix"], outputCol="features")
    return Pipeline(stages=[index, store, gather]).fit(train)


def _regress(train: DataFrame, outcome: str):
    """Boosted trees; for a 0/1 outcome the regression is a probability model."""
    from pyspark.ml.regression import GBTRegressor

    return GBTRegressor(
        featuresCol="features", labelCol=outcome, maxIter=20, maxDepth=3, stepSize=0.1, minInstancesPerNode=20, seed=SEED,
    ).fit(train)


def _predict(model, df: DataFrame, name: str) -> DataFrame:
    return model.setPredictionCol(name).transform(df)


KEPT = ["customer_id", "treated", "margin_post", "churned"]


def t_learner(train: DataFrame, score: DataFrame, outcome: str) -> DataFrame:
    """One model per arm, differenced."""
    ready = _features(train)
    fit, out = ready.transform(train).cache(), ready.transform(score)
    for arm, name in ((1, "mu1"), (0, "mu0")):
        out = _predict(_regress(fit.filter(F.col("treated") == arm), outcome), out, name)
    fit.unpersist()
    return out.select(*KEPT, (F.col("mu1") - F.col("mu0")).alias("uplift"))


def x_learner(train: DataFrame, score: DataFrame, outcome: str) -> DataFrame:
    """Impute each customer's other outcome from the opposite arm's model, then model the effect."""
    ready = _features(train)
    fit = ready.transform(train).cache()
    t, c = fit.filter("treated = 1"), fit.filter("treated = 0")
    mu1, mu0 = _regress(t, outcome), _regress(c, outcome)
    tau1 = _regress(_predict(mu0, t, "mu").withColumn("effect", F.col(outcome) - F.col("mu")), "effect")
    tau0 = _regress(_predict(mu1, c, "mu").withColumn("effect", F.col("mu") - F.col(outcome)), "effect")
    share = fit.agg(F.avg("treated")).first()[0]
    fit.unpersist()
    out = _predict(tau0, _predict(tau1, ready.transform(score), "tau1"), "tau0")
    return out.select(*KEPT, (F.lit(share) * F.col("tau0") + F.lit(1.0 - share) * F.col("tau1")).alias("uplift"))


def transformed_outcome(train: DataFrame, score: DataFrame, outcome: str) -> DataFrame:
    """One model of ``y (t - p) / (p (1 - p))``, whose mean given the features is the effect."""
    ready = _features(train)
    share = train.agg(F.avg("treated")).first()[0]
    if not 0.0 < share < 1.0:
        raise ValueError("one arm is empty")
    star = F.col(outcome) * (F.col("treated") - share) / (share * (1.0 - share))
    model = _regress(ready.transform(train).withColumn("star", star), "star")
    return _predict(model, ready.transform(score), "uplift").select(*KEPT, "uplift")


def two_stage(train: DataFrame, score: DataFrame, outcome: str, clusters: int = 6) -> DataFrame:
    """Cluster by behaviour before assignment; every customer gets their cluster's effect."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    stages = [
        VectorAssembler(inputCols=NUMERIC, outputCol="raw"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True),
        KMeans(k=clusters, seed=SEED, featuresCol="scaled", predictionCol="cluster"),
    ]
    model = Pipeline(stages=stages).fit(train)
    t = F.when(F.col("treated") == 1, F.col(outcome))
    c = F.when(F.col("treated") == 0, F.col(outcome))
    effect = (F.avg(t) - F.avg(c)).alias("effect")
    overall = train.agg(effect).scalar()
    effects = model.transform(train).groupBy("cluster").agg(effect)
    return model.transform(score).join(effects, "cluster", "left").select(
        *KEPT, F.coalesce("effect", overall).alias("uplift")
    )


def gain_curve(scored: DataFrame, outcome: str = "margin_post") -> DataFrame:
    """Cumulative incremental outcome by descending uplift; ties break on the customer.

    The running sums come from one range partitioning of a narrow projection, so no task sees
    more than its slice of the ranking, and tied scores split across slices too.
    """
    t, y = F.col("treated").cast("double"), F.col("y")
    narrow = scored.select("customer_id", "uplift", "treated", F.round(F.col(outcome).cast("double"), 2).alias("y"))
    ranked = global_running(
        narrow,
        [F.desc("uplift"), F.asc("customer_id")],
        {"position": F.lit(1), "n_t": t, "n_c": 1 - t, "y_t": y * t, "y_c": y * (1 - t)},
    )
    scaled = F.when(F.col("n_c") > 0, F.col("y_c") * F.col("n_t") / F.col("n_c")).otherwise(0.0)
    return ranked.select("customer_id", "uplift", F.col("position").cast("long"), (F.col("y_t") - scaled).alias("gain"))


def qini(curve: DataFrame) -> DataFrame:
    """Area between the gain curve and the straight line to its end, by the trapezoid rule.

    Positions are evenly spaced, so both areas are plain sums over the curve.
    """
    sums = curve.agg(
        F.count("*").alias("n"), F.sum("gain").alias("total"), F.min_by("gain", "position").alias("first"),
        F.max_by("gain", "position").alias("last"),
    )
    n = F.col("n").cast("double")
    return sums.withColumns(
        {
            "area": (F.col("total") - (F.col("first") + F.col("last")) / 2) / n,
            "random_area": F.col("last") * (n * n - 1) / (2 * n * n),
        }
    ).select("n", "area", "random_area", (F.col("area") - F.col("random_area")).alias("coefficient"))


FRACTIONS = (0.1, 0.2, 0.3, 0.5, 1.0)


def targeting_curve(curve: DataFrame, fractions=FRACTIONS) -> DataFrame:
    """Gain from targeting the top share, and how far it is above a random share of that size."""
    ends = curve.agg(F.count("*").alias("n"), F.max_by("gain", "position").alias("final"))
    wanted = ends.withColumn("targeted", F.explode(F.array(*[F.lit(f) for f in fractions]))).withColumn(
        "position", F.least(F.floor(F.col("targeted") * F.col("n")) + 1, F.col("n"))
    )
    # A handful of positions against the curve: the wanted side is as long as ``fractions``.
    return curve.join(F.broadcast(wanted), "position").select(
        "targeted", "gain", (F.col("gain") - F.col("final") * F.col("position") / F.col("n")).alias("vs_random")
    )
