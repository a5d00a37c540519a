"""Distributed orderings against pandas, with one key or value holding a third of the rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from larder.functions import ordered
from larder.plans.showcase import basket_pairs

rng = np.random.default_rng(7)


def test_running_sum_is_the_same_for_a_hot_key_whatever_the_slices(spark):
    n = 900
    pdf = pd.DataFrame({"k": np.where(np.arange(n) % 3 == 0, "hot", (np.arange(n) % 50).astype(str)), "seq": rng.permutation(n), "v": rng.integers(-5, 9, n)})
    df = spark.createDataFrame(pdf)
    want = pdf.sort_values("seq").assign(want=lambda d: d.groupby("k").v.cumsum()).set_index("seq").want
    for width in (1, 37, 10_000):
        got = ordered.running_sum(df, ["k"], F.floor(F.col("seq") / width), ["seq"], "v", "r").toPandas().set_index("seq").r
        assert (got.sort_index() == want.sort_index()).all()
    before = ordered.running_sum(df, ["k"], F.floor(F.col("seq") / 37), ["seq"], "v", "r", inclusive=False).toPandas()
    assert (before.set_index("seq").r.sort_index() == (want - pdf.set_index("seq").v).sort_index()).all()


def test_global_running_splits_ties(spark):
    n = 600
    pdf = pd.DataFrame({"id": np.arange(n), "score": np.where(np.arange(n) % 3 == 0, 1.0, rng.random(n).round(2)), "v": rng.integers(0, 5, n)})
    got = ordered.global_running(spark.createDataFrame(pdf), [F.desc("score"), F.asc("id")], {"r": F.col("v")}, slices=7).toPandas()
    want = pdf.sort_values(["score", "id"], ascending=[False, True]).assign(r=lambda d: d.v.cumsum()).set_index("id").r
    assert (got.set_index("id").r.sort_index() == want.sort_index()).all()


def test_fifth_scores_equal_cume_dist(spark):
    pdf = pd.DataFrame({"id": range(503), "x": np.where(np.arange(503) % 3 == 0, 4, rng.integers(0, 40, 503))})
    df = spark.createDataFrame(pdf)
    starts = ordered.quantile_starts(df, ["x", "id"], 5)
    got = df.withColumn("s", ordered.quantile_score(F.col("x"), starts["x"])).toPandas()
    assert starts["id"] == [float(int(503 * k / 5)) for k in range(1, 5)]
    cume = pdf.x.rank(method="max") / len(pdf)
    assert (got.sort_values("id").s.to_numpy() == np.ceil(5 * cume - 1e-12).to_numpy()).all()


def test_exact_median(spark):
    for values in ([3.0], [1.0, 2.0, 2.0, 9.0], [5.0, 1.0, 7.0, 2.0, 2.0], rng.random(100).tolist()):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        assert ordered.exact_median(df, "x", "m").first().m == float(np.median(values))


def test_first_arrival_and_latest(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 1, 2), ("b", None, 5), ("b", None, 4)], "k string, v int, t int")
    assert sorted(ordered.first_arrival(df, ["k", "v"], "t").collect()) == [("a", 1, 2), ("b", None, 4)]
    assert sorted(ordered.latest_per_key(df, ["k"], ["t"]).collect()) == [("a", 1, 3), ("b", None, 5)]


def test_pairs_of_a_huge_basket_are_complete(spark):
    rows = [("big", f"s{i:03d}") for i in range(100)] + [(f"o{i}", s) for i in range(30) for s in ("s001", "s002", "rare" + str(i))]
    df = spark.createDataFrame(rows, "order_id string, sku_id string")
    got = {(r.sku_a, r.sku_b): r.orders_with_both for r in basket_pairs(df, 2, large_basket=10, salts=8).collect()}
    assert got == {("s001", "s002"): 31}
    everything = basket_pairs(df, 1, large_basket=10, salts=8)
    assert everything.count() == 100 * 99 // 2 + 30 * 2


def test_latest_per_key_takes_ties_nulls_and_repeats(spark):
    rows = [("a", 1, None, "x"), ("a", 2, 5, "y"), ("a", 2, 7, "z"), ("b", None, 1, "n"), (None, 3, 1, "k"), (None, 3, 1, "k"), ("c", 4, 2, "p"), ("c", 4, 2, "q")]
    df = spark.createDataFrame(rows, "key string, day int, no int, what string")
    got = {r.key: (r.day, r.no, r.what) for r in ordered.latest_per_key(df, ["key"], ["day", "no"]).collect()}
    assert got == {"a": (2, 7, "z"), "b": (None, 1, "n"), None: (3, 1, "k"), "c": (4, 2, "q")}


def test_plans_copy_no_lines_and_sort_no_inputs(warehouse):
    from larder.causal.deal import uplift_panel
    from larder.operators.dimensions import dim_customer
    from larder.operators.facts import fct_order

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    orders = fct_order(warehouse("stg_pos__orders"), warehouse("fct_order_item"))
    panel = uplift_panel(warehouse("fct_order_item"), warehouse("dim_customer"), warehouse("stg_crm__deal_exposure"))
    assert "Expand" not in plan(orders) and "Expand" not in plan(panel)
    assert "SortAggregate" not in plan(dim_customer(warehouse("stg_crm__customers")))
