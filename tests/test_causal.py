"""Estimators find what was planted and nothing that was not."""

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder.causal import deal, did, uplift
from larder.causal.tree import CausalTree
from larder.functions import stats

rng = np.random.default_rng(5)


def panel(spark, effect=0.0, drift=0.0, level=0.0, seeds=8):
    rows = []
    for seed in range(seeds):
        for store in range(6):
            for d in range(-20, 20):
                treated, post = store % 2 == 0, d >= 0
                y = 50 + level * treated + drift * d * treated + effect * (treated and post) + rng.normal(0, 1)
                rows.append((seed, f"s{store}", d, post, treated, y, 1.0, 2.0, 3.0, 100.0, 60.0, 5.0))
    return spark.createDataFrame(
        rows, "seed int, store_id string, day_rel int, post boolean, treated boolean, units_expired double, writeoff_value double, units_lost double, "
        "units_sold double, revenue double, cogs double, markdown_subsidy double",
    )


def test_did_recovers_an_effect_and_ignores_a_level(spark):
    hit = did.estimate(panel(spark, effect=4.0, level=10.0), ["units_expired"]).first()
    # One draw in twenty falls outside its own interval, so the effect is compared, not covered.
    assert hit.effect == pytest.approx(4.0, abs=0.5) and hit.ci_low > 0 and hit.p_value < 1e-4 and hit.seeds == 8
    none = did.estimate(panel(spark, level=10.0), ["units_expired"]).first()
    assert abs(none.effect) < 0.5


def test_diverging_groups_are_caught(spark):
    bad = did.trends_are_parallel(did.pre_trend_gap(panel(spark, drift=0.5), ["units_expired"])).first()
    good = did.trends_are_parallel(did.pre_trend_gap(panel(spark), ["units_expired"])).first()
    assert not bad.parallel and bad.mean_gap == pytest.approx(0.5, abs=0.1) and good.parallel
    few = did.trends_are_parallel(did.pre_trend_gap(panel(spark, seeds=2), ["units_expired"])).first()
    assert not few.parallel and few.p_value is None


def test_repeated_runs_count_once(spark):
    p = panel(spark)
    assert did.with_margin(p.unionByName(p)).count() == p.count()


def test_readout_explains_what_it_does_not_measure(spark):
    rows = {r.metric: r for r in did.experiment_readout(panel(spark).drop("markdown_subsidy")).collect()}
    assert rows["markdown_subsidy_inr"].not_applicable_reason and rows["retention_90d"].policy_a is None
    assert rows["gm_awm_pct"].policy_a == pytest.approx((100 - 60 - 1) / 100)


def test_attribution_and_sensitivity(spark):
    full = panel(spark, effect=4.0)
    without = full.withColumn("units_expired", F.when(F.col("post") & F.col("treated"), F.col("units_expired") - 3.0).otherwise(F.col("units_expired")))
    got = {r.component: r.contribution for r in did.attribution(did.stack({"full": full, "a": without}, "component"), ["units_expired"]).collect()}
    assert got["a"] == pytest.approx(6.0, abs=0.5)
    swept = full.withColumns({"param": F.lit("p"), "value": F.explode(F.array(F.lit(1.0), F.lit(2.0)))})
    assert did.sensitivity(swept, ["units_expired"]).first().survives
    mixed = swept.filter((F.col("value") == 1.0) | (F.col("day_rel") < 10))
    with pytest.raises(ValueError):
        did.sensitivity(mixed, ["units_expired"])


def test_student_distribution():
    assert stats.t_quantile(0.975, 5) == pytest.approx(2.5705818, abs=1e-6)
    assert stats.t_quantile(0.975, 29) == pytest.approx(2.0452296, abs=1e-6)
    assert stats.t_cdf(0.0, 7) == pytest.approx(0.5) and stats.t_cdf(12.706, 1) == pytest.approx(0.975, abs=1e-4)


def test_welch_matches_by_hand(spark):
    a, b = rng.normal(3, 2, 200), rng.normal(1, 5, 60)
    df = spark.createDataFrame([("exposed", float(x)) for x in a] + [("holdout", float(x)) for x in b], "arm string, y double")
    r = stats.welch(df, "arm", "exposed", ["y"]).first()
    se = math.sqrt(a.var(ddof=1) / 200 + b.var(ddof=1) / 60)
    assert r.diff == pytest.approx(a.mean() - b.mean()) and r.ci_high - r.ci_low == pytest.approx(2 * 1.96 * se) and r.mde == pytest.approx(2.8 * se)


def customers(spark, n=4000, planted=True):
    x = rng.random(n)
    t = (rng.random(n) < 0.5).astype(int)
    effect = np.where(x > 0.6, 8.0, 0.0) if planted else 0.0
    pdf = pd.DataFrame({"customer_id": [f"c{i}" for i in range(n)], "treated": t, "x": x, "noise": rng.random(n), "margin_post": rng.normal(0, 1, n) + effect * t})
    return spark.createDataFrame(pdf), pdf


def test_tree_splits_where_the_effect_is(spark):
    df, pdf = customers(spark)
    tree = CausalTree(["noise", "x"], max_depth=2, min_per_arm=50).fit(df, "margin_post")
    assert tree.nodes[1].feature == "x" and tree.nodes[1].threshold == pytest.approx(0.6, abs=0.06)
    got = tree.predict(df).toPandas()
    assert got[got.x > 0.75].uplift.mean() == pytest.approx(8.0, abs=0.6) and abs(got[got.x < 0.5].uplift.mean()) < 0.6


def test_tree_refuses_leaves_that_are_too_small(spark):
    df, _ = customers(spark, 400)
    assert CausalTree(["x"], min_per_arm=500).fit(df, "margin_post").leaves() == [1]


def reference_qini(score, t, y, ids):
    order = np.lexsort((ids, -score))
    t, y = t[order], y[order]
    ct, cc = np.cumsum(t), np.cumsum(1 - t)
    gain = np.cumsum(y * t) - np.where(cc > 0, np.cumsum(y * (1 - t)) * ct / np.maximum(cc, 1), 0)
    f = np.arange(1, len(t) + 1) / len(t)
    return gain, np.trapezoid(gain, f) - np.trapezoid(gain[-1] * f, f)


@pytest.mark.parametrize("tied", [False, True])
def test_qini_matches_the_definition(spark, tied):
    df, pdf = customers(spark, 900)
    pdf["customer_id"] = [f"c{i:04d}" for i in range(900)]
    pdf["margin_post"] = pdf.margin_post.round(2)
    pdf["uplift"] = (pdf.x > 0.6).astype(float) if tied else pdf.x
    curve = uplift.gain_curve(spark.createDataFrame(pdf))
    gain, want = reference_qini(pdf.uplift.to_numpy(), pdf.treated.to_numpy(), pdf.margin_post.to_numpy(), pdf.customer_id.to_numpy())
    got = uplift.qini(curve).first()
    assert got.coefficient == pytest.approx(want, rel=1e-9) and want > 0
    rows = {r.targeted: r for r in uplift.targeting_curve(curve).collect()}
    assert rows[0.1].gain == pytest.approx(gain[90]) and rows[1.0].vs_random == pytest.approx(0.0, abs=1e-6)


ITEMS = "order_id string, customer_id string, store_id string, sku_id string, date_day date, promo_id string, signed_qty int, net_revenue double, cogs double, gross_margin double"


def test_assigned_customers_without_orders_are_zeros(spark):
    items = spark.createDataFrame([("o", "c1", "S", "K", date(2025, 7, 2), deal.DEAL, 2, 22.0, 30.0, -8.0)], ITEMS)
    exposure = spark.createDataFrame([("c1", "exposed"), ("c2", "exposed"), ("c3", "holdout")], "customer_id string, deal_arm string")
    rows = {r.customer_id: (r.orders, r.deal_margin) for r in deal.per_customer(items, exposure).collect()}
    assert rows == {"c1": (1, -8.0), "c2": (0, 0.0), "c3": (0, 0.0)}
    pnl = deal.deal_pnl(items).first()
    assert pnl.price_is_right and pnl.margin == -8.0


def test_event_study_keeps_only_stores_visited_once(spark):
    start = date(2025, 5, 1)
    prices = spark.createDataFrame(
        [("S", "once", start, start + timedelta(2), deal.DEAL), ("S", "twice", start, start + timedelta(2), deal.DEAL),
         ("S", "twice", start + timedelta(60), start + timedelta(61), deal.DEAL)],
        "store_id string, sku_id string, effective_from_date date, effective_to_date date, promo_id string",
    )
    daily = spark.createDataFrame(
        [("S", k, start + timedelta(d), 12 if d in (0, 1) else 4, d == 3) for k in ("once", "twice") for d in range(-30, 30)],
        "store_id string, sku_id string, date_day date, units_sold int, is_censored boolean",
    )
    got = deal.event_panel(prices, daily).collect()
    assert {r.sku_id for r in got} == {"once"}
    assert sorted(r.rel_day for r in got) == sorted([-7, -6, -5, -4, -3, -2, -1, 0, 0, 1, 3, 4, 5, 6, 7])
    s = deal.event_summary(deal.event_panel(prices, daily)).first()
    assert (s.blocks, s.in_block_lift, s.net_cannibalisation) == (1, 16.0, 0.0)
