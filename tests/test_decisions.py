"""Decision jobs against brute force."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder.decisions import boosting, delivery, elasticity, markdown, replenish, slots, transfers
from larder.functions import negbin

rng = np.random.default_rng(11)


def pmf(i, mu, k):
    if k is None:
        return math.exp(-mu + i * math.log(mu) - math.lgamma(i + 1))
    p = k / (k + mu)
    return math.exp(math.lgamma(i + k) - math.lgamma(k) - math.lgamma(i + 1) + k * math.log(p) + i * math.log(1 - p))


@pytest.mark.parametrize("k", [None, 0.7, 5.0])
def test_leftover_and_risk(spark, k):
    cases = [(0, 2.0), (1, 0.5), (7, 3.0), (30, 12.5), (5, 0.0)]
    df = spark.createDataFrame([(q, m, k) for q, m in cases], "q bigint, m double, k double")
    got = df.select(negbin.leftover_and_risk(F.col("q"), F.col("m"), F.col("k")).alias("x")).select("x.*").collect()
    for (q, m), r in zip(cases, got, strict=True):
        mu = max(m, 1e-9)
        assert r.leftover == pytest.approx(sum((q - i) * pmf(i, mu, k) for i in range(q)), abs=1e-9)
        assert r.risk == pytest.approx(sum(pmf(i, mu, k) for i in range(q)), abs=1e-9)


def exact_leftover(q, mu, k):
    """Sums in logarithms over all of the demand that matters; the rest of the stock is left over whole."""
    stop = min(q, int(mu + 60 * math.sqrt(mu + (0 if k is None else mu * mu / k)) + 200))
    terms = [math.exp(-mu + i * math.log(mu) - math.lgamma(i + 1)) if k is None else pmf(i, mu, k) for i in range(stop)]
    return math.fsum((q - i) * t for i, t in enumerate(terms)), math.fsum(terms)


@pytest.mark.parametrize("k", [None, 3.0])
def test_leftover_of_large_stock(spark, k):
    cases = [(q, float(m)) for q in (401, 1000, 50_000) for m in (350, 900, 5000)]
    df = spark.createDataFrame([(q, m, k) for q, m in cases], "q bigint, m double, k double")
    got = df.select(negbin.leftover_and_risk(F.col("q"), F.col("m"), F.col("k")).alias("x")).select("x.*").collect()
    for (q, m), r in zip(cases, got, strict=True):
        left, risk = exact_leftover(q, m, k)
        assert r.leftover == pytest.approx(left, rel=1e-6, abs=1e-6) and r.risk == pytest.approx(risk, abs=1e-7)


def huge_poisson(q, mu):
    """Probabilities relative to the mode's, 45 deviations to each side: what lies further is below rounding."""
    i = np.arange(max(0, int(mu - 45 * math.sqrt(mu) - 50)), int(mu + 45 * math.sqrt(mu) + 50), dtype=float)
    logs = np.cumsum(np.log(mu / np.maximum(i, 1)))
    weight = np.exp(logs - logs.max())
    weight /= weight.sum()
    return float((np.maximum(q - i, 0) * weight).sum()), float(weight[i < q].sum())


def huge_negative_binomial(q, mu, k):
    """For whole k: fewer than q failures before k successes means at least k successes in q + k - 1 trials."""

    def below(n, k):
        trials, miss = n + k - 1, -math.log1p(whole / mu)
        ways = [math.fsum(math.log((trials - i) / (i + 1)) for i in range(j)) for j in range(k)]
        return 1 - math.fsum(math.exp(w - j * math.log1p(mu / whole) + (trials - j) * miss) for j, w in enumerate(ways))

    whole = k
    return q * below(q, k) - mu * below(q - 1, k + 1), below(q, k)


@pytest.mark.parametrize("k", [None, 1, 3, 40])
def test_leftover_of_any_stock_and_demand(spark, k):
    cases = [(q, m) for q in (300, 5_000, 9_990_000, 10_000_000, 10_003_000, 10**9) for m in (2_000.0, 1e7)]
    df = spark.createDataFrame([(q, m, None if k is None else float(k)) for q, m in cases], "q bigint, m double, k double")
    got = df.select(negbin.leftover_and_risk(F.col("q"), F.col("m"), F.col("k")).alias("x")).select("x.*").collect()
    for (q, m), r in zip(cases, got, strict=True):
        left, risk = huge_poisson(q, m) if k is None else huge_negative_binomial(q, m, k)
        assert r.risk == pytest.approx(risk, abs=2e-7)
        assert r.leftover == pytest.approx(left, rel=1e-6, abs=2e-6 * m)


@pytest.mark.parametrize("k", [None, 0.1, 0.7, 5.0, 200.0, 1e7])
def test_sum_and_integral_agree(spark, k):
    """Both ways over the same stock, on either side of the demand and where the shapes change places."""
    cases = [(q, m, k) for q in (1, 2, 7, 60, 199, 200, 201, 256) for m in (0.05, 1.0, 8.0, 60.0, 190.0)]
    given = F.struct(
        F.col("q").cast("double").alias("q"), F.col("m").alias("mu"), F.col("k").alias("k"), F.col("q").cast("double").alias("stop"),
        F.when(F.col("k").isNull(), -F.col("m")).otherwise(-F.col("k") * F.log1p(F.col("m") / F.col("k"))).alias("first"),
    )
    df = spark.createDataFrame(cases, "q bigint, m double, k double")
    got = df.select("q", "m", negbin._let(given, negbin._summed).alias("s"), negbin._let(given, negbin._integrated).alias("i")).collect()
    for r in got:
        assert r.i.risk == pytest.approx(r.s.risk, abs=1e-10), (r.q, r.m)
        assert r.i.leftover == pytest.approx(r.s.leftover, rel=1e-9, abs=1e-8), (r.q, r.m)


def test_leftover_of_nothing(spark):
    df = spark.createDataFrame([(None, 3.0, None), (0, 3.0, 2.0), (-4, 3.0, None), (5, None, 2.0), (10**9, None, None)], "q bigint, m double, k double")
    got = df.select(negbin.leftover_and_risk(F.col("q"), F.col("m"), F.col("k")).alias("x")).select("x.*").collect()
    assert [(r.leftover, r.risk) for r in got[1:3]] == [(0.0, 0.0)] * 2
    assert [r.leftover for r in got[3:]] == pytest.approx([5.0, 1e9])


@pytest.mark.parametrize("k", [np.inf, 0.8, 6.0])
def test_quantile_is_the_first_value_to_reach_it(k):
    mean, q = np.array([0.2, 3.0, 40.0, 900.0]), np.array([0.5, 0.95, 0.01, 0.9])
    x = negbin.quantile(mean, k, q)
    assert (negbin.cdf(x, mean, k) >= q - 1e-12).all()
    assert ((x == 0) | (negbin.cdf(x - 1, mean, k) < q)).all()


@pytest.mark.parametrize("k", [np.inf, 0.8, 6.0])
def test_a_quantile_of_large_demand_takes_a_bounded_number_of_steps(k, monkeypatch):
    steps, step = [], negbin._log_step
    monkeypatch.setattr(negbin, "_log_step", lambda *given: steps.append(1) or step(*given))
    mean, q = np.array([3.0, 8e3, 2e4, 2e4]), np.array([0.95, 1e-6, 0.5, 0.95])
    x = negbin.quantile(mean, k, q)
    below, tail = negbin.cdf(x, mean, k), negbin.cdf(np.array([-1.0, 9e9, 5e4, 6e3]), mean, k)
    assert len(steps) <= 2 * (4096 + 1)
    monkeypatch.setattr(negbin, "WALKED_UNITS", 10**9, raising=False)
    assert (x == negbin.quantile(mean, k, q)).all()
    assert below == pytest.approx(negbin.cdf(x, mean, k), abs=1e-9)
    assert tail == pytest.approx(negbin.cdf(np.array([-1.0, 9e5, 5e4, 6e3]), mean, k), abs=1e-9)
    assert np.isfinite(negbin.quantile(np.full(3, 1e9), k, np.array([1e-6, 0.5, 1 - 1e-9]))).all()


def batches(n=40, stores=3):
    base = rng.uniform(20, 90, n).round(2)
    return pd.DataFrame({
        "batch_id": [f"b{i:02d}" for i in range(n)], "store_id": [f"s{i % stores}" for i in range(n)], "base_price": base,
        "posted_price": (base * rng.choice([1.0, 0.9], n)).round(2), "unit_landed_cost": (base * rng.uniform(0.2, 0.6, n)).round(2),
        "qty_remaining": rng.integers(1, 60, n), "units_ahead_in_queue": rng.integers(0, 10, n), "horizon_demand_mean": rng.uniform(0.5, 30, n).round(3),
    })


def hull(points):
    points = points.sort_values(["spend", "margin"]).to_dict("records")
    kept = [points[0]]
    for p in points[1:]:
        if p["margin"] <= kept[-1]["margin"]:
            continue
        while len(kept) > 1:
            a, b = kept[-2], kept[-1]
            new = (p["margin"] - a["margin"]) / max(p["spend"] - a["spend"], 1e-9)
            if new >= (b["margin"] - a["margin"]) / max(b["spend"] - a["spend"], 1e-9):
                kept.pop()
            else:
                break
        kept.append(p)
    return kept


@pytest.mark.parametrize("budget", [0.0, 150.0, 1e9])
def test_frontier_and_budget_match_a_plain_greedy(spark, budget):
    df = spark.createDataFrame(batches())
    points = markdown.evaluate(df, F.lit(-2.4))
    curves = {b: hull(g) for b, g in points.select("batch_id", "store_id", *markdown.POINT).toPandas().groupby("batch_id")}
    frontier = markdown.concave_frontier(points)
    got = {r.batch_id: [s.depth for s in r.steps] for r in frontier.collect()}
    assert got == {b: [p["depth"] for p in c] for b, c in curves.items()}
    want = {}
    for store in ("s0", "s1", "s2"):
        mine = {b: c for b, c in curves.items() if c[0]["store_id"] == store}
        at, spent = dict.fromkeys(mine, 0), sum(c[0]["spend"] for c in mine.values())
        while True:
            options = []
            for b, c in mine.items():
                if at[b] + 1 < len(c):
                    gain, cost = c[at[b] + 1]["margin"] - c[at[b]]["margin"], c[at[b] + 1]["spend"] - c[at[b]]["spend"]
                    if gain > 0 and cost > 0 and spent + cost <= budget:
                        options.append((gain / cost, b, cost))
            if not options:
                break
            _, b, cost = max(options)
            at[b] += 1
            spent += cost
        want |= at
    assert {r.batch_id: r.position for r in markdown.allocate(frontier, budget).collect()} == want
    assert budget == 0.0 or any(want.values())


def test_prices_stay_between_cost_and_posted(spark):
    rows = markdown.evaluate(spark.createDataFrame(batches()), F.lit(-1.2)).toPandas()
    assert (rows.price >= rows.unit_landed_cost - 1e-9).all() and (rows.price <= rows.posted_price + 1e-6).all()
    assert (rows.batch_sold <= rows.qty_remaining + 1e-9).all() and (rows.spend >= -1e-6).all()


def test_depth_rises_as_time_runs_out(spark):
    days = spark.createDataFrame([(d,) for d in range(1, 8)], "days_to_expiry int")
    depth = [r.depth for r in markdown.check_monotonicity(days).orderBy("days_to_expiry").collect()]
    assert depth == sorted(depth, reverse=True) and depth[0] > depth[-1]


def test_batches_without_a_slope_say_why(spark):
    pdf = batches(4)
    df = spark.createDataFrame(pdf).withColumns({
        "elasticity_raw": F.when(F.col("batch_id") != "b00", F.lit(-0.5)), "is_identified": F.col("batch_id").isin("b02", "b03"),
        "elasticity_basis": F.lit("none"),
        "unit_landed_cost": F.when(F.col("batch_id") == "b03", F.lit(1e6)).otherwise(F.col("unit_landed_cost")),
    })
    got = {r.batch_id: (r.decision, r.decline_reason) for r in markdown.optimise(df).collect()}
    assert got["b00"] == ("no_recommendation", markdown.NOT_ESTIMATED) and got["b01"] == ("no_recommendation", markdown.NO_SLOPE)
    assert got["b02"] == ("hold_price", None) and got["b03"] == ("no_recommendation", markdown.NO_HEADROOM)


def test_slots_match_every_combination(spark):
    n = 60
    pdf = pd.DataFrame({
        "date_day": pd.Timestamp("2025-01-01").date(), "store_id": [f"s{i % 3}" for i in range(n)], "sku_id": [f"k{i:02d}" for i in range(n)],
        "l2_subcategory": [f"c{rng.integers(0, 8)}" for _ in range(n)], "is_private_label": [bool(i % 6 == 0 and i % 3 != 2) for i in range(n)],
        "slot_value": rng.normal(5, 20, n).round(3),
    })
    pdf.loc[(pdf.store_id == "s1"), "is_private_label"] = pdf.index[pdf.store_id == "s1"] % 4 == 0
    got = slots.deal_allocate(spark.createDataFrame(pdf)).toPandas()
    for store, g in pdf.groupby("store_id"):
        best = max(
            (
                sum(r.slot_value for r in combo)
                for size in range(4)
                for combo in itertools.combinations(g.itertuples(), size)
                if len({r.l2_subcategory for r in combo}) == size and sum(r.is_private_label for r in combo) >= 1
            ),
            default=None,
        )
        mine = got[got.store_id == store]
        if best is None:
            assert mine.solver_status.tolist() == ["Infeasible"] and mine.sku_id.isna().all()
        else:
            assert mine.slot_value.sum() == pytest.approx(best)


def arcs(spark):
    rows = []
    for a, b in itertools.permutations("ABCD", 2):
        km = float(rng.integers(1, 9))
        for sku in ("x", "y", "z"):
            rows.append((pd.Timestamp("2025-01-01").date(), a, b, sku, "n", "c", km, 3.0, 5, 4.8, int(rng.integers(6, 40)), 30.0, 10.0, 40.0, 45.0, 38.0))
    return spark.createDataFrame(
        rows, "date_day date, from_store string, to_store string, sku_id string, sku_name string, l1_category string, km double, transit_hours double, "
        "days_to_expiry int, sellable_days double, arc_cap int, unit_landed_cost double, unit_margin double, unit_benefit double, units_at_risk double, unmet_units double",
    )


def test_transfers_are_feasible_and_every_trip_pays(spark):
    plan = transfers.transfer_plan(arcs(spark)).toPandas()
    assert len(plan) and (plan.units >= transfers.MIN_UNITS).all() and (plan.units <= plan.arc_cap).all()
    assert (plan.groupby(["from_store", "sku_id"]).units.sum() <= 45).all() and (plan.groupby(["to_store", "sku_id"]).units.sum() <= 38).all()
    assert (plan.groupby(["from_store", "to_store"]).net_benefit.sum() > 0).all()
    assert plan.groupby(["from_store", "to_store"]).agg({"trip_cost_share": "sum", "trip_cost": "first"}).apply(lambda r: math.isclose(*r), axis=1).all()


def test_a_plan_stays_below_its_bound(spark):
    some = arcs(spark).cache()
    plan = transfers.transfer_plan(some).cache()
    r = transfers.plan_bound(some, plan).first()
    assert r.value == pytest.approx(plan.toPandas().net_benefit.sum()) and r.value <= r.bound <= r.opening_bound
    assert r.value >= 0.75 * r.bound  # the gap is that of the prices (whole loads, fixed trips) and the plan
    none = transfers.plan_bound(some, transfers.transfer_plan(some, fixed_trip_cost=1e9), fixed_trip_cost=1e9).first()
    assert (none.value, none.bound) == (0.0, 0.0)


def best_plan(rows, trip):
    """The best value over all whole loads of one SKU, by trying every one."""
    best = 0.0

    def go(at, stock, need, value, vans):
        nonlocal best
        best = max(best, value)
        if at == len(rows):
            return
        a, b, cap, benefit = rows[at]
        for units in [0, *range(transfers.MIN_UNITS, min(cap, stock[a], need[b]) + 1)]:
            go(at + 1, {**stock, a: stock[a] - units}, {**need, b: need[b] - units}, value + units * benefit - (trip if units else 0), vans)

    go(0, {"A": 14, "B": 9}, {"C": 12, "D": 10}, 0.0, 0)
    return best


def test_plan_and_bound_enclose_the_best(spark):
    for seed in range(3):
        r = np.random.default_rng(seed)
        rows = [(a, b, int(r.integers(6, 13)), float(r.integers(20, 60))) for a in "AB" for b in "CD"]
        have, want = {"A": 14.0, "B": 9.0}, {"C": 12.0, "D": 10.0}
        table = spark.createDataFrame(
            [(a, b, "x", 2.0, cap, benefit, benefit, 0.0, have[a], want[b]) for a, b, cap, benefit in rows],
            "from_store string, to_store string, sku_id string, km double, arc_cap int, unit_benefit double, unit_landed_cost double, unit_margin double, "
            "units_at_risk double, unmet_units double",
        ).withColumns({c: F.lit(None).cast("string") for c in ("date_day", "sku_name", "l1_category", "transit_hours", "days_to_expiry", "sellable_days")})
        plan = transfers.transfer_plan(table, fixed_trip_cost=100.0)
        found = transfers.plan_bound(table, plan, fixed_trip_cost=100.0).first()
        best = best_plan(rows, 130.0)
        assert found.value <= best + 1e-9 <= found.bound + 2e-9 and found.value >= 0.6 * best


def test_a_long_chain_ends_within_the_passes(spark):
    """Each pair is better than the one before it, so taking mutual best pairs one after the other would take a round a store."""
    n = 1000
    table = spark.range(n).select(
        F.lit(None).cast("date").alias("date_day"), F.concat(F.lit("s"), "id").alias("from_store"), F.concat(F.lit("s"), F.col("id") + 1).alias("to_store"),
        F.lit("x").alias("sku_id"), F.lit("n").alias("sku_name"), F.lit("c").alias("l1_category"), F.lit(1.0).alias("km"), F.lit(1.0).alias("transit_hours"),
        F.lit(3).alias("days_to_expiry"), F.lit(2.0).alias("sellable_days"), F.lit(10).alias("arc_cap"), (40.0 + F.col("id") / 100).alias("unit_landed_cost"),
        F.lit(0.0).alias("unit_margin"), (40.0 + F.col("id") / 100).alias("unit_benefit"), F.lit(10.0).alias("units_at_risk"), F.lit(10.0).alias("unmet_units"),
    )
    plan = transfers.transfer_plan(table)
    r = transfers.plan_bound(table, plan, rounds=2).first()
    assert plan.count() == n and r.value == pytest.approx(r.bound)


def test_the_grid_finds_all_within_reach_and_few_beyond(spark):
    r = np.random.default_rng(5)
    for lat, lon in ((0.0, 0.0), (57.0, 179.9), (-89.0, 10.0), (88.9, -179.0)):
        spots = [(f"s{i}", "x", float(np.clip(lat + r.normal() * 2, -90, 90)), float((lon + r.normal() * 40 / max(0.05, math.cos(math.radians(lat)))) % 360 - 180)) for i in range(60)]
        reach = [float(r.choice([0.0, 3.0, 40.0, 300.0, 2500.0, 15000.0])) for _ in spots]
        a = spark.createDataFrame([(*s, d) for s, d in zip(spots, reach, strict=True)], "from_store string, sku_id string, lat_a double, lon_a double, reach double")
        b = spark.createDataFrame(spots, "to_store string, sku_id string, lat_b double, lon_b double")
        km = transfers.haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
        got = transfers.within_reach(a, b).filter(km < F.col("reach")).select("from_store", "to_store").collect()
        want = a.join(b, "sku_id").filter(km < F.col("reach")).select("from_store", "to_store").collect()
        assert sorted(got) == sorted(want)
    line = spark.range(5000).select(F.concat(F.lit("s"), "id").alias("store"), F.lit("x").alias("sku_id"), F.lit(19.0).alias("lat"), (F.col("id") * 0.02 - 50).alias("lon"))
    a = line.select(F.col("store").alias("from_store"), "sku_id", F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), F.lit(8.0).alias("reach"))
    b = line.select(F.col("store").alias("to_store"), "sku_id", F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"))
    assert transfers.within_reach(a, b).count() < 40 * 5000  # 25 million pairs without a grid


def test_boosted_trees_learn_the_mean_of_each_group(spark):
    r = np.random.default_rng(8)
    n = 4000
    pdf = pd.DataFrame({"a": r.normal(size=n), "b": r.integers(0, 3, n).astype(float), "s": [f"s{i}" for i in r.integers(0, 40, n)]})
    pdf.loc[::50, "a"] = np.nan
    odd = pdf["s"].str[1:].astype(int) % 7 < 2
    mean = np.where(odd, 6.0, 1.0) * np.where(pdf["a"] > 0.3, 2.0, 1.0)
    pdf["y"] = r.poisson(mean).astype(float)
    table = spark.createDataFrame(pdf.replace(np.nan, None).astype({"a": object}).where(lambda d: d.notna(), None), "a double, b double, s string, y double")
    model = boosting.fit(table, "y", ["a", "b"], ["s"], rounds=25, depth=3)
    got = table.select("a", "b", "s", "y", model.predict(table).alias("p")).toPandas()
    truth = np.where(got["s"].str[1:].astype(int) % 7 < 2, 6.0, 1.0) * np.where(got["a"].astype(float) > 0.3, 2.0, 1.0)
    assert np.abs(got["p"] - truth).mean() < 0.35 and (got["p"] > 0).all()
    assert got["p"].mean() == pytest.approx(got["y"].mean(), rel=0.02)
    assert model.trees[0].levels[0][0].feature == 2  # the stores, split as a set and not by their names
    unseen = spark.createDataFrame([(None, 1.0, "new")], "a double, b double, s string")
    assert unseen.select(model.predict(unseen).alias("p")).first().p > 0
    assert boosting.fit(table.limit(0), "y", ["a"], ["s"]) is None and boosting.fit(table.withColumn("y", F.lit(0.0)), "y", ["a"], ["s"]) is None


def test_tweedie_gradients_are_derivatives():
    power, raw, y = 1.1, np.array([-1.0, 0.2, 1.5]), np.array([0.0, 3.0, 1.0])
    loss = lambda f: -y * np.exp((1 - power) * f) / (1 - power) + np.exp((2 - power) * f) / (2 - power)
    g, h = boosting.gradients(y, raw, power)
    assert g == pytest.approx((loss(raw + 1e-5) - loss(raw - 1e-5)) / 2e-5, rel=1e-5)
    assert h == pytest.approx((loss(raw + 1e-4) - 2 * loss(raw) + loss(raw - 1e-4)) / 1e-8, rel=1e-3)


def test_the_best_split_is_that_of_all_subsets():
    r = np.random.default_rng(4)
    own = np.c_[r.normal(size=6), r.random(6) + 0.5, np.full(6, 50.0)]
    found = boosting.best_split(1, own, [0, 6], [False], 10)
    gain = lambda m: own[m, 0].sum() ** 2 / (own[m, 1].sum() + 1) + own[~m, 0].sum() ** 2 / (own[~m, 1].sum() + 1)
    every = [np.array(m) for m in itertools.product([False, True], repeat=6) if 0 < sum(m) < 6]
    assert gain(found.left) == pytest.approx(max(map(gain, every)), rel=0.05)


def test_no_trip_pays_means_no_transfer(spark):
    assert transfers.transfer_plan(arcs(spark), fixed_trip_cost=1e9).count() == 0


def test_distance_is_that_of_the_globe(spark):
    row = spark.range(1).select(transfers.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0)).alias("km")).first()
    assert row.km == pytest.approx(math.pi / 2 * 6371)


def test_order_up_to_is_a_fixed_point(spark):
    pdf = pd.DataFrame({
        "store_id": "S", "sku_id": [f"k{i}" for i in range(6)], "daily_forecast": [0.3, 2.0, 5.0, 8.0, 1.0, 4.0], "lead_days": 2.0, "mean_lead_days": 2.0,
        "shelf_life_days": [2, 3, 10, 1, 30, 5], "base_price": 20.0, "landed_cost": 12.0, "on_hand_units": [0, 1, 3, 0, 500, 2],
    })
    spread = spark.createDataFrame([(3.0,)], "k double")
    got = replenish.order_up_to(spark.createDataFrame(pdf), spread).toPandas()
    assert "k4" not in set(got.sku_id)
    ratio = 8.0 / (8.0 + 12.0 * got.p_spoil)
    assert (got.order_up_to <= got.shelf_life_cap).all() and (got.order_units >= 1).all()
    steady = got[(ratio - got.critical_ratio).abs() < 1e-9]
    assert len(steady) >= 3


def test_poisson_fits_match_newton_on_one_cell(spark):
    n = 800
    price = rng.choice([1.0, 1.0, 0.8, 0.6], n)
    pdf = pd.DataFrame({
        "store_id": [f"s{i % 20}" for i in range(n)], "sku_id": "k", "l1_category": "c", "dte_band": "7d+", "price_ratio": price,
        "days_to_expiry": rng.integers(7, 20, n), "units_on_hand": rng.integers(5, 80, n), "is_weekend": rng.random(n) < 0.3, "is_festival": False,
        "is_salary_week": rng.random(n) < 0.2, "baseline_units": 4.0,
    })
    pdf["units_sold"] = rng.poisson(4.0 * price**-1.5 * np.exp(0.1 * pdf.is_weekend))
    fits = {f["dte_band"]: f for f in elasticity.fit_cells(spark.createDataFrame(pdf)).filter("status = 'fitted'").collect()}
    x = np.column_stack([np.ones(n), np.log(price), pdf.days_to_expiry, np.log(pdf.units_on_hand + 1), pdf.is_weekend, pdf.is_salary_week]).astype(float)
    beta, y, off = np.zeros(6), pdf.units_sold.to_numpy(float), math.log(4.0)
    for _ in range(60):
        mu = np.exp(off + x @ beta)
        beta += np.clip(np.linalg.solve((x * mu[:, None]).T @ x, x.T @ (y - mu)), -1, 1)
    mu = np.exp(off + x @ beta)
    bread = np.linalg.inv((x * mu[:, None]).T @ x)
    scores = pd.DataFrame(x * (y - mu)[:, None]).groupby(pdf.store_id).sum().to_numpy()
    cov = 20 / 19 * (n - 1) / (n - 6) * bread @ (scores.T @ scores) @ bread
    assert fits["7d+"]["beta"] == pytest.approx(beta[1], abs=1e-6) and fits["7d+"]["se"] == pytest.approx(math.sqrt(cov[1, 1]), rel=1e-6)
    assert fits[elasticity.POOLED]["beta"] == pytest.approx(beta[1], abs=1e-6)


def test_crossover_cost(spark):
    people = spark.createDataFrame(
        [("high", 10, 100.0), ("low", 2, 60.0), ("medium", 1, 1.0)], "ddi_band string, orders_90d int, gross_margin_90d double"
    )
    sweep = delivery.delivery_cost_sweep(people)
    assert delivery.crossover(sweep, "high", "low").first().crossover_cost == 6.0
    assert delivery.crossover(sweep, "low", "medium").first().crossover_cost == 60.0
