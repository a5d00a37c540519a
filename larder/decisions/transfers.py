"""Moving stock that will expire where it is to a store that ran out of it."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.workspace import Workspace, cut_lineage

SPEED_KMH = 18.0
HANDLING_HOURS = 2.0
COST_PER_KM = 15.0
FIXED_TRIP_COST = 300.0
MIN_UNITS = 6
LOOKBACK_DAYS = 7
EARTH_KM = 6371.0
KM_A_DEGREE = math.pi * EARTH_KM / 180
PASSES = 12
BOUND_ROUNDS = 12


def haversine_km(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    half_lat, half_lon = F.sin(F.radians(lat_b - lat_a) / 2), F.sin(F.radians(lon_b - lon_a) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_lon * half_lon
    return F.asin(F.sqrt(chord)) * (2 * EARTH_KM)


def reach_km(days_to_expiry: Column, speed_kmh: float = SPEED_KMH, handling_hours: float = HANDLING_HOURS) -> Column:
    """How far stock can go and still arrive before it expires; not above zero means nowhere."""
    return (days_to_expiry * 24.0 - handling_hours) * speed_kmh


def _band(level: Column, band: Column) -> Column:
    """Cells around the globe in a band of latitude: each as wide as a reach of 2^level km at the band's end nearest a pole
    (and a band further, where the other store may be); 1 where no three such cells fit."""
    high = F.pow(F.lit(2.0), level) / KM_A_DEGREE  # of a band, in degrees
    edge = F.greatest(F.abs(band * high), F.abs((band + 1) * high)) + high
    width = high * (math.pi / 2) / F.cos(F.radians(edge))
    cells = F.floor(F.lit(360.0) / width)
    return F.when((edge >= 89.0) | (cells < 3), F.lit(1)).otherwise(cells).cast("long")


def _cell(lon: Column, cells: Column) -> Column:
    return F.pmod(F.floor((lon + 180.0) / 360.0 * cells), cells)


def within_reach(origin: DataFrame, target: DataFrame) -> DataFrame:
    """``origin`` (sku_id, lat_a, lon_a, reach) joined with ``target`` (sku_id, lat_b, lon_b) by SKU and by cells of a grid:
    every pair within ``reach`` km is in the result, and of the others only those in neighbouring cells.

    The grid has a level for each power of two of the reach. An origin looks at the nine cells around its own, on its level
    alone; a target stands in one cell of every level that its SKU's origins use.
    """
    levelled = origin.filter("reach > 0").withColumn("level", F.greatest(F.ceil(F.log2("reach")), F.lit(0)).cast("int"))
    height = lambda level: F.pow(F.lit(2.0), level) / KM_A_DEGREE
    near = levelled.withColumn("band", F.explode(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.floor(F.col("lat_a") / height(F.col("level"))) + i)))
    near = near.withColumn("cells", _band(F.col("level"), F.col("band")))
    around = F.array_distinct(F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.pmod(_cell(F.col("lon_a"), F.col("cells")) + i, F.col("cells"))))
    near = near.withColumn("cell", F.explode(around)).drop("cells")
    levels = levelled.select("sku_id", "level").distinct()  # at most 16 a SKU on this globe
    stands = target.join(levels, "sku_id").withColumn("band", F.floor(F.col("lat_b") / height(F.col("level"))))
    stands = stands.withColumn("cell", _cell(F.col("lon_b"), _band(F.col("level"), F.col("band"))))
    return near.join(stands, ["sku_id", "level", "band", "cell"]).drop("level", "band", "cell")


def transfer_candidates(
    risk: DataFrame, daily: DataFrame, stores: DataFrame, products: DataFrame, lookback: int = LOOKBACK_DAYS, min_units: int = 0
) -> DataFrame:
    """Surplus and deficit of the same SKU in two stores, near enough to arrive before the stock expires.

    The pairing is an equality join on the SKU and on cells of a grid as wide as the stock can travel, so its size
    follows the stores within reach and no store-by-store table is ever formed. With ``min_units``, sides and pairs that
    ``shelf_life_gate`` would drop whatever the distance are dropped before and in the join: what is at risk, what
    is unmet, and what sells until expiry must each round to the minimum.
    """
    least = min_units - 0.5
    as_of = risk.agg(F.max("date_day")).scalar()
    surplus = (
        risk.filter((F.col("risk_state") == "at_risk") & (F.col("units_at_risk") > 0))
        .groupBy("store_id", "sku_id", "date_day")
        .agg(
            F.sum("units_at_risk").alias("units_at_risk"), F.min("days_to_expiry").alias("days_to_expiry"),
            F.max("unit_landed_cost").alias("unit_landed_cost"),
        )
        .filter(F.col("units_at_risk") >= least)
    )
    unmet = F.col("units_demanded_imputed") - F.col("units_sold")
    deficit = (
        daily.filter((F.col("date_day") <= as_of) & (F.col("date_day") >= F.date_sub(as_of, lookback)))
        .filter(F.col("is_censored") & (unmet > 0))
        .groupBy("store_id", "sku_id")
        .agg(F.sum(unmet).alias("unmet_units"), F.avg("trailing_7d_avg_units").alias("daily_rate"))
        .filter((F.col("daily_rate") > 0) & (F.col("unmet_units") >= least))
    )
    place = stores.select("store_id", "lat", "lon")
    origin = surplus.join(place, "store_id").withColumnsRenamed({"store_id": "from_store", "lat": "lat_a", "lon": "lon_a"})
    target = deficit.join(place, "store_id").withColumnsRenamed({"store_id": "to_store", "lat": "lat_b", "lon": "lon_b"})
    return (
        within_reach(origin.withColumn("reach", reach_km(F.col("days_to_expiry"))), target)
        .filter((F.col("from_store") != F.col("to_store")) & (F.col("daily_rate") * F.col("days_to_expiry") >= least))
        .withColumn("km", F.round(haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")), 3))
        .filter("km < reach").drop("reach")
        .join(products.select("sku_id", "sku_name", "l1_category", "base_price"), "sku_id")
        .withColumn("unit_margin", F.col("base_price") - F.col("unit_landed_cost"))
        .drop("lat_a", "lon_a", "lat_b", "lon_b", "base_price")
    )


def shelf_life_gate(candidates: DataFrame, speed_kmh: float = SPEED_KMH, handling_hours: float = HANDLING_HOURS) -> DataFrame:
    """Units an arc can carry and still sell before they expire; arcs under the minimum drop out."""
    hours = F.lit(handling_hours) + F.col("km") / speed_kmh
    return (
        candidates.withColumn("transit_hours", hours)
        .withColumn("sellable_days", F.col("days_to_expiry") - F.col("transit_hours") / 24.0)
        .withColumn("max_units", F.greatest(F.lit(0.0), F.col("daily_rate") * F.col("sellable_days")))
        .withColumn("arc_cap", F.round(F.least("max_units", "units_at_risk", "unmet_units")).cast("int"))
        .withColumn("unit_benefit", F.col("unit_landed_cost") + F.greatest("unit_margin", F.lit(0.0)))
        .filter(F.col("arc_cap") >= MIN_UNITS)
    )


CARRIED = [
    "date_day", "from_store", "to_store", "sku_id", "sku_name", "l1_category", "km", "transit_hours", "days_to_expiry",
    "sellable_days", "arc_cap", "unit_landed_cost", "unit_margin", "unit_benefit",
]
OUT, INTO, PAIR = ["from_store", "sku_id"], ["to_store", "sku_id"], ["from_store", "to_store"]


def _trip(cost_per_km: float, fixed_trip_cost: float) -> Column:
    return F.lit(fixed_trip_cost) + F.col("km") * cost_per_km


def transfer_plan(
    arcs: DataFrame, cost_per_km: float = COST_PER_KM, fixed_trip_cost: float = FIXED_TRIP_COST, passes: int = PASSES
) -> DataFrame:
    """``rec_transfer_order``: trips that pay, within what each store has and needs.

    An auction in at most ``passes`` passes, whatever the number of stores. In a pass all arcs bid at once: a pair's bid
    is what its arcs would bring with all that is left, less the trip unless it is paid for already. Stock goes
    to the arcs of a store in order of their pairs' bids, need is met in the same order from what they were given, and a
    pair whose grants no longer pay for its trip gives them back. The pair with the highest bid gets all it asked for, so
    every pass takes something while a trip pays. ``plan_bound`` says how far from the best the result can be.

    The windows hold the arcs of one SKU and store: one row for each other store. Grants are written to a table, so
    plans do not grow with the passes.
    """
    space, rounds = Workspace(arcs.sparkSession, f"transfers {uuid.uuid4()}"), []
    left = cut_lineage(
        arcs.select(*CARRIED, F.floor("units_at_risk").alias("supply"), F.floor("unmet_units").alias("need"))
        .withColumns({"room": F.col("arc_cap"), "paid": F.lit(False)})
    )
    pair = Window.partitionBy(*PAIR)
    trip = F.when(F.col("paid"), F.lit(0.0)).otherwise(_trip(cost_per_km, fixed_trip_cost))
    earlier = lambda keys: Window.partitionBy(*keys).orderBy(F.desc("bid"), "from_store", "to_store").rowsBetween(Window.unboundedPreceding, -1)

    def granted(asked: str, limit: str, keys: list[str]) -> Column:
        before = F.coalesce(F.sum(asked).over(earlier(keys)), F.lit(0))
        return F.least(F.col(asked), F.greatest(F.col(limit) - before, F.lit(0)))

    taken = left.withColumn("units", F.lit(0).cast("long")).limit(0)
    for turn in range(passes):
        offered = left.withColumn("asked", F.least("room", "supply", "need").cast("long")).filter(F.col("asked") >= MIN_UNITS)
        bids = offered.withColumn("bid", F.sum(F.col("asked") * F.col("unit_benefit")).over(pair) - trip).filter("bid > 0")
        given = bids.withColumn("given", granted("asked", "supply", OUT)).withColumn("units", granted("given", "need", INTO).cast("long"))
        paying = given.filter(F.col("units") >= MIN_UNITS).withColumn("worth", F.sum(F.col("units") * F.col("unit_benefit")).over(pair) - trip)
        taken = space.write(paying.filter("worth > 0").drop("asked", "given", "bid", "worth"), f"pass_{turn}")
        if taken.isEmpty():
            break
        rounds.append(space.path(f"pass_{turn}"))
        sent, got = taken.groupBy(*OUT).agg(F.sum("units").alias("sent")), taken.groupBy(*INTO).agg(F.sum("units").alias("got"))
        riding = taken.select(*PAIR, "sku_id", F.col("units").alias("riding"))
        vans = taken.select(*PAIR).distinct().withColumn("van", F.lit(True))
        less = lambda a, b: (F.col(a) - F.coalesce(b, F.lit(0))).alias(a)
        left = cut_lineage(
            left.join(sent, OUT, "left").join(got, INTO, "left").join(riding, [*PAIR, "sku_id"], "left").join(vans, PAIR, "left")
            .select(*CARRIED, less("supply", "sent"), less("need", "got"), less("room", "riding"), (F.col("paid") | F.coalesce("van", F.lit(False))).alias("paid"))
            .filter(F.least("supply", "need", "room") >= MIN_UNITS)
        )
    moves = arcs.sparkSession.read.schema(taken.schema).parquet(*rounds) if rounds else taken
    whole = moves.groupBy(*CARRIED).agg(F.sum("units").alias("units"))
    priced = whole.withColumns(
        {
            "avoided_writeoff": F.col("units") * F.col("unit_landed_cost"),
            "recovered_margin": F.col("units") * F.greatest("unit_margin", F.lit(0.0)),
            "trip_cost": _trip(cost_per_km, fixed_trip_cost),
            "method": F.lit("auction"),
        }
    )
    return attribute_trip_cost(priced)


def plan_bound(
    arcs: DataFrame, plan: DataFrame, cost_per_km: float = COST_PER_KM, fixed_trip_cost: float = FIXED_TRIP_COST, rounds: int = BOUND_ROUNDS
) -> DataFrame:
    """One row (value, opening_bound, bound): what the plan brings, and more than which no plan can bring.

    With a price on every unit of stock and of need, pairs no longer compete: each runs if its arcs, at full room and net
    of the prices, pay for the trip. Prices of what is left over plus these gains bound every plan from above, whatever the
    prices. They start at zero (``opening_bound``) and move ``rounds`` times against over- and underuse, by a step
    that the gap to the plan decides (Polyak); the least bound counts. Prices are columns of the arcs, so a round is
    three windows of bounded groups and one sum.
    """
    value = plan.agg(F.sum("net_benefit")).first()[0] or 0.0
    state = cut_lineage(arcs.select(
        *PAIR, "sku_id", "arc_cap", "unit_benefit", _trip(cost_per_km, fixed_trip_cost).alias("trip"), F.floor("units_at_risk").cast("double").alias("supply"),
        F.floor("unmet_units").cast("double").alias("need"), F.lit(0.0).alias("out_price"), F.lit(0.0).alias("in_price"),
    ))
    best, opening = None, 0.0
    for _ in range(rounds + 1):
        gain = F.greatest(F.col("unit_benefit") - F.col("out_price") - F.col("in_price"), F.lit(0.0)) * F.col("arc_cap")
        runs = state.withColumn("gain", gain).withColumn("pair_gain", F.sum("gain").over(Window.partitionBy(*PAIR)) - F.col("trip"))
        used = runs.withColumn("used", F.when((F.col("pair_gain") > 0) & (F.col("gain") > 0), F.col("arc_cap")).otherwise(0))
        for keys, total, name in ((OUT, "supply", "out"), (INTO, "need", "in")):
            w = Window.partitionBy(*keys)
            used = used.withColumns({f"{name}_slack": F.col(total) - F.sum("used").over(w), f"{name}_arcs": F.count("*").over(w)})
        now = cut_lineage(used.withColumn("pair_arcs", F.count("*").over(Window.partitionBy(*PAIR))))
        each = lambda c, n: F.sum(c / F.col(n))  # noqa: E731  (once a group)
        # A price of zero is not pushed further down.
        live = lambda n: F.when((F.col(f"{n}_price") > 0) | (F.col(f"{n}_slack") < 0), F.col(f"{n}_slack")).otherwise(0.0)
        r = now.agg(
            each(F.col("out_price") * F.col("supply"), "out_arcs").alias("a"), each(F.col("in_price") * F.col("need"), "in_arcs").alias("b"),
            each(F.greatest("pair_gain", F.lit(0.0)), "pair_arcs").alias("c"),
            (each(live("out") * live("out"), "out_arcs") + each(live("in") * live("in"), "in_arcs")).alias("norm"),
        ).first()
        bound = sum(r[c] or 0.0 for c in "abc")
        if best is None:
            opening = best = bound
        best = min(best, bound)
        if not r["norm"] or bound <= value:
            break
        step = (bound - value) / r["norm"]
        moved = {f"{n}_price": F.greatest(F.col(f"{n}_price") - live(n) * step, F.lit(0.0)) for n in ("out", "in")}
        state = now.withColumns(moved).select(*state.columns)
    return arcs.sparkSession.createDataFrame([(value, opening, best)], "value double, opening_bound double, bound double")


def attribute_trip_cost(moves: DataFrame) -> DataFrame:
    """Each trip is paid once, shared by the units riding on it."""
    aboard = F.sum("units").over(Window.partitionBy("from_store", "to_store"))
    return moves.withColumn("trip_cost_share", F.col("trip_cost") * F.col("units") / aboard).withColumn(
        "net_benefit", F.col("avoided_writeoff") + F.col("recovered_margin") - F.col("trip_cost_share")
    )
