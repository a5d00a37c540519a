"""An honest causal tree: splits chosen on one half of the customers, effects measured on the other."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_DEPTH = 4
MIN_PER_ARM = 150
CANDIDATES = 24


@dataclass
class Node:
    feature: str | None = None
    threshold: float = 0.0
    effect: float = 0.0
    n_treated: int = 0
    n_control: int = 0


@dataclass
class CausalTree:
    """Nodes by number; the children of ``i`` are ``2i`` and ``2i + 1``."""

    features: list[str]
    max_depth: int = MAX_DEPTH
    min_per_arm: int = MIN_PER_ARM
    nodes: dict[int, Node] = field(default_factory=dict)

    def fit(self, panel: DataFrame, outcome: str) -> CausalTree:
        half = F.pmod(F.xxhash64("customer_id", F.lit("half")), F.lit(2))
        data = panel.select(
            "customer_id", F.col("treated").cast("int"), F.col(outcome).cast("double").alias("y"),
            *[F.col(f).cast("double").alias(f) for f in self.features], half.alias("half"),
        ).cache()
        self.nodes = {1: Node()}
        level = [1]
        for _ in range(self.max_depth):
            best = self._best_splits(data.filter("half = 0").withColumn("node", self._node()), level)
            level = []
            for number, (feature, threshold) in best.items():
                self.nodes[number].feature, self.nodes[number].threshold = feature, threshold
                for child in (2 * number, 2 * number + 1):
                    self.nodes[child] = Node()
                    level.append(child)
            if not level:
                break
        self._estimate(data.filter("half = 1").withColumn("node", self._node()))
        data.unpersist()
        return self

    def _node(self, number: int = 1) -> Column:
        """Leaf number of a row, as nested CASE expressions."""
        node = self.nodes[number]
        if node.feature is None:
            return F.lit(number)
        return F.when(F.col(node.feature) <= node.threshold, self._node(2 * number)).otherwise(self._node(2 * number + 1))

    def _best_splits(self, build: DataFrame, level: list[int]) -> dict[int, tuple[str, float]]:
        """Best split of each open node, from one histogram per node, feature and arm.

        A row is expanded once per feature and counted into the bins between candidate
        thresholds; every threshold's two sides are then prefix sums over those few bins.
        """
        here = build.filter(F.col("node").isin(level))
        probs = [0.05 + 0.90 * i / (CANDIDATES - 1) for i in range(CANDIDATES)]
        long = here.select(
            "node", "treated", "y",
            F.explode(F.create_map(*[x for f in self.features for x in (F.lit(f), F.col(f))])).alias("feature", "value"),
        )
        cuts = long.groupBy("node", "feature").agg(
            F.array_sort(F.array_distinct(F.percentile_approx("value", F.array(*[F.lit(p) for p in probs]), F.lit(10000)))).alias("cuts")
        )
        # Nodes of one level times features: bounded by the depth of the tree.
        bins = (
            long.join(F.broadcast(cuts), ["node", "feature"])
            .withColumn("bin", F.size(F.filter("cuts", lambda c: c < F.col("value"))))
            .groupBy("node", "feature", "bin", "cuts")
            .agg(
                F.sum("treated").alias("nt"), F.sum(1 - F.col("treated")).alias("nc"),
                F.sum(F.col("y") * F.col("treated")).alias("yt"), F.sum(F.col("y") * (1 - F.col("treated"))).alias("yc"),
            )
        )
        whole = Window.partitionBy("node", "feature")
        upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sides = bins
        for c in ("nt", "nc", "yt", "yc"):
            sides = sides.withColumns({f"l_{c}": F.sum(c).over(upto), f"a_{c}": F.sum(c).over(whole)})

        def score(prefix: str) -> Column:
            nt, nc, yt, yc = [F.col(f"{prefix}_{c}") for c in ("nt", "nc", "yt", "yc")]
            effect = F.when((nt > 0) & (nc > 0), yt / nt - yc / nc).otherwise(0.0)
            return (nt + nc) * effect * effect

        for c in ("nt", "nc", "yt", "yc"):
            sides = sides.withColumn(f"r_{c}", F.col(f"a_{c}") - F.col(f"l_{c}"))
        usable = F.least("l_nt", "l_nc", "r_nt", "r_nc") >= self.min_per_arm
        scored = (
            sides.filter((F.col("bin") < F.size("cuts")) & usable)
            .select("node", "feature", F.element_at("cuts", F.col("bin") + 1).alias("threshold"), (score("l") + score("r")).alias("score"), score("a").alias("parent"))
            .filter("score > parent")
        )
        order = F.struct("score", "feature", (-F.col("threshold")).alias("t"))
        best = scored.groupBy("node").agg(F.max_by(F.struct("feature", "threshold"), order).alias("b"))
        return {r.node: (r.b.feature, r.b.threshold) for r in best.collect()}

    def _estimate(self, held: DataFrame) -> None:
        rows = held.groupBy("node").agg(
            F.sum("treated").alias("nt"), F.sum(1 - F.col("treated")).alias("nc"),
            F.sum(F.col("y") * F.col("treated")).alias("yt"), F.sum(F.col("y") * (1 - F.col("treated"))).alias("yc"),
        ).collect()
        totals: dict[int, list[float]] = {n: [0.0] * 4 for n in self.nodes}
        for r in rows:
            number = r.node
            while number:
                totals[number] = [a + b for a, b in zip(totals[number], (r.nt, r.nc, r.yt, r.yc), strict=True)]
                number //= 2
        for number in sorted(self.nodes):
            nt, nc, yt, yc = totals[number]
            node = self.nodes[number]
            node.n_treated, node.n_control = int(nt), int(nc)
            above = self.nodes[number // 2].effect if number > 1 else 0.0
            node.effect = yt / nt - yc / nc if nt >= 1 and nc >= 1 else above

    def predict(self, scored: DataFrame, name: str = "uplift") -> DataFrame:
        leaf = self._node()
        effect = F.lit(0.0)
        for number, node in self.nodes.items():
            if node.feature is None:
                effect = F.when(leaf == number, F.lit(node.effect)).otherwise(effect)
        return scored.withColumn(name, effect)

    def leaves(self) -> list[int]:
        return [n for n, node in self.nodes.items() if node.feature is None]
