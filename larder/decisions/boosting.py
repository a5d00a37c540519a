"""Gradient-boosted demand trees on histograms, with Tweedie loss and a log link.

Features are cut into bins once: numbers at quantiles, a null in a bin of its own, categories (stores
among them) one bin a value. The binned rows are written, two bytes a feature. Every level of every tree is then one
aggregate: tasks sum gradients and curvatures by (node, feature, bin) over their rows in numpy, Spark adds the sums up,
and the driver, which sees one row per node and bin whatever the number of rows, picks the splits. A numeric split
sends bins up to a border left; a categorical one orders the categories by the ratio of gradient to curvature in the
node, which makes the best subset a prefix.

A value not seen in training goes where a bin of no weight goes: right. Training needs a positive mean label.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.workspace import Workspace

POWER = 1.1
BINS = 32
ROUNDS = 16
DEPTH = 4
RATE = 0.3
LEAST_ROWS = 20
SHRINK = 1.0


@dataclass
class Split:
    """Rows of ``node`` whose bin of ``feature`` is marked in ``left`` go to child 2n, the others to 2n + 1."""

    node: int
    feature: int
    left: np.ndarray


@dataclass
class Tree:
    """Splits level by level; a node without a split is a leaf. The root is node 1."""

    levels: list[list[Split]] = field(default_factory=list)
    values: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.ones(len(bins), np.int64)
        for level in self.levels:
            moved = at.copy()
            for s in level:
                own = np.flatnonzero(at == s.node)
                moved[own] = 2 * s.node + ~s.left[bins[own, s.feature]]
            at = moved
        return at

    def score(self, bins: np.ndarray) -> np.ndarray:
        at = self.nodes(bins)
        table = np.zeros(at.max(initial=1) + 1)
        for node, value in self.values.items():
            if node < len(table):
                table[node] = value
        return table[at]


@dataclass
class Booster:
    """``edges`` are the upper ends of a number's bins (bin 0 is null), ``codes`` the bins of a category's values
    (bin 0 is any other value); a feature is in one of them."""

    names: list[str]
    edges: dict[str, np.ndarray]
    codes: dict[str, dict[str, int]]
    base: float
    trees: list[Tree] = field(default_factory=list)

    def widths(self) -> list[int]:
        return [len(self.edges[n]) + 2 if n in self.edges else len(self.codes[n]) + 1 for n in self.names]

    def encode(self, rows: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(rows), len(self.names)), "<u2")
        for i, name in enumerate(self.names):
            if name in self.edges:
                x = rows[name].to_numpy(np.float64)
                out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(self.edges[name], x, "left") + 1)
            else:
                out[:, i] = rows[name].map(self.codes[name]).fillna(0)
        return out

    def raw(self, bins: np.ndarray) -> np.ndarray:
        total = np.full(len(bins), self.base)
        for tree in self.trees:
            total += tree.score(bins)
        return total

    def predict(self, features: DataFrame) -> Column:
        """The expected demand of each row of ``features``, as a column of it."""

        @F.pandas_udf("double")
        def of(rows: pd.DataFrame) -> pd.Series:
            return pd.Series(np.exp(self.raw(self.encode(rows))))

        return of(F.struct(*typed(self.edges, self.codes)))


def typed(numbers: Sequence[str], categories: Sequence[str]) -> list[Column]:
    return [*[F.col(c).cast("double").alias(c) for c in numbers], *[F.col(c).cast("string").alias(c) for c in categories]]


def gradients(label: np.ndarray, raw: np.ndarray, power: float = POWER) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the Tweedie loss in the logarithm of the mean."""
    low, high = np.exp((1 - power) * raw), np.exp((2 - power) * raw)
    return high - label * low, (2 - power) * high + (power - 1) * label * low


def best_split(node: int, sums: np.ndarray, starts: Sequence[int], ordered: Sequence[bool], least_rows: int) -> Split | None:
    """The split of the largest gain over ``sums`` (gradient, curvature, rows by bin of all features)."""
    best, found = 1e-9, None
    for f, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        own = sums[a:b]
        g, h, n = own.sum(axis=0)
        order = np.arange(b - a) if ordered[f] else np.lexsort((np.arange(b - a), own[:, 0] / (own[:, 1] + SHRINK)))
        order = order[own[order, 2] > 0] if not ordered[f] else order
        left = np.cumsum(own[order], axis=0)[:-1]
        if not len(left):
            continue
        gl, hl, nl = left.T
        gain = gl**2 / (hl + SHRINK) + (g - gl) ** 2 / (h - hl + SHRINK) - g**2 / (h + SHRINK)
        gain[(nl < least_rows) | (n - nl < least_rows)] = -np.inf
        at = int(gain.argmax())
        if gain[at] > best:
            mark = np.zeros(b - a, bool)
            mark[order[: at + 1]] = True
            best, found = gain[at], Split(node, f, mark)
    return found


def bins_of(training: DataFrame, label: str, numbers: Sequence[str], categories: Sequence[str], bins: int) -> Booster | None:
    """A booster without trees: one aggregate for the borders and the mean, one for the categories."""
    shares = [i / bins for i in range(1, bins)]
    borders = training.agg(
        F.avg(F.col(label).cast("double")).alias("_mean"),
        *[F.percentile_approx(F.col(c).cast("double"), F.array(*map(F.lit, shares)), F.lit(10_000)).alias(c) for c in numbers],
    ).first()
    if not borders["_mean"] or borders["_mean"] <= 0:
        return None
    edges = {c: np.unique(np.array(borders[c] or [], np.float64)) for c in numbers}
    names = F.array(*[F.struct(F.lit(c).alias("f"), F.col(c).cast("string").alias("v")) for c in categories])
    # One row per category value: as many as there are stores and category names.
    values = training.select(F.explode(names).alias("x")).select("x.*").filter("v is not null").distinct().orderBy("f", "v").collect()
    codes: dict[str, dict[str, int]] = {c: {} for c in categories}
    for r in values:
        codes[r["f"]][r["v"]] = len(codes[r["f"]]) + 1
    return Booster([*numbers, *categories], edges, codes, float(np.log(borders["_mean"])))


def fit(
    training: DataFrame, label: str, numbers: Sequence[str], categories: Sequence[str],
    rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, power: float = POWER, least_rows: int = LEAST_ROWS,
) -> Booster | None:
    """``rounds`` trees of ``depth`` levels; None where there is nothing to learn from."""
    model = bins_of(training, label, numbers, categories, bins)
    if model is None:
        return None
    count = len(model.names)
    starts = np.r_[0, np.cumsum(model.widths())]
    ordered = [n in model.edges for n in model.names]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"y": part["y"], "x": [r.tobytes() for r in model.encode(part)]})

    rows = training.filter(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), *typed(numbers, categories))
    table = Workspace(training.sparkSession, f"boosting {uuid.uuid4()}").write(rows.mapInPandas(encode, "y double, x binary"), "binned")

    def level_sums(tree: Tree) -> pd.DataFrame:
        """Sums by node and bin of all features, under the trees so far and the levels of this one."""

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, np.ndarray] = {}
            for part in batches:
                if not len(part):
                    continue
                x = np.frombuffer(b"".join(part["x"]), "<u2").reshape(len(part), count)
                g, h = gradients(part["y"].to_numpy(np.float64), model.raw(x), power)
                node = tree.nodes(x)
                for k in np.unique(node):
                    own = np.flatnonzero(node == k)
                    slots = (x[own] + starts[:-1]).ravel()
                    sums = np.stack([np.bincount(slots, np.repeat(w, count), starts[-1]) for w in (g[own], h[own], np.ones(len(own)))], axis=1)
                    total[k] = total.get(k, 0) + sums
            for k, sums in total.items():
                at = np.flatnonzero(sums[:, 2])
                yield pd.DataFrame({"node": k, "slot": at, "g": sums[at, 0], "h": sums[at, 1], "n": sums[at, 2]})

        parts = table.mapInPandas(add, "node long, slot int, g double, h double, n double")
        return parts.groupBy("node", "slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).toPandas()

    for _ in range(rounds):
        tree = Tree()
        for _level in range(depth):
            splits = []
            for node, own in level_sums(tree).groupby("node"):
                sums = np.zeros((starts[-1], 3))
                sums[own["slot"]] = own[["g", "h", "n"]].to_numpy()
                g, h, _ = sums[starts[0] : starts[1]].sum(axis=0)
                tree.values[node] = -rate * g / (h + SHRINK)
                if found := best_split(int(node), sums, starts, ordered, least_rows):
                    splits.append(found)
                    for child, mark in ((2 * node, found.left), (2 * node + 1, ~found.left)):
                        g, h, _ = sums[starts[found.feature] : starts[found.feature + 1]][mark].sum(axis=0)
                        tree.values[child] = -rate * g / (h + SHRINK)
            if not splits:
                break
            tree.levels.append(splits)
        model.trees.append(tree)
    return model
