"""Hard negatives by a multiway hyperplane tree with distance ranges between siblings (GNAT).

A node has several split points; a row goes to the nearest, so siblings meet at hyperplanes. Per pair (i, j) the
node stores the least and greatest distance from split point i to any row under j. A query asks for rows inside
an annulus around it: sibling j is passed over if for some i its range cannot meet the annulus by the triangle
inequality, or if the hyperplane between i and j lies beyond the annulus. Leaves are scored exactly.

Scores are inner products. Each row gets one more coordinate that brings all rows to the greatest length M, and a
query gets a zero there: then distance² = |q|² + M² - 2 * score, so a window of scores is an annulus of distances.

The search has four rounds. The anchors' positives: the home leaf first, which bounds the distance of the last
wanted row, then every other leaf that the ball of that distance meets. Then the windows that the positives open:
again the home leaf first, which narrows a window to its last wanted row, then every leaf that the annulus meets.

Scale: the tree is fitted on at most ``SAMPLE`` rows (a documented bound, chosen by a hash) and has at most
``LEAVES`` leaves; every row is indexed, and ranges come from one aggregate over all rows. Leaves of any size are cut
into blocks of bounded size, the anchors that visit them into chunks; a block returns at most the wanted rows of
each anchor and window. Nothing but the tree reaches the driver or is broadcast. Where vectors are spread so
evenly that no range excludes anything, every anchor meets every leaf, in blocks.

Defined results: rows with a null id, label or vector or with a null or non-finite component take no part; a
shorter vector counts as ended by zeros; rows equal in id, label and vector count once; rows that share an id are
no other rows to each other; equal scores go to the smaller id (then label and vector); an anchor without positives
or a positive without negatives has no rows; an empty table gives none. Components and sums must be
exact in doubles (below 2^53), else an error is raised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.ordered import top_per_group
from larder.llm.blocks import meet, work_through
from larder.workspace import cut_lineage

SAMPLE = 8192
LEAVES = 1024
FANOUT = 16
LEAF_ROWS = 4096
BLOCK = 32_768
CHUNK = 8192
_SLAB = 1 << 22
_SLACK = 1e-6


def prepared(rows: DataFrame, ident: str, vector: str, label: Column, scale: int) -> tuple[DataFrame, int, float, str]:
    """Distinct rows (id, label, vec) with vectors as packed whole numbers; their dimension, greatest squared length, and number type."""
    fits = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = (
        rows.select(F.col(ident).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
        .filter(fits).filter(finite).select("id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"))
    )
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    greatest = F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    dim, longest, biggest = whole.agg(F.max(F.size("v")), F.max(square), F.max(greatest)).first()
    dim, longest, biggest = dim or 0, longest or 0.0, biggest or 0.0
    if longest >= 2.0**53:
        raise ValueError("scores of these vectors are not exact in doubles")
    kind = "<i2" if biggest < 1 << 15 else "<i4" if biggest < 1 << 31 else "<f8"

    @F.pandas_udf("binary")
    def pack(vectors: pd.Series) -> pd.Series:
        out = np.zeros((len(vectors), dim))
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        flat = out.astype(kind)
        return pd.Series([r.tobytes() for r in flat])

    return whole.select("id", "label", pack("v").alias("vec")).distinct(), dim, longest, kind


def unpacked(vectors: pd.Series, dim: int, kind: str) -> np.ndarray:
    flat = b"".join(vectors)
    return np.frombuffer(flat, kind).reshape(len(vectors), dim).astype(np.float64) if flat else np.zeros((len(vectors), dim))


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Rows with the coordinate that brings them to the greatest length."""
    rest = np.sqrt(np.maximum(0.0, longest - (vectors * vectors).sum(axis=1)))
    return np.c_[vectors, rest]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(0.0, squares))


@dataclass
class Node:
    points: np.ndarray
    children: list[int | Node]
    number: int
    low: np.ndarray | None = None
    high: np.ndarray | None = None


@dataclass
class Tree:
    """Leaves are numbers, inner nodes hold split points; ``slack`` covers rounding of distances."""

    root: Node | int
    nodes: list[Node]
    leaves: int
    slack: float

    @classmethod
    def fit(cls, sample: np.ndarray, total: int, fanout: int = FANOUT, leaf_rows: int = LEAF_ROWS, most: int = LEAVES) -> Tree:
        """Split points by greedy spreading: the next is the row of the sample farthest from those chosen."""
        per_row = total / max(1, len(sample))
        goal = max(leaf_rows, 2 * total / most)
        nodes: list[Node] = []
        count = 0

        def grow(rows: np.ndarray, room: int) -> int | Node:
            nonlocal count
            picked = [0] if len(rows) * per_row > goal and len(rows) >= 2 * fanout and room >= 2 else []
            near = distances(rows, rows[:1])[:, 0] if picked else None
            while picked and len(picked) < min(fanout, room):
                far = int(near.argmax())
                if near[far] <= 0:
                    break
                picked.append(far)
                near = np.minimum(near, distances(rows, rows[far : far + 1])[:, 0])
            if len(picked) < 2:
                count += 1
                return count - 1
            node = Node(rows[picked], [], len(nodes))
            nodes.append(node)
            home = distances(rows, node.points).argmin(axis=1)
            spare = room - len(picked)
            for j in range(len(picked)):
                own = rows[home == j]
                share = 1 + int(spare * len(own) / len(rows))
                node.children.append(grow(own, share))
            return node

        root = grow(sample, most)
        return cls(root, nodes, count, _SLACK * float(np.sqrt((sample * sample).sum(axis=1).max())) if len(sample) else 0.0)

    def homes(self, rows: np.ndarray, ranges: dict[int, tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
        """The leaf of each row; ``ranges`` collects, per node, least and greatest distances from point i to rows under j."""
        out = np.zeros(len(rows), np.int32)
        todo: list[tuple[Node | int, np.ndarray]] = [(self.root, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if isinstance(node, int):
                out[at] = node
                continue
            away = distances(rows[at], node.points)
            home = away.argmin(axis=1)
            m = len(node.points)
            if ranges is not None and node.number not in ranges:
                ranges[node.number] = np.full((m, m), np.inf), np.full((m, m), -np.inf)
            for j in np.unique(home):
                own = home == j
                if ranges is not None:
                    low, high = ranges[node.number]
                    low[:, j] = np.minimum(low[:, j], away[own].min(axis=0))
                    high[:, j] = np.maximum(high[:, j], away[own].max(axis=0))
                todo.append((node.children[j], at[own]))
        return out

    def reached(self, queries: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query number, leaf) for every leaf that may hold a row inside an annulus of the query; ``inner`` and
        ``outer`` have one column for each annulus, of which unused ones are empty (inner > outer)."""
        who, leaf = [], []
        todo: list[tuple[Node | int, np.ndarray]] = [(self.root, np.flatnonzero((inner <= outer).any(axis=1)))]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(node, int):
                who.append(at)
                leaf.append(np.full(len(at), node, np.int32))
                continue
            away = distances(queries[at], node.points)
            apart = distances(node.points, node.points)
            m = len(node.points)
            alive = np.zeros((len(at), m), bool)
            # Signed distance to the hyperplane between i and j, for rows nearer to j.
            squares = away * away
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(apart > 0, (squares[:, None, :] - squares[:, :, None]) / (2 * apart[None]), -np.inf)
            beyond = plane.max(axis=1)
            for w in range(inner.shape[1]):
                near, far = inner[at, w] - self.slack, outer[at, w] + self.slack
                meets = (node.low[None] <= (away + far[:, None])[:, :, None]) & (node.high[None] >= (away - far[:, None])[:, :, None])
                meets &= (away[:, :, None] + node.high[None]) >= near[:, None, None]
                alive |= meets.all(axis=1) & (beyond <= far[:, None]) & (near <= far)[:, None]
            for j in range(m):
                todo.append((node.children[j], at[alive[:, j]]))
        none = np.empty(0, np.int64)
        return (np.concatenate(who), np.concatenate(leaf)) if who else (none, none.astype(np.int32))


def build(rows: DataFrame, dim: int, longest: float, kind: str, sample: int = SAMPLE, **shape) -> tuple[Tree, DataFrame]:
    """The tree with its ranges, and the index: every row with its ``leaf``."""
    total = rows.count()
    place = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1_000_000_000))
    # A share of twice the bound first, so that sorting does not meet all rows in one place.
    chosen = rows.filter(place < 2 * sample * 1_000_000_000 // max(1, total) + 1).orderBy(place, "id", "label", "vec").limit(sample).select("vec").toPandas()
    points = lifted(unpacked(chosen["vec"], dim, kind), longest) if len(chosen) else np.empty((0, dim + 1))
    tree = Tree.fit(points, total, **shape)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            part["leaf"] = tree.homes(lifted(unpacked(part["vec"], dim, kind), longest)) if len(part) else np.empty(0, np.int32)
            yield part

    def span(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for part in batches:
            if len(part):
                tree.homes(lifted(unpacked(part["vec"], dim, kind), longest), found)
        for number, (low, high) in found.items():
            i, j = np.nonzero(np.isfinite(low))
            yield pd.DataFrame({"node": number, "i": i, "j": j, "low": low[i, j], "high": high[i, j]})

    index = cut_lineage(rows.mapInPandas(assign, "id long, label long, vec binary, leaf int"))
    for node in tree.nodes:
        m = len(node.points)
        node.low, node.high = np.full((m, m), np.inf), np.full((m, m), -np.inf)
    spans = index.select("vec").mapInPandas(span, "node int, i int, j int, low double, high double")
    # At most fanout² rows a node.
    for r in spans.groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        tree.nodes[r["node"]].low[r["i"], r["j"]] = r["low"]
        tree.nodes[r["node"]].high[r["i"], r["j"]] = r["high"]
    return tree, index


def first_of(score: np.ndarray, row: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of each group, equal ones by the lower row number."""
    order = np.lexsort((row, -score, group))
    g = group[order]
    opens = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(opens, np.diff(np.r_[opens, len(g)]))
    return order[rank < k]


def scan(own: pd.DataFrame, visits: pd.DataFrame, dim: int, kind: str, k: int, same: bool) -> pd.DataFrame:
    """For every visiting anchor and each of its windows (least and greatest score): the first ``k`` rows of the block with
    the anchor's label (``same``) or with another, by score and id."""
    own = own.sort_values(["id", "label", "vec"], ignore_index=True)
    ids, labels, base = own["id"].to_numpy(np.int64), own["label"].to_numpy(np.int64), unpacked(own["vec"], dim, kind)
    out = []
    step = max(1, _SLAB // max(1, len(own)))
    for a in range(0, len(visits), step):
        some = visits.iloc[a : a + step]
        asked, wanted = some["id"].to_numpy(np.int64), some["label"].to_numpy(np.int64)
        score = unpacked(some["vec"], dim, kind) @ base.T
        windows = [np.asarray(w, np.float64).reshape(-1, 2) for w in some["windows"]]
        low, high = np.array([w[:, 0].min() for w in windows]), np.array([w[:, 1].max() for w in windows])
        who, row = np.nonzero((score >= low[:, None]) & (score <= high[:, None]))
        fit = (asked[who] != ids[row]) & ((wanted[who] == labels[row]) == same)
        who, row = who[fit], row[fit]
        value = score[who, row]
        for w in range(max(len(x) for x in windows)):
            lo = np.array([x[w, 0] if w < len(x) else np.inf for x in windows])
            hi = np.array([x[w, 1] if w < len(x) else -np.inf for x in windows])
            hit = np.flatnonzero((value >= lo[who]) & (value <= hi[who]))
            best = hit[first_of(value[hit], row[hit], who[hit], k)]
            out.append(
                pd.DataFrame({
                    "anchor": asked[who[best]], "anchor_label": wanted[who[best]], "anchor_vec": some["vec"].to_numpy()[who[best]], "place": w,
                    "id": ids[row[best]], "label": labels[row[best]], "vec": own["vec"].to_numpy()[row[best]], "score": value[best].astype(np.int64),
                })
            )
    return pd.concat(out, ignore_index=True)


_FOUND = "anchor long, anchor_label long, anchor_vec binary, place int, id long, label long, vec binary, score long"
_ANCHOR = ["anchor", "anchor_label", "anchor_vec"]


class Searcher:
    """Exact window search of anchors over an index."""

    def __init__(self, tree: Tree, index: DataFrame, dim: int, longest: float, kind: str):
        self.tree, self.index, self.dim, self.longest, self.kind = tree, index, dim, longest, kind

    def _sent(self, anchors: DataFrame, home: bool, others: bool) -> DataFrame:
        """Anchors (id, label, vec, windows) with each leaf that they visit: their home, others their windows reach, or both."""
        tree, dim, longest, kind = self.tree, self.dim, self.longest, self.kind

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for a in range(0, len(whole), 1024):
                    part = whole.iloc[a : a + 1024]
                    plain = unpacked(part["vec"], dim, kind)
                    q = np.c_[plain, np.zeros(len(plain))]
                    own = tree.homes(q)
                    who, leaf = np.arange(len(part)), own
                    if others:
                        most = max(len(w) for w in part["windows"])
                        low, high = np.full((len(part), most), np.inf), np.full((len(part), most), -np.inf)
                        for i, w in enumerate(part["windows"]):
                            pairs = np.asarray(w, np.float64).reshape(-1, 2)
                            low[i, : len(pairs)], high[i, : len(pairs)] = pairs[:, 0], pairs[:, 1]
                        square = (plain * plain).sum(axis=1)[:, None] + longest
                        empty = low > high
                        away = lambda s: np.sqrt(np.maximum(0.0, square - 2 * s))
                        inner, outer = away(np.where(empty, 0, high)), away(np.where(empty, 0, low))
                        inner[empty], outer[empty] = np.inf, -np.inf
                        who, leaf = tree.reached(q, inner, outer)
                        if not home:
                            who, leaf = who[leaf != own[who]], leaf[leaf != own[who]]
                    yield part.iloc[who].assign(leaf=leaf)

        return anchors.mapInPandas(visit, "id long, label long, vec binary, windows array<double>, leaf int")

    def find(self, anchors: DataFrame, k: int, same: bool, home: bool, others: bool) -> DataFrame:
        dim, kind = self.dim, self.kind
        columns = ["id", "label", "vec", "windows", "leaf"]
        own = self.index.withColumn("windows", F.lit(None).cast("array<double>")).select(*columns)
        met = meet(own, self._sent(anchors, home, others).select(*columns), ["leaf"], "id", BLOCK, CHUNK)
        return work_through(met, ["leaf"], lambda key, rows, visits: scan(rows, visits, dim, kind, k, same), _FOUND)


def _first(found: DataFrame, keys: list[str], k: int, rank: str) -> DataFrame:
    return top_per_group(found, keys, [F.col("score").desc(), F.col("id"), F.col("label"), F.col("vec")], k, rank)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, ident: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
    positives: int = 5, negatives: int = 5, window: tuple[int, int] = (80, 100), scale: int = 256, **shape,
) -> DataFrame:
    """For each row where ``is_anchor`` (an expression over ``id`` and ``label``) holds and each of its first ``positives`` rows of one label:
    the first ``negatives`` rows of other labels with window[0] * positive_score <= 100 * negative_score <= window[1] * positive_score,
    as (anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    plain, dim, longest, kind = prepared(rows, ident, vector, F.col(label) if isinstance(label, str) else label, scale)
    tree, index = build(cut_lineage(plain), dim, longest, kind, **shape)
    search = Searcher(tree, index, dim, longest, kind)
    everything = float(np.ceil(longest) + 1)
    asked = index.filter(is_anchor).select("id", "label", "vec")
    start = asked.withColumn("windows", F.array(F.lit(-everything), F.lit(everything)))
    near = cut_lineage(_first(search.find(start, positives, True, True, False), _ANCHOR, positives, "pos"))
    # The last wanted positive so far bounds the ball; with fewer, it stays open.
    floor = near.groupBy(*_ANCHOR).agg(F.count("*").alias("n"), F.min("score").cast("double").alias("worst"))
    named = [F.col(a).alias(b) for a, b in zip(_ANCHOR, ["id", "label", "vec"], strict=True)]
    least = F.when(F.col("n") >= positives, F.col("worst")).otherwise(-everything)
    ball = asked.join(floor.select(*named, "n", "worst"), ["id", "label", "vec"], "left").select(
        "id", "label", "vec", F.array(F.coalesce(least, F.lit(-everything)), F.lit(everything)).alias("windows")
    )
    far = search.find(ball, positives, True, False, True)
    liked = cut_lineage(_first(near.drop("pos").unionByName(far), _ANCHOR, positives, "pos"))
    # At most ``positives`` windows an anchor, in the order of the positives.
    opened = liked.select(*named, F.struct(F.col("pos"), F.col("score").cast("double").alias("p")).alias("w")).groupBy("id", "label", "vec").agg(
        F.array_sort(F.collect_list("w")).alias("w")
    )
    least_of = lambda p: F.ceil(p * window[0] / 100).cast("double")
    most_of = lambda p: F.floor(p * window[1] / 100).cast("double")
    spread = cut_lineage(opened.withColumn("windows", F.flatten(F.transform("w", lambda x: F.array(least_of(x["p"]), most_of(x["p"]))))).drop("w"))
    keys = [*_ANCHOR, "place"]
    first = cut_lineage(_first(search.find(spread, negatives, False, True, False), keys, negatives, "rank"))
    # A window that is full so far shrinks to its last wanted row.
    full = first.groupBy(*keys).agg(F.count("*").alias("n"), F.min("score").cast("double").alias("worst")).filter(F.col("n") >= negatives)
    fulls = full.groupBy(*named).agg(F.map_from_entries(F.collect_list(F.struct("place", "worst"))).alias("worst"))
    raised = F.transform(
        "windows",
        lambda x, i: F.when((i % 2 == 0) & F.col("worst").isNotNull(), F.greatest(x, F.coalesce(F.element_at("worst", F.floor(i / 2).cast("int")), x))).otherwise(x),
    )
    narrowed = spread.join(fulls, ["id", "label", "vec"], "left").select("id", "label", "vec", raised.alias("windows"))
    rest = search.find(narrowed, negatives, False, False, True)
    best = _first(first.drop("rank").unionByName(rest), keys, negatives, "rank")
    pairs = liked.select(*_ANCHOR, (F.col("pos") - 1).alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return best.join(pairs, keys).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
