"""SimHash near-duplicate groups by tiled exact comparison.

A fingerprint has a bit set if more than half of the text's shingle hashes have it. Texts whose
fingerprints differ in at most ``radius`` bits are linked, and groups are the connected components.

Equal fingerprints are one node. Nodes fall into tiles by the population counts of ``segments`` equal
parts of the fingerprint; a pair within the radius can only lie in tiles whose counts differ by the
radius or less in all, so other tile pairs are skipped. The rest are compared whole, block against
block, with numpy's exclusive-or and bit counts. With one part this is the plain population count; more
parts make tiles smaller. The number of parts follows the number of nodes; the result does not
depend on it.

Scale: texts are read once by a narrow map; what moves are fingerprints. A tile of any size is cut into
blocks of bounded size, and the nodes that visit it into chunks, so that hot tiles spread over many
tasks. A block writes a spanning star per local component, not its pairs. Components come from
alternating large-star and small-star rounds, each written to the shared checkpoint folder; nothing of
the corpus reaches the driver but counts.

Defined results: a null or empty text has fingerprint zero and links like any other; fewer words than a
shingle make one shingle; repeated rows fall into one group; a null id is never the name of a group that
has another id; an empty table gives no rows. Other columns are kept, the operator's own names replace
clashing ones.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.workspace import cut_lineage

SHINGLE = 3
RADIUS = 2
SEED = 42
BLOCK = 4096
VISITS = 8 * BLOCK
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64 bits as a signed integer. Words are split at spaces and the ASCII controls 9 to 13."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64)
    ones = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(text: Column) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return run(text)


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def parts_for(nodes: int) -> int:
    """Parts of a fingerprint whose population counts make a tile."""
    return 1 if nodes < 1 << 13 else 2 if nodes < 1 << 15 else 4 if nodes < 1 << 26 else 8


def tile_of(fp: Column, parts: int) -> Column:
    """Population counts of the parts, seven binary places each."""
    width = 64 // parts
    mask = (1 << width) - 1 if width < 64 else -1
    counts = [F.bit_count(F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit(mask).cast("long"))).cast("long") for i in range(parts)]
    return sum((F.shiftleft(c, 7 * i) for i, c in enumerate(counts[1:], 1)), counts[0])


def tile_steps(parts: int, radius: int) -> list[int]:
    """What is added to a tile's number to get each tile within the radius: one of a step and its reverse,
    and no step at all. Counts that leave their range name no tile."""
    steps = []
    for step in itertools.product(range(-radius, radius + 1), repeat=parts):
        if sum(map(abs, step)) <= radius and step >= (0,) * parts:
            steps.append(sum(d << (7 * i) for i, d in enumerate(step)))
    return steps


def stars(own: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its local component) for nodes with a link between the two sides."""
    nodes, at = np.unique(np.concatenate([own, visitors]), return_inverse=True)
    own_at, visit_at = at[: len(own)], at[len(own) :]
    name = np.arange(len(nodes))
    linked = np.zeros(len(nodes), bool)
    a, b = own.view(np.uint64), visitors.view(np.uint64)
    rows = max(1, (1 << 20) // max(1, len(a)))
    for lo in range(0, len(b), rows):
        near = np.bitwise_count(b[lo : lo + rows, None] ^ a[None, :]) <= radius
        near &= visit_at[lo : lo + rows, None] != own_at[None, :]
        for r in np.flatnonzero(near.any(axis=1)):
            me = visit_at[lo + r]
            group = np.append(own_at[near[r]], me)
            linked[group] = True
            names = np.unique(name[group])
            if len(names) > 1:
                name[np.isin(name, names)] = names[0]
    chosen = np.flatnonzero(linked & (name != np.arange(len(nodes))))
    return nodes[chosen], nodes[name[chosen]]


def _compare(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of one (tile, block, chunk); a run is bounded, and may go over several batches."""
        held: list[pd.DataFrame] = []

        def done() -> Iterator[pd.DataFrame]:
            if held:
                fp = np.concatenate([h["fp"].to_numpy(np.int64) for h in held])
                own = np.concatenate([h["own"].to_numpy(bool) for h in held])
                if own.any() and not own.all():
                    a, b = stars(fp[own], fp[~own], radius)
                    if len(a):
                        yield pd.DataFrame({"a": a, "b": b})

        for part in batches:
            keys = part[["tile", "block", "chunk"]].to_numpy(np.int64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(part)], strict=True):
                if held and (held[-1][["tile", "block", "chunk"]].iloc[-1].to_numpy(np.int64) != keys[lo]).any():
                    yield from done()
                    held = []
                held.append(part.iloc[lo:hi])
        yield from done()

    return run


def tile_links(nodes: DataFrame, radius: int = RADIUS, parts: int | None = None, block: int = BLOCK, visits: int = VISITS) -> DataFrame:
    """Links (a, b) that connect the same nodes as all links do. ``nodes`` has one row per ``fp``."""
    spark = nodes.sparkSession
    count = parts or parts_for(nodes.count())
    own = nodes.select("fp", tile_of(F.col("fp"), count).alias("tile"))
    steps = F.array(*[F.lit(s).cast("long") for s in tile_steps(count, radius)])
    sizes = own.groupBy("tile").agg(F.count("*").alias("n"))
    # One row per tile and neighbour: how many nodes each tile holds, and how many visit it.
    met = sizes.select("tile", F.explode(steps).alias("s"), "n").groupBy((F.col("tile") + F.col("s")).alias("tile")).agg(F.sum("n").alias("visitors"))
    cut = sizes.join(met, "tile").select(
        "tile", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("visitors") / visits).cast("int").alias("chunks")
    )
    cut = cut_lineage(cut)
    place, seat = F.xxhash64("fp", F.lit(1)), F.xxhash64("fp", F.lit(2))
    owners = own.join(cut, "tile").select(
        "tile", F.pmod(place, F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("own"), "fp"
    )
    visitors = own.select("fp", F.explode(steps).alias("s"), "tile").select("fp", (F.col("tile") + F.col("s")).alias("tile")).join(cut, "tile").select(
        "tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(seat, F.col("chunks")).cast("int").alias("chunk"), F.lit(False).alias("own"), "fp"
    )
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = owners.unionByName(visitors).repartition(shuffle, "tile", "block", "chunk").sortWithinPartitions("tile", "block", "chunk")
    return met.mapInPandas(_compare(radius), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links but roots; ``root`` is the smallest node of its component.

    Large-star: every neighbour above a node is tied to the node's smallest neighbour. Small-star: the
    same for the neighbours below and the node itself. Both keep components; when neither changes the
    links, every component is a star around its root."""
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = cut_lineage(edges)
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select("a", "b", "m")
        edges = cut_lineage(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, parts: int | None = None) -> DataFrame:
    """``docs`` without the text, with ``text_hash``, ``fp`` (64 bits as a long), ``root`` (the smallest
    fingerprint in the document's group) and ``component_id`` (the smallest id there; null if none has
    one). Each text is read once; ids and fingerprints are written once."""
    kept = [c for c in docs.columns if c not in {text, "text_hash", "fp", "root", "component_id"}]
    prints = cut_lineage(docs.select(*kept, F.xxhash64(text).alias("text_hash"), fingerprints(F.col(text)).alias("fp")))
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min(doc_id).alias("first")))
    roots = components(tile_links(nodes.select("fp"), radius, parts))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = rooted.join(named, "root")
    return prints.join(groups, "fp").select(*kept, "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each group: the one with the smallest id, and of rows with that id the one with the
    smallest text hash. Columns are those of ``docs``."""
    found = near_duplicates(docs.select(doc_id, text), doc_id, text, radius)
    row = F.struct(F.col(doc_id).isNull().alias("n"), F.col(doc_id).alias("i"), F.col("text_hash").alias("h"))
    best = found.groupBy("root").agg(F.min(row).alias("r")).select(F.col("r.i").alias("_i"), F.col("r.h").alias("_h")).distinct()
    # The row travels as a struct, so that no column of the caller's meets a name used here.
    hashed = docs.select(F.struct(*docs.columns).alias("_row"), F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"))
    joined = hashed.join(best, hashed["_id"].eqNullSafe(best["_i"]) & (hashed["_hash"] == best["_h"]), "left_semi")
    return joined.dropDuplicates(["_id", "_hash"]).select("_row.*")
