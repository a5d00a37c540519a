"""Exact top-k search for 64-bit codes by incremental multi-index hashing.

A code is cut into ``m`` segments. If two codes differ in at most ``m * (r + 1) - 1`` bits, some segment
differs in at most ``r``. So probing every segment at radii 0 to ``r`` finds all codes within that distance:
the radius grows until a query's k-th verified distance is covered, and only queries that are not
yet covered take part in the next round.

Scale: equal codes are one entry with its smallest ``k + 1`` ids (no other id of a code can be among the
nearest k). The index is one row per code and segment, dealt out by segment and by the high bits of its
value; a query is sent only to the places its radius reaches. Both sides are cut into blocks of
bounded size, so that a frequent segment value spreads over many tasks. A block returns at most
``k + 1`` codes a query. The driver sees one count a round; there are at most as many rounds as a
segment has bits.

Defined results: rows without a code are neither found nor asked for; repeated rows (same id and code)
count once; a row is not its own neighbour; equal distances go to the smaller id, a null id first;
fewer than k others give fewer results; an empty table gives none.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.functions.ordered import top_per_group
from larder.llm.blocks import meet, work_through
from larder.workspace import cut_lineage

BITS = 64
BLOCK = 65536
CHUNK = 4096
_NO_ID = -(1 << 63)


def sign_code(vector: str) -> Column:
    """The signs of a vector's numbers as bits; null for a null vector. Bits past a shorter vector's end are zero;
    a vector of more than 64 numbers has no such code and raises an error."""
    signs = f"aggregate(transform({vector}, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)"
    longer = f"raise_error('a sign code holds {BITS} numbers, not ' || size({vector}))"
    return F.expr(f"if(size({vector}) > {BITS}, {longer}, {signs})")


def segments_for(codes: int) -> int:
    """Segments of about as many bits as the number of codes has, as the literature advises."""
    return 8 if codes < 1 << 12 else 4 if codes < 1 << 24 else 2


def segment(code: Column, width: int, number: int) -> Column:
    """Bits of one segment, as a long."""
    return F.shiftrightunsigned(code, width * number).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def flips(width: int, radius: int) -> np.ndarray:
    """All numbers of ``width`` bits of which ``radius`` are set."""
    if radius > width or radius < 0:
        return np.empty(0, np.uint64)
    return np.array([sum(1 << b for b in c) for c in itertools.combinations(range(width), radius)], np.uint64)


def _nearest(rows: tuple[np.ndarray, ...], most: int) -> tuple[np.ndarray, ...]:
    """Of (query, distance, first id, code number): the first ``most`` of each query, by distance and id."""
    order = np.lexsort((rows[3], rows[2], rows[1], rows[0]))
    q = rows[0][order]
    opens = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(opens, np.diff(np.r_[opens, len(q)]))
    return tuple(c[order[rank < most]] for c in rows)


def probe(
    codes: np.ndarray, first: np.ndarray, queries: np.ndarray, bounds: np.ndarray, number: int, width: int, slab: int, high: int, radii: range, most: int
) -> tuple[np.ndarray, ...]:
    """Codes of one slab of one segment whose segment value is ``radii`` bits away from a query's, verified: the
    nearest ``most`` of each query that are no further than its bound, as (query number, distance, first id,
    code number)."""
    low = width - high
    cut = lambda x: (x.view(np.uint64) >> np.uint64(width * number)) & np.uint64((1 << width) - 1)
    order = np.argsort(cut(codes), kind="stable")
    sorted_codes, values = codes[order], cut(codes)[order]
    buckets, starts = np.unique(values, return_index=True)
    ends = np.r_[starts[1:], len(values)]
    asked = cut(queries)
    tail, away = asked & np.uint64((1 << low) - 1), np.bitwise_count((asked >> np.uint64(low)) ^ np.uint64(slab)).astype(np.int64)
    best = tuple(np.empty(0, np.int64) for _ in range(4))
    for radius in radii:
        for far in np.unique(away):
            masks = flips(low, radius - int(far))
            group = np.flatnonzero(away == far)
            step = max(1, (1 << 20) // max(1, len(masks)))
            for a in range(0, len(group) if len(masks) else 0, step):
                some = group[a : a + step]
                wanted = (tail[some][:, None] ^ masks[None, :]) | np.uint64(slab << low)
                at = np.minimum(np.searchsorted(buckets, wanted), len(buckets) - 1)
                who, which = np.nonzero(buckets[at] == wanted)
                found = at[who, which]
                sizes = ends[found] - starts[found]
                cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(sizes) >> 21)) + 1, len(found)] if len(found) else [0]
                for lo, hi in itertools.pairwise(cuts):  # a few million candidates at a time
                    size = sizes[lo:hi]
                    spot = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[found[lo:hi]], size)
                    query = np.repeat(some[who[lo:hi]], size)
                    distance = np.bitwise_count(queries.view(np.uint64)[query] ^ sorted_codes.view(np.uint64)[spot]).astype(np.int64)
                    near = distance <= bounds[query]
                    fresh = (query[near], distance[near], first[order[spot[near]]], order[spot[near]])
                    best = _nearest(tuple(np.concatenate(x) for x in zip(best, fresh, strict=True)), most)
    return best


def search(base: DataFrame, queries: DataFrame, k: int = 10, ident: str = "id", code: str = "code", segments: int | None = None) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the ``k`` nearest rows of ``base`` for each row of ``queries``."""
    rows = base.select(F.col(ident).cast("long").alias("id"), F.col(code).cast("long").alias("code")).filter("code is not null").distinct()
    asked = cut_lineage(queries.select(F.col(ident).cast("long").alias("id"), F.col(code).cast("long").alias("code")).filter("code is not null").distinct())
    few = top_per_group(rows, ["code"], [F.col("id").asc()], k + 1, "_rank")
    # At most k + 1 ids a code; nulls are kept by the struct.
    index = cut_lineage(
        few.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("id"))).alias("ids"))
        .select("code", "ids", F.size("ids").alias("n"), F.coalesce(F.col("ids")[0]["id"], F.lit(_NO_ID)).alias("first"))
    )
    open_ = cut_lineage(asked.select("code").distinct().withColumn("bound", F.lit(BITS)))
    total = index.count()
    m = segments or segments_for(total)
    width = BITS // m
    high = max(0, min(width, math.ceil(math.log2(max(1, total) / BLOCK)))) if total else 0

    def placed(df: DataFrame) -> DataFrame:
        parts = F.array(*[F.struct(F.lit(i).alias("seg"), F.shiftright(segment(F.col("code"), width, i), width - high).cast("int").alias("slab")) for i in range(m)])
        return df.select("*", F.explode(parts).alias("p")).select(*df.columns, "p.seg", "p.slab")

    entries = placed(index.select("code", "first", "n"))
    best = None
    lowest = 0
    # The first round takes every radius at which k codes a query are not to be expected.
    radius = next((r for r in range(width) if total * sum(math.comb(width, i) for i in range(r + 1)) >= k * 2**width), width)
    while True:
        radii = range(lowest, radius + 1)
        reach = F.array(*[F.lit(int(x)).cast("int") for r in range(min(high, radius) + 1) for x in flips(high, r)])
        sent = placed(open_).select("code", "bound", "seg", F.explode(reach).alias("x"), "slab").select(
            "code", F.lit(0).cast("long").alias("first"), F.col("bound").alias("n"), "seg", F.col("slab").bitwiseXOR(F.col("x")).alias("slab")
        )

        def work(key: tuple, own: pd.DataFrame, visits: pd.DataFrame, radii=radii) -> pd.DataFrame:
            codes, first, count = (own[c].to_numpy(np.int64) for c in ("code", "first", "n"))
            q = visits["code"].to_numpy(np.int64)
            who, distance, _, which = probe(codes, first, q, visits["n"].to_numpy(np.int64), key[0], width, key[1], high, radii, k + 1)
            return pd.DataFrame({"q": q[who], "code": codes[which], "distance": distance, "first": first[which], "n": count[which]})

        met = meet(entries, sent, ["seg", "slab"], "code", BLOCK, CHUNK)
        found = work_through(met, ["seg", "slab"], work, "q long, code long, distance long, first long, n int")
        known = (found if best is None else best.unionByName(found)).distinct()
        best = cut_lineage(top_per_group(known, ["q"], [F.col("distance"), F.col("first"), F.col("code")], k + 1, "_rank").drop("_rank"))
        upto = Window.partitionBy("q").orderBy("distance").rangeBetween(Window.unboundedPreceding, 0)
        others = F.sum(F.col("n") - (F.col("distance") == 0).cast("int")).over(upto)
        covered = m * (radius + 1) - 1
        # The k-th verified distance: nothing beyond it is of use, and once it is covered the query is done.
        kth = best.withColumn("_others", others).filter(F.col("_others") >= k).groupBy(F.col("q").alias("code")).agg(F.min("distance").cast("int").alias("bound"))
        left = open_.select("code").join(kth, "code", "left").withColumn("bound", F.coalesce("bound", F.lit(BITS)))
        open_ = cut_lineage(left.filter(F.col("bound") > covered))
        lowest, radius = radius + 1, radius + 1
        if lowest > width or open_.isEmpty():
            break
    near = best.join(index.select("code", "ids"), "code").select("q", "distance", F.explode("ids").alias("i")).select("q", "distance", "i.id")
    # At most (k + 1) ^ 2 ids a query code; the first k + 1 stay.
    lists = top_per_group(near, ["q"], [F.col("distance"), F.col("id").asc()], k + 1, "_rank").groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct("_rank", "distance", "id"))).alias("near")
    )
    out = asked.join(lists, asked["code"] == lists["q"]).select(F.col("id").alias("query_id"), F.col("near"))
    own = lambda x: (x["distance"] == 0) & x["id"].eqNullSafe(F.col("query_id"))
    out = out.select("query_id", F.posexplode(F.slice(F.filter("near", lambda x: ~own(x)), 1, k)).alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("neighbor_id"), F.col("x.distance").alias("distance"))
