"""Resharding by minimum-cost flow: from old shard sizes and new capacities, move the fewest bytes.

The flow network has one node per old shard, one per new shard and a cost of one a byte on every arc
but that of a shard to itself. Its solution says how many bytes each old shard sends to each new one.
Inside an old shard the rows are in order of size, largest first; the head stays, and the blocks that
leave are cut from the tail, so that every boundary is as exact as a small row.

Scale: the driver sees one total per old shard and the flow between shards, whatever the number of
rows. Positions inside a shard are running sums over one range partitioning on (shard, size, id), so a
shard with a third of the rows is spread over many tasks; slots are numbered the same way. Only the
named columns move; texts are rewritten by ``rewrite``, for the shards that gained or lost rows: they move once
to meet their place and once to their shard.

Defined results: a null text has no bytes (its size is one); a null id sorts first; repeated rows each
get a slot of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.workspace import cut_lineage

Arc = tuple[int, int, int]


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Units sent from each old shard to each new one at the least cost (1 a unit moved, 0 a unit that
    stays; shard ``i`` of the old layout is shard ``i`` of the new one). Successive shortest paths; on
    equal costs the smaller shard numbers go first. ``sum(capacity)`` must cover ``sum(supply)``."""
    if sum(capacity) < sum(supply):
        raise ValueError("the new capacities do not hold the data")
    olds, news = len(supply), len(capacity)
    source, sink = olds + news, olds + news + 1
    graph: list[dict[int, list[int]]] = [{} for _ in range(sink + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> None:
        graph[a][b], graph[b][a] = [room, cost], [0, -cost]

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(news):
            arc(i, olds + j, s, int(i != j))
    for j, c in enumerate(capacity):
        arc(olds + j, sink, c, 0)

    while True:
        cost, before, queue = {source: 0}, {}, deque([source])
        while queue:
            a = queue.popleft()
            for b, (room, price) in graph[a].items():
                if room > 0 and cost[a] + price < cost.get(b, 1 << 60):
                    cost[b], before[b] = cost[a] + price, a
                    if b not in queue:
                        queue.append(b)
        if sink not in cost:
            break
        path, at = [], sink
        while at != source:
            path.append((before[at], at))
            at = before[at]
        sent = min(graph[a][b][0] for a, b in path)
        for a, b in path:
            graph[a][b][0] -= sent
            graph[b][a][0] += sent
    return {(i, j): graph[olds + j][i][0] for i in range(olds) for j in range(news) if graph[olds + j][i][0] > 0}


def even_capacities(total: int, shards: int) -> list[int]:
    """Shares of ``total`` that differ by one at most."""
    return [total // shards + (n < total % shards) for n in range(shards)]


def plan_transfers(old_sizes: dict[int, int], capacity: list[int]) -> list[tuple[int, int, int, int]]:
    """(old shard, from, to, new shard) in bytes of the old shard's order: what stays is its head."""
    olds = max([len(capacity), *(s + 1 for s in old_sizes)])
    flow = min_cost_flow([old_sizes.get(s, 0) for s in range(olds)], capacity)
    out = []
    for old in range(olds):
        at = 0
        for new in sorted((j for i, j in flow if i == old), key=lambda j: (j != old, j)):
            out.append((old, at, at + flow[old, new], new))
            at += flow[old, new]
    return out


def _numbered(df: DataFrame, key: str, value: Column, order: list[Column], name: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of the same ``key``; ``_range`` must grow along ``order``."""
    totals = df.groupBy("_range", key).agg(F.sum(value).alias("_sum"))
    # One row per range and shard, so this window is bounded by partitions, not by the data.
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", key, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), ["_range", key])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_before", "_inside")
    )


def reshard(df: DataFrame, old: str, size: str, tie: list[str], capacity: list[int] | None = None, shards: int = 16) -> DataFrame:
    """``df`` with ``shard`` (its new one) and ``slot`` (gapless from 0 in each). ``old`` is the shard now,
    ``size`` the bytes; ``tie`` orders rows of one size. ``capacity`` defaults to even shares."""
    spark = df.sparkSession
    order = [F.col(old), F.col(size).desc(), *[F.col(c) for c in tie]]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = df.drop("shard", "slot")
    ranged = cut_lineage(kept.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    sizes = {r[0]: int(r[1]) for r in ranged.groupBy(old).agg(F.sum(size)).collect()}  # one row per old shard
    room = capacity or even_capacities(sum(sizes.values()), shards)
    target = F.lit(None).cast("int")
    middle = F.col("_upto") + F.col(size) / 2
    for own, _, end, new in reversed(plan_transfers(sizes, room)):
        target = F.when((F.col(old) == own) & (middle <= end), F.lit(new)).otherwise(target)
    placed = _numbered(ranged.repartition(parts, "_range"), old, F.col(size), order, "_upto").withColumn("shard", target)
    return _numbered(placed, "shard", F.lit(1), order, "slot").drop("_upto", "_range")


def moved(placed: DataFrame, old: str, size: str) -> DataFrame:
    """Bytes and rows per transfer between shards."""
    return placed.filter(F.col(old) != F.col("shard")).groupBy(old, "shard").agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))


def rewrite(docs: DataFrame, placed: DataFrame, on: str | Sequence[str], old: str, folder: str) -> list[int]:
    """Write the rows of every shard that gained or lost some to ``folder/shard=N``; other shards' files
    stay as they are, and those of shards left without rows go. Returns the shards affected. ``on`` must
    identify a row, nulls being values like others; repeated keys raise an error before anything is written."""
    spark, keys = docs.sparkSession, [on] if isinstance(on, str) else list(on)
    changes = placed.filter(F.col(old) != F.col("shard"))
    pairs = changes.select(old, "shard").distinct().collect()  # pairs of shards, bounded by their number
    touched = sorted({s for r in pairs for s in r})
    if not touched:
        return []
    into = placed.filter(F.col("shard").isin(touched)).select(*[F.col(k).alias(f"_on{n}") for n, k in enumerate(keys)], "shard", "slot")
    names = [f"_on{n}" for n in range(len(keys))]
    if not into.groupBy(*names).count().filter("count > 1").isEmpty():
        raise ValueError(f"{', '.join(keys)} must identify a row")
    same = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    (
        docs.drop("shard", "slot").join(into, same).drop(*names).hint("rebalance", "shard")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("shard").parquet(folder)
    )
    filled = {r[0] for r in into.select("shard").distinct().collect()}  # at most one row per shard
    jvm = spark._jvm
    for shard in set(touched) - filled:  # its rows are all in the files just written
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/shard={shard}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return touched
