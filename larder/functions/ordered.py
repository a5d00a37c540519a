"""Ordered operators that hold up when one key has a third of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larder.workspace import cut_lineage

# A task that groups and sorts this many wide rows holds a few hundred MB.
ROWS_PER_TASK = 500_000


def task_count(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Partitions for a shuffle of ``df`` whose tasks hold about so many rows each, whatever the size of the table.

    ``spark.sql.shuffle.partitions`` stays as it is while tables grow, and adaptive execution only joins partitions:
    beyond some size every task would spill. The rows are counted for it, without reading their columns.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows_per_task))


def by_key(df: DataFrame, key: str, tasks: int | None) -> DataFrame:
    """``df`` by ``key`` in ``tasks`` partitions, else in as many as the session says."""
    return df.repartition(key) if tasks is None else df.repartition(tasks, key)


def first_arrival(
    df: DataFrame, business: Sequence[str], arrival: str, by: str | None = None, tasks: int | None = None
) -> DataFrame:
    """One row per distinct business row, carrying its earliest arrival.

    Grouping combines copies before the shuffle, so a row repeated a billion times costs one
    row per map task rather than one sort of a billion. With ``by``, one of the business columns that is
    nearly a key, rows shuffle once on it alone and copies meet there, in a hash table: what is joined or grouped on
    that column afterwards needs no shuffle of its own, if it comes in as many ``tasks``.
    """
    rows = df if by is None else by_key(df, by, tasks)
    return rows.groupBy(*business).agg(F.min(arrival).alias(arrival))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in ``order``; nulls come first.

    The greatest first value of each key is a hash aggregate of two columns, and only rows that have it are looked at
    further: whole rows are neither sorted nor aggregated. What is left is a row or a few of each key.
    """
    first, *others = order
    newest = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.max(first).alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    rows = df.join(newest, [*same, F.col(first).eqNullSafe(F.col("_first"))], "left_semi")
    rest = [c for c in df.columns if c not in keys and c not in order]
    last = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in [*others, *rest]])
    return rows.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth")


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    slice_by: Column,
    order: Sequence[str],
    value: str,
    name: str,
    inclusive: bool = True,
) -> DataFrame:
    """Running sum per key, computed one slice of the key at a time.

    ``slice_by`` must not decrease along ``order``. Rows shuffle once, on key and slice; what
    came before a slice is added from a table of slice totals, which is combined before its
    own shuffle.
    """
    sliced = df.withColumn("_slice", slice_by)
    totals = sliced.groupBy(*keys, "_slice").agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    upto = 0 if inclusive else -1
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    )
    joined = sliced.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(
        offsets, [*keys, "_slice"], "inner"
    )
    return joined.withColumn(name, F.col("_before") + F.col("_inside")).drop("_slice", "_before", "_inside")


def global_running(
    df: DataFrame,
    order: Sequence[Column],
    sums: Mapping[str, Column],
    slices: int | None = None,
) -> DataFrame:
    """Running sums over one global order, without a single-partition window.

    The rows are range-partitioned by ``order`` (a total order, so ties split too) and written
    once; each range then needs only its own rows and one total per range before it.
    """
    spark = df.sparkSession
    count = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = df.select("*", *[c.cast("double").alias(f"_v_{n}") for n, c in sums.items()])
    ranged = cut_lineage(
        named.repartitionByRange(count, *order).withColumn("_range", F.spark_partition_id())
    )
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    # One row per range, so this window is bounded by the partition count, not by the data.
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_range", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0.0)).alias(f"_b_{n}") for n in sums]
    )
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(offsets), "_range")
    for n in sums:
        out = out.withColumn(n, F.col(f"_b_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0.0)))
    return out.drop("_range", *[f"_v_{n}" for n in sums], *[f"_b_{n}" for n in sums])


def quantile_starts(df: DataFrame, values: Sequence[str], parts: int) -> dict[str, list]:
    """Per column, for k in 1..parts-1, the smallest value whose cume_dist exceeds k/parts.

    ``ceil(parts * cume_dist)`` is then 1 plus the number of starts at or below the value. Ties
    are counted, not sorted, so a value shared by a third of the rows is one row here, and all
    columns are ranked in one pass. Only ``parts - 1`` numbers per column reach the driver.
    """
    pairs = F.array(*[F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values])
    counts = (
        df.select(F.explode(pairs).alias("p")).select("p.name", "p.value").filter("value is not null")
        .groupBy("name", "value").agg(F.count("*").alias("n"))
    )
    ranked = global_running(counts, [F.asc("name"), F.asc("value")], {"upto": F.col("n")})
    spans = ranked.groupBy("name").agg(F.sum("n").alias("total"), F.max("upto").alias("end"))
    within = ranked.join(F.broadcast(spans), "name").withColumn("upto", F.col("upto") - F.col("end") + F.col("total"))
    starts = within.groupBy("name").agg(
        *[F.min(F.when(F.col("upto") * parts > F.col("total") * k, F.col("value"))).alias(f"s{k}") for k in range(1, parts)]
    )
    found = {r["name"]: [r[f"s{k}"] for k in range(1, parts)] for r in starts.collect()}
    return {v: found.get(v, [None] * (parts - 1)) for v in values}


def exact_median(df: DataFrame, value: str, name: str) -> DataFrame:
    """The middle value, or the mean of the two, from positions in one global order."""
    known = df.select(F.col(value).cast("double").alias("v")).filter("v is not null")
    counts = known.groupBy("v").agg(F.count("*").alias("n"))
    ranked = global_running(counts, [F.asc("v")], {"upto": F.col("n")})
    total = ranked.agg(F.sum("n")).scalar()
    placed = ranked.withColumn("total", total)
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    return placed.agg(
        ((F.min(F.when(F.col("upto") >= low, F.col("v"))) + F.min(F.when(F.col("upto") >= high, F.col("v")))) / 2).alias(name)
    )


def quantile_score(value: Column, starts: Sequence) -> Column:
    score = F.lit(1)
    for start in starts:
        score = score + F.when(value >= F.lit(start), 1).otherwise(0)
    return score.cast("int")


def islands(
    df: DataFrame, keys: Sequence[str], order: str, breaks: Column, name: str
) -> DataFrame:
    """Number maximal runs: a row where ``breaks`` holds (or is null) opens a new one.

    ``breaks`` may use ``F.lag(..).over(run_window(keys, order))``. Callers reduce to one row
    per key and day first, so a key's window is bounded by the calendar.
    """
    upto = run_window(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)
    return df.withColumn("_opens", opened).withColumn(name, F.sum("_opens").over(upto)).drop("_opens")


def run_window(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str) -> DataFrame:
    """First ``n`` rows per key with their rank; the filter is pushed into the window as a
    per-task limit, so a hot key ships only its candidates."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
