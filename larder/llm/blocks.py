"""Block-by-block work in numpy on sides that Spark has cut to bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Work = Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame | None]


def meet(own: DataFrame, visits: DataFrame, key: Sequence[str], seat: str, block: int, chunk: int) -> DataFrame:
    """Rows of both sides dealt out so that every pair with one ``key`` meets once in one (key, block, chunk),
    with ``own`` marking the side. Blocks hold about ``block`` rows of ``own``, chunks about ``chunk`` of
    ``visits``, however many rows a key has; keys that only one side has are left out. Both sides need the
    same columns and a column ``seat`` that is hashed into blocks and chunks."""
    sizes = own.groupBy(*key).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    parties = visits.groupBy(*key).agg(F.ceil(F.count("*") / chunk).cast("int").alias("_chunks"))
    cut = sizes.join(parties, list(key))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    place = lambda n, seed: F.pmod(F.xxhash64(seat, F.lit(seed)), F.col(n)).cast("int")
    left = own.join(cut, list(key)).select(*own.columns, place("_blocks", 1).alias("block"), each("_chunks").alias("chunk"), F.lit(True).alias("own"))
    right = visits.join(cut, list(key)).select(*own.columns, each("_blocks").alias("block"), place("_chunks", 2).alias("chunk"), F.lit(False).alias("own"))
    return left.unionByName(right)


def work_through(met: DataFrame, key: Sequence[str], work: Work, shape: str) -> DataFrame:
    """``work(key, own rows, visiting rows)`` for every (key, block, chunk) that has both sides. Blocks come one
    after the other through each task, so a task holds one at a time."""
    names = [*key, "block", "chunk"]
    parts = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last: tuple | None = None

        def done() -> Iterator[pd.DataFrame]:
            rows = pd.concat(held, ignore_index=True)
            out = None if rows["own"].all() or not rows["own"].any() else work(last[: len(key)], rows[rows["own"]], rows[~rows["own"]])
            if out is not None and len(out):
                yield out

        for part in batches:
            keys = part[names].to_numpy(np.int64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(part)], strict=True):
                now = tuple(keys[lo].tolist())
                if held and now != last:
                    yield from done()
                    held = []
                last = now
                held.append(part.iloc[lo:hi])
        if held:
            yield from done()

    return met.repartition(parts, *names).sortWithinPartitions(*names).mapInPandas(run, shape)
