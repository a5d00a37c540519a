"""Importance resampling towards a target distribution, and the distributed quickselect that draws the winners.

Features are runs of 1 to ``grams`` words; each falls into one of ``buckets`` buckets by its crc32. A bucket's
gain is the logarithm of its share in the target over its share in the documents (with add-one smoothing), in
thousandths; a document's weight is the mean gain of its features. Adding Gumbel noise, which a hash of the id
decides, turns the highest scores into a draw without replacement in proportion to the weights.

The k-th composite key (score, id, ...) is found without sorting: a few random pivot keys, one aggregate that
counts exactly what lies below and at each, and the interval that holds the k-th key is all that the next round
looks at. Every round takes its own pivots out, so the search ends. Only the winners are sorted and ranked.

Scale: texts are read twice in Arrow batches; a task returns one array of ``buckets`` counts, and the summed
array (of bounded size) is what scoring uses. Keys lie in a written table; a round reads the part between two
pivots. Winners are ranged by key, and one row count a range gives the ranks.

Defined results: a null or empty text has no features and weight 0; an empty target or an empty table gives
gains by smoothing alone; a null id is hashed as an empty one and comes last among equal scores; repeated rows
take part one by one, in any order; documents under ``min_words`` words are scored but never drawn. The kept
columns of the documents come first; those that are called like a result are replaced by it.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from larder.llm.decontaminate import words
from larder.workspace import Workspace, cut_lineage

BUCKETS = 10_000
GRAMS = 1
MIN_WORDS = 20
SEED = "2024"
PIVOTS = 15
_KNOWN = 500_000
_RESULTS = ("n_words", "n_features", "weight", "score", "rank")


class Buckets(dict):
    """The bucket of a feature, worked out once for each."""

    def __init__(self, count: int):
        super().__init__()
        self.count = count

    def __missing__(self, feature: bytes) -> int:
        if len(self) > _KNOWN:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.count
        return found


def features(text: str | None, grams: int = GRAMS) -> tuple[list[bytes], int]:
    """All runs of 1 to ``grams`` words, and the number of words."""
    found = [w for w in words(text) if w]
    runs = [b" ".join(found[i : i + n]) for n in range(2, grams + 1) for i in range(len(found) - n + 1)]
    return found + runs, len(found)


def bucket_totals(docs: DataFrame, text: str, buckets: int = BUCKETS, grams: int = GRAMS) -> np.ndarray:
    """Features of all documents by bucket."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, place = np.zeros(buckets, np.int64), Buckets(buckets)
        for part in batches:
            for t in part["t"]:
                if at := list(map(place.__getitem__, features(t, grams)[0])):
                    np.add.at(total, at, 1)
        yield pd.DataFrame({"n": [total]})

    parts = docs.select(F.col(text).alias("t")).mapInPandas(count, "n array<long>")
    summed = parts.select(F.posexplode("n").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in summed.collect():  # one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed shares, in doubles."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    n = len(source)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def score_documents(docs: DataFrame, gain: np.ndarray, text: str, grams: int = GRAMS) -> DataFrame:
    """``docs`` with a struct ``_found`` (n_words, n_features, weight)."""
    count = len(gain)

    @F.pandas_udf("n_words long, n_features long, weight long")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        place = Buckets(count)
        for texts in parts:
            out = np.zeros((len(texts), 3), np.int64)
            for i, t in enumerate(texts):
                found, n = features(t, grams)
                if found:
                    out[i] = n, len(found), int(gain[list(map(place.__getitem__, found))].sum()) // len(found)
            yield pd.DataFrame(out, columns=["n_words", "n_features", "weight"])

    return docs.withColumn("_found", judge(F.col(text)))


def gumbel(ident: Column, seed: str = SEED) -> Column:
    """Noise in thousandths, decided by the id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def _key_value(row: Row, rows: DataFrame, names: Sequence[str]) -> Column:
    return F.struct(*[F.lit(row[n]).cast(rows.schema[n].dataType).alias(n) for n in names])


def kth_key(rows: DataFrame, names: Sequence[str], k: int, pivots: int = PIVOTS, seed: int = 0) -> Row | None:
    """The ``k``-th smallest (from 1) of the keys made of the columns ``names``; None if there are fewer rows."""
    key = F.struct(*names)
    inside, below, turn = rows, 0, 0
    while True:
        turn += 1
        picks = inside.select(*names).orderBy(F.xxhash64(*names, F.lit(seed + turn))).limit(pivots).distinct().orderBy(*names).collect()
        if not picks or k < 1:
            return None
        at = [_key_value(p, rows, names) for p in picks]
        hit = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
        # Exact three-way counts: what lies under each pivot, what equals it; the rest lies over it.
        counts = inside.agg(*[hit(key < v).alias(f"less{i}") for i, v in enumerate(at)], *[hit(key == v).alias(f"equal{i}") for i, v in enumerate(at)]).first()
        low = high = None
        lowest = below
        for i, pick in enumerate(picks):
            upto = below + counts[f"less{i}"]
            if k <= upto:
                high = i
                break
            if k <= upto + counts[f"equal{i}"]:
                return pick
            low, lowest = i, upto + counts[f"equal{i}"]
        # The first column is compared by itself too: that reaches the scan of a written table.
        if low is not None:
            inside = inside.filter((F.col(names[0]) >= picks[low][names[0]]) & (key > at[low]))
        if high is not None:
            inside = inside.filter((F.col(names[0]) <= picks[high][names[0]]) & (key < at[high]))
        below = lowest


def ranked(rows: DataFrame, names: Sequence[str], rank: str) -> DataFrame:
    """``rows`` with their place from 1 in the order of ``names``, which no two rows share."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *names).sortWithinPartitions(*names)
    # The high bits of the number are the range, the low 33 the place in it.
    placed = cut_lineage(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_range")).agg(F.count("*").alias("_n"))
    # One row a range, so this window and the broadcast are bounded by the number of partitions.
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inner = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.withColumn("_range", part).join(F.broadcast(starts), "_range")
    return out.withColumn(rank, F.col("_before") + inner + 1).drop("_range", "_before", "_at")


def resample(
    docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), ident: str = "doc_id", text: str = "text", target_text: str = "text",
    keep: Sequence[str] | None = None, buckets: int = BUCKETS, grams: int = GRAMS, min_words: int = MIN_WORDS, seed: str = SEED,
) -> DataFrame:
    """All of ``docs`` (the columns ``keep``, else all) with n_words, n_features, weight, score and rank; of the documents
    with ``min_words`` words, ``share[0]`` in ``share[1]`` have a rank, the others a null."""
    gain = gains(bucket_totals(docs, text, buckets, grams), bucket_totals(target, target_text, buckets, grams))
    kept = [c for c in (docs.columns if keep is None else keep) if c not in _RESULTS]
    rows = docs.select(F.struct(*kept).alias("row"), F.col(ident).alias("id"), F.col(text).alias("text"))
    scored = score_documents(rows, gain, "text", grams).select(
        "row", "id", "_found.*", F.monotonically_increasing_id().alias("place"), (F.col("_found.weight") + gumbel(F.col("id"), seed)).alias("score")
    ).select("*", (-F.col("score")).alias("down"), F.col("id").isNull().alias("no_id"))
    table = Workspace(docs.sparkSession, f"importance {uuid.uuid4()}").write(scored, "scored")
    able = table.filter(F.col("n_words") >= min_words)
    names = ["down", "no_id", "id", "n_features", "place"]
    k = share[0] * able.count() // share[1]
    last = kth_key(able.select(*names), names, k)
    results = [c for c in _RESULTS if c != "rank"]
    if last is None:
        return table.select("row.*", *results, F.lit(None).cast("long").alias("rank"))
    won = (F.col("n_words") >= min_words) & (F.struct(*names) <= _key_value(last, table, names))
    winners = ranked(table.filter(won), names, "rank").select("row.*", *results, "rank")
    return winners.unionByName(table.filter(~won).select("row.*", *results, F.lit(None).cast("long").alias("rank")))
