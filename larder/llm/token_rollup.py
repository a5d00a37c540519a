"""Token counts as delta-maintained rollups.

Totals by source, language and tokenizer version are kept up to date by signed changes: an insert adds a
document and its tokens, a delete takes them away, a revised count adds the difference. Totals are
additive, so a batch is reduced to one row per key before it meets them, and documents counted
before are not read again.

A store is a folder of versions. A commit writes the new totals, together with the ids of the batches in
them, as the next version; Parquet's ``_SUCCESS`` mark makes it visible. A batch that is already in the
totals changes nothing; one whose write broke off has no mark, is not seen, and is written anew. One
writer at a time is assumed, as with any folder of files.

Scale: a commit shuffles one row per key and task; a hot source is summed before the shuffle. The driver
sees names of versions only.

Defined results: null sources, languages and versions are keys of their own; null counts are zero; a change
with an unknown or null kind raises an error; repeated rows each count; an empty batch is committed as
such; keys whose documents and tokens have come to zero are left out. Other columns are not used.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("source", "lang", "tokenizer")
_TOTALS = "source string, lang string, tokenizer string, n_docs long, n_tokens long, batch string"


def bpe_tokens(text: Column, path: str) -> Column:
    """Tokens of whole texts by a byte-level vocabulary; a null text has none."""
    from larder.llm.tokens import encoder

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        encode = encoder(path).encode
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return run(text)


def word_tokens(text: Column, pattern: str = r"\S+") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def deltas(changes: DataFrame) -> DataFrame:
    """One signed row per key. ``changes``: ``source``, ``lang``, ``tokenizer``, ``kind`` (insert, delete, revise),
    ``tokens`` (of a revision: the new count) and ``old_tokens`` (of a revision: the count before)."""
    kind, tokens, old = F.col("kind"), F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    unknown = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce(kind, F.lit("null"))))
    docs = F.when(kind == "insert", 1).when(kind == "delete", -1).when(kind == "revise", 0).otherwise(unknown.cast("int"))
    amount = F.when(kind == "insert", tokens).when(kind == "delete", -tokens).otherwise(tokens - old)
    return changes.groupBy(*KEYS).agg(F.sum(docs).cast("long").alias("n_docs"), F.sum(amount).cast("long").alias("n_tokens"))


class TokenRollup:
    """Totals under one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _versions(self) -> list[int]:
        """Numbers of complete versions."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = root.getFileSystem(conf)
        if not files.exists(root):
            return []
        found = [re.fullmatch(r"v=(\d+)", s.getPath().getName()) for s in files.listStatus(root)]
        numbers = sorted(int(m[1]) for m in found if m)
        return [n for n in numbers if files.exists(jvm.org.apache.hadoop.fs.Path(f"{self._path(n)}/_SUCCESS"))]

    def _path(self, version: int) -> str:
        return f"{self.folder}/v={version}"

    def _rows(self) -> tuple[int, DataFrame]:
        versions = self._versions()
        if not versions:
            return 0, self.spark.createDataFrame([], _TOTALS)
        return versions[-1], self.spark.read.schema(_TOTALS).parquet(self._path(versions[-1]))

    def totals(self) -> DataFrame:
        return self._rows()[1].filter("batch is null").drop("batch")

    def holds(self, batch: str) -> bool:
        return not self._rows()[1].filter(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Bring a batch into the totals; False if it is in them already."""
        version, rows = self._rows()
        if not rows.filter(F.col("batch") == batch).isEmpty():
            return False
        sums = rows.filter("batch is null").drop("batch").unionByName(deltas(changes)).groupBy(*KEYS).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
        )
        mark = self.spark.createDataFrame([(None, None, None, None, None, batch)], _TOTALS)
        new = sums.filter("n_docs <> 0 or n_tokens <> 0").withColumn("batch", F.lit(None).cast("string"))
        batches = rows.filter("batch is not null").unionByName(mark)
        new.unionByName(batches).hint("rebalance").write.mode("overwrite").parquet(self._path(version + 1))
        return True
