"""Where intermediate tables live, and how lineage is cut.

Everything lands in the shared folder the cluster names in ``spark.checkpoint.dir``, so a
lost executor never takes the only copy with it. Only a local master may fall back to a
folder of its own.
"""

from __future__ import annotations

import atexit
import hashlib
import shutil
import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK: dict[str, str] = {}
CODEC = "zstd"  # written once and read a few times, so space counts more than the time to pack it
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; only on a local master a temporary one, which goes when Python ends."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_FALLBACK:
        _LOCAL_FALLBACK[app] = tempfile.mkdtemp(prefix="larder-")
        atexit.register(shutil.rmtree, _LOCAL_FALLBACK[app], ignore_errors=True)
    return _LOCAL_FALLBACK[app]


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files: else they stay until the driver happens to collect its garbage, those
    of one table beside those of the next. If a file is wanted again after all, its stage runs again."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written once and every later read sees the same ones."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    with freed_shuffles(spark):
        return df.select("*").checkpoint(eager=True)  # a plan of its own: whether it frees its files is settled when a plan is made


def in_turn(parts: Sequence[DataFrame], at_once: int) -> DataFrame:
    """The rows of small results, worked out a few at a time.

    As one plan they would all hold their shuffle files until the last is done, and adaptive execution would look through
    the whole plan again after every stage of any of them.
    """
    groups = [parts[i : i + at_once] for i in range(0, len(parts), at_once)]
    return reduce(DataFrame.unionByName, [cut_lineage(reduce(DataFrame.unionByName, g).coalesce(1)) for g in groups])


class Workspace:
    """A namespace of written tables under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        digest = hashlib.sha1(name.encode()).hexdigest()[:12]
        app = spark.sparkContext.applicationId
        self.root = f"{shared_folder(spark)}/larder/{app}/{digest}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def remove(self) -> None:
        """Delete the tables of this namespace; frames that read them are of no use afterwards."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def write(self, df: DataFrame, table: str, day: str | None = None) -> DataFrame:
        """Write ``df`` and hand back a scan of it, with its statistics known to the planner.

        With ``day`` each value of that column is a partition: rows come together by day, adaptive execution splits
        a day that is larger than the advisory partition size, and filters on the day read only its folders.
        """
        path = self.path(table)
        with freed_shuffles(self.spark):
            if day is None:
                df.write.mode("overwrite").option("compression", CODEC).parquet(path)
            else:
                rows = df.hint("rebalance", day).write.mode("overwrite").option("partitionOverwriteMode", "static")
                rows.option("compression", CODEC).partitionBy(day).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)
