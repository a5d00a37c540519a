"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; its result is
written as Parquet in the shared folder and read again by the next. All stages but the last return the
columns of ``documents``. No SQL expresses the trained stages; tests compare each with brute force.

Nulls, empty texts and repeated rows: a null text, or one without a letter, is rejected by the language
stage, so later stages see none (only if no row has a language to learn from, all stay); rows that repeat are one near-duplicate group and one of them stays;
an empty table gives no pieces.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import language, toxicity
from larder.llm.decontaminate import decontaminate
from larder.llm.packing import pack_documents
from larder.llm.simhash import keep_one
from larder.llm.tokens import vocabulary
from larder.workspace import Workspace

#: The least pooled probability of a document's language, as a multiple of chance.
SURER = 1.4
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is undetermined go: those without a letter, and those on which the network is hardly
    surer than chance. Where no document has a language, there is nothing to learn from and all stay."""
    net = language.learn(docs, "text", "lang", "doc_id")
    if net is None:
        return docs
    judged = language.identify(docs.select(F.struct(*docs.columns).alias("d"), "text"), net)
    return judged.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= SURER / len(net.labels))).select("d.*")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = toxicity.judge(docs.select(F.struct(*docs.columns).alias("d"), "text"), model)
    return judged.filter(F.col("predicted") == 0).select("d.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays: the one with the smallest id."""
    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    judged = decontaminate(docs.select(F.struct(*docs.columns).alias("d"), "text"), items)
    return judged.filter(~F.col("contaminated")).select("d.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of sequences of 1024 tokens."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the result of the last."""
    space = Workspace(spark, f"pipeline {uuid.uuid4()}")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = space.write(stage(spark, docs, sf_dir), name)
    return docs
