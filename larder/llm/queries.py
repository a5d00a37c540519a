"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import language, quality, toxicity
from larder.llm.chat import format_chats
from larder.llm.decontaminate import decontaminate
from larder.llm.gnat import hard_negatives
from larder.llm.hamming_search import search, sign_code
from larder.llm.importance import resample
from larder.llm.packing import pack_documents
from larder.llm.resharding import reshard, rewrite
from larder.llm.simhash import hex_digits, near_duplicates
from larder.llm.sql import SQL
from larder.llm.token_rollup import TokenRollup, bpe_tokens, word_tokens
from larder.llm.tokens import vocabulary
from larder.llm.url_filter import attach, judge_urls
from larder.workspace import Workspace, cut_lineage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes not to clash with ``columns``."""
    known = {c.lower() for c in columns}
    out = []
    for name in names:
        while name in known:
            name = f"_{name}"
        out.append(name)
    return out


def op1_chat(spark: SparkSession, folder: str) -> DataFrame:
    return format_chats(table(spark, folder, "conversations"))


def op2_token_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """All documents are inserted with two tokenizer versions, exact copies are deleted, and the word counts of
    what stays are revised to a new definition of words; every batch is sent twice."""
    docs = table(spark, folder, "documents")
    counted = cut_lineage(docs.select(
        "doc_id", "source", "lang", F.md5("text").alias("digest"), bpe_tokens(F.col("text"), vocabulary("byte_bpe_50k.tiktoken")).alias("bpe"),
        word_tokens(F.col("text")).alias("words"), word_tokens(F.col("text"), r"[\p{L}\p{N}]+").alias("new_words"),
    ))
    firsts = counted.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("uses"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    # A text with over a thousandth of the rows is met by broadcast, so none makes one large task.
    met = attach(counted.filter("digest is not null"), firsts, ["digest"], "uses").unionByName(counted.filter("digest is null").withColumn("first", F.lit(None).cast("long")))
    known = cut_lineage(met.withColumn("copy", copy).drop("digest", "first"))

    def changes(kind: str, rows: DataFrame, counts: dict[str, tuple[str, str]]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(t).alias("tokenizer"), F.col(a).alias("tokens"), F.col(b).alias("old_tokens")) for t, (a, b) in counts.items()])
        return rows.select("source", "lang", F.lit(kind).alias("kind"), F.explode(each).alias("x")).select("source", "lang", "kind", "x.*")

    both = {"byte_bpe_50k": ("bpe", "bpe"), "words": ("words", "words")}
    batches = {
        "load": changes("insert", known, both),
        "copies": changes("delete", known.filter("copy"), both),
        "new words": changes("revise", known.filter("not copy"), {"words": ("new_words", "words")}),
    }
    rollup = TokenRollup(spark, Workspace(spark, f"op2 {uuid.uuid4()}").path("rollup"))
    for name, rows in batches.items():
        rollup.commit(name, rows)
        rollup.commit(name, rows)
    return rollup.totals()


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontaminate(docs, table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op5_hamming(spark: SparkSession, folder: str) -> DataFrame:
    """Ten nearest sign codes of every row whose id is divisible by 20, against all rows."""
    codes = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), sign_code("embedding").alias("code"))
    return search(codes, codes.filter(F.col("id") % 20 == 0), 10)


def op6_reshard(spark: SparkSession, folder: str) -> DataFrame:
    """From shards by source, of which one holds a third of the rows, to 16 shards of equal bytes. Whole rows of
    affected shards are written anew, and the result is read from their files; rows are known by file and place."""
    shape = [
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
    ]
    docs = table(spark, folder, "documents")
    old, *row = unused(docs.columns, "old_shard", "source_file", "source_row")
    docs = docs.select(
        "*", F.pmod(F.crc32(F.coalesce("source", F.lit(""))), F.lit(16)).cast("int").alias(old),
        F.col("_metadata.file_path").alias(row[0]), F.col("_metadata.row_index").alias(row[1]),
    )
    space = Workspace(spark, f"op6 {uuid.uuid4()}")
    placed = space.write(reshard(docs.select("doc_id", *shape, old, *row), old, "size", ["doc_id", "text_crc32", *row]), "placed")
    touched = rewrite(docs, placed, row, old, space.path("shards"))
    named = ["doc_id", "size", "text_crc32", "shard", "slot", old]
    found = placed.filter(~F.col("shard").isin(touched)).select(*named)
    if touched:
        written = spark.read.schema(docs.drop("shard", "slot").schema.add("slot", "long").add("shard", "integer")).parquet(space.path("shards"))
        found = written.select("doc_id", *shape, "shard", "slot", old).unionByName(found)
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.col(old).alias("old_shard"),
    )


def op7_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = language.remainder("doc_id", 4) == 2
    net = language.learn(docs.filter(~held_out), "text", "lang", "doc_id")
    return language.identify(docs, net).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "positions")


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = judge_urls(table(spark, folder, "pages").select("page_id", "url", "html"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "host_segments", "path_segments", "score")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = language.remainder("doc_id", 5) == 0
    model = toxicity.learn(docs, table(spark, folder, "labels").filter(~held_out))
    return toxicity.judge(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_pack(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"))


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 100; where it is divisible by 7, the label is moved by one first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, folder, "embeddings"), F.col("id") % 100 == 0, label=label)


def op12_resample(spark: SparkSession, folder: str) -> DataFrame:
    found = resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op13_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return quality.judge(docs, quality.learn(docs, table(spark, folder, "labels"))).drop("text")


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat": op1_chat, "op2_token_rollup": op2_token_rollup, "op3_decontaminate": op3_decontaminate, "op4_simhash": op4_simhash, "op5_hamming": op5_hamming, "op6_reshard": op6_reshard, "op7_language": op7_language,
        "op8_url_filter": op8_url_filter, "op9_toxicity": op9_toxicity, "op10_pack": op10_pack,
        "op11_hard_negatives": op11_hard_negatives, "op12_resample": op12_resample, "op13_quality": op13_quality,
    }


def llm_sql() -> dict[str, str]:
    return SQL
