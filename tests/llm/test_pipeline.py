"""The pipeline stage by stage against brute force, and over odd rows."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larder.llm import language
from larder.llm.language import UNKNOWN
from larder.llm.packing import pack_documents
from larder.llm.queries import op2_token_rollup, op6_reshard
from larder.llm.tokens import encoder, vocabulary
from tests.conftest import SMALL
from tests.llm.test_text_operators import brute_groups, brute_hits, brute_print

SHAPE = "doc_id long, text string, lang string, source string, n_chars long, score string, d string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "s", "d") for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    rows += [
        (90001, None, "en", "x", 0, None, "d"), (90002, "", None, None, None, None, "d"), (90003, "123 ... 456", "en", "x", 3, "s", "d"),
        (90004, f"the {item} there", "en", "x", 3, "s", "d"), (None, "Er ist nicht ein der das und in der die", "de", "x", 3, "s", "d"), (rows[0][:7]), (rows[0][:7]),
    ]
    return spark.createDataFrame(rows, SHAPE)


def test_stage_functions(spark, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "toxicity", "near_duplicates", "decontamination", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    spoken = stages["language"](spark, docs, SMALL)
    assert spoken.columns == docs.columns
    spoken = spoken.collect()
    assert len(spoken) == sum(any(c.isalpha() for c in r.text or "") for r in docs.collect()) and UNKNOWN == "und"

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = spark.createDataFrame(spoken, SHAPE)
    clean = {r.doc_id for r in stages["toxicity"](spark, rows, SMALL).collect()}
    judged = [r.doc_id for r in spoken if r.doc_id in labels]
    assert sum((i in clean) == (not labels[i]) for i in judged) >= 0.9 * len(judged)

    kept = stages["near_duplicates"](spark, docs, SMALL)
    assert kept.columns == docs.columns
    every = docs.collect()
    prints = [brute_print(r.text) for r in every]
    groups = brute_groups([p - 2**64 if p >= 2**63 else p for p in prints])
    first = {}
    for r, g in zip(every, groups, strict=True):
        known = first.get(g)
        first[g] = r.doc_id if known is None else known if r.doc_id is None else min(known, r.doc_id)
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, first.values()))

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    some = docs.filter("doc_id < 60 or doc_id > 90000 or doc_id is null")
    left = stages["decontamination"](spark, some, SMALL)
    assert left.columns == docs.columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in some.collect() if not brute_hits(r.text, items)[1])


def test_run_writes_and_packs_what_stays(spark):
    encode = encoder(vocabulary("byte_bpe_50k.json")).encode
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = corpus_pipeline.run(spark, SMALL).toPandas()
    assert 0 < got["doc_id"].nunique() < len(texts)
    for i, own in got.groupby("doc_id"):
        assert own["length"].sum() == len(encode(texts[i])) + 1
    assert got.groupby("sequence_id")["length"].sum().max() <= 1024


def test_language_stage_keeps_what_it_cannot_judge(spark, docs, monkeypatch):
    stage = dict(corpus_pipeline.STAGES)["language"]
    nameless = docs.withColumn("lang", F.lit(None).cast("string"))
    assert stage(spark, nameless, SMALL).count() == docs.count()
    monkeypatch.setattr(corpus_pipeline, "SURER", 3.6)  # nine tenths of certainty, with four languages
    net = language.learn(docs, "text", "lang", "doc_id")
    scores = [r.score for r in language.identify(docs, net).filter("lang_pred <> 'und'").collect()]
    assert stage(spark, docs, SMALL).count() == sum(s >= 3.6 / len(net.labels) for s in scores) < len(scores)


def test_near_duplicates_with_clashing_columns(spark):
    odd = spark.createDataFrame([(1, "a b c d", "x", 1, 2), (2, "a b c d", "y", 3, 4)], "doc_id long, text string, _hash string, _i int, _row int")
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, odd, SMALL)
    assert kept.schema == odd.schema and [tuple(r) for r in kept.collect()] == [(1, "a b c d", "x", 1, 2)]


def test_resharding_with_clashing_columns(spark, tmp_path):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").limit(50)
    rows.withColumn("old_shard", F.lit("a")).withColumn("source_file", F.lit(1)).withColumn("source_row", F.lit(2)).write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_reshard(spark, str(tmp_path)).toPandas()
    assert len(got) == 50 and (got.groupby("shard")["slot"].max() + 1 == got.groupby("shard").size()).all()


def test_token_totals_equal_counting(spark, tmp_path):
    texts = ["a b c", "a b c", "a  b-c", None, "", "a b c", "x"]
    rows = [(i, t, "en" if i % 2 else None, "s", 0) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in op2_token_rollup(spark, str(tmp_path)).collect()}
    stay = [(lang, t) for i, t, lang, *_ in rows if t is None or texts.index(t) == i]
    words = lambda t: len(re.findall(r"[^\W_]+", t or ""))
    for lang in (None, "en"):
        own = [t for k, t in stay if k == lang]
        assert got[(lang, "words")] == (len(own), sum(map(words, own)))
        assert got[(lang, "byte_bpe_50k")][0] == len(own)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SMALL).count() == 0, name
    assert pack_documents(none, vocabulary("byte_bpe_50k.json")).count() == 0
