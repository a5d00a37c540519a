"""Decontamination, SimHash, packing, token counts: brute force on small tables with every odd case."""

import hashlib
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder.llm import decontaminate as dec
from larder.llm import packing, simhash
from larder.llm.sql import CONTAMINATION
from larder.llm.token_rollup import TokenRollup, bpe_tokens, word_tokens
from larder.llm.tokens import encoder, vocabulary
from tests.conftest import SMALL

DOCS = "doc_id long, text string, n_hit string, source string"
ITEM = "one two three four five six seven eight nine ten eleven twelve"


def brute_words(text):
    out, word = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(c) > 127:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out + [word] if word else out


def brute_hits(text, items, size=10):
    words, hit, found = brute_words(text), set(), set()
    for i, t in items:
        own = brute_words(t)
        n = min(size, len(own))
        for a in range(len(own) - n + 1 if own else 0):
            for b in range(len(words) - n + 1):
                if words[b : b + n] == own[a : a + n]:
                    hit.update(range(b, b + n))
                    found.add(str(i) if i is not None else "")
    return len(words), len(hit), sorted(found)


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [
        (1, f"Before. {ITEM.upper()}! After", "x", "a"), (2, ITEM.replace(" ", "\n--"), "x", "a"), (3, "one two three", "x", "a"),
        (4, None, None, None), (5, "", "x", "a"), (6, " .,;\t", "x", "a"), (7, "Straße été 東京 42", "x", "b"), (7, "Straße été 東京 42", "x", "b"),
        (None, "Straße été 東京 43", "x", "b"), (8, " ".join(["word"] * 30_000 + ITEM.split()[1:11] + ["x"] * 5), "x", "b"),
        (9, "eleven twelve one two three four five six seven eight nine ten eleven", "x", "b"), (10, "short item here and short item again", "x", "b"),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, "Short ITEM"), (3, None), (4, "..."), (5, "café"), (1, ITEM), (10, "two " + ITEM), (None, "43")], "item_id long, text string")


@pytest.mark.parametrize("block", [16_000_000, 200])
def test_decontamination_equals_brute_force(corpus, items, block):
    got = dec.decontaminate(corpus, items, block_chars=block)
    assert got.columns[:3] == ["doc_id", "text", "source"]  # a clashing n_hit is replaced
    suite = [(r.item_id, r.text) for r in items.collect()]
    for r in got.collect():
        count, hit, found = brute_hits(r.text, suite)
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (count, hit, found, hit > 0)
        covered = sum(len(brute_words(r.text[a:b])) for a, b in zip(r.char_start, r.char_end, strict=True))
        assert covered == hit


def test_decontamination_of_nothing(spark, corpus, items):
    assert not dec.decontaminate(corpus, items.limit(0)).filter("contaminated").count()
    assert dec.decontaminate(corpus.limit(0), items).count() == 0


def test_blanks_beyond_ascii_stay_inside_words(spark):
    duckdb = pytest.importorskip("duckdb")
    long = "le taux de 5\u00a0% a monté :\u00a0voir\u202fla page a\u2009b c\u0085d puis e f g h i"
    suite = [(1, "Paris\u00a0est"), (2, "東京\u3000都"), (3, long), (4, "paris est")]
    texts = ["vu: Paris\u00a0est là", "paris est", "in 東京\u3000都 now", "東京 都", f"x {long} y", long.replace("\u00a0", " "), "\u00a0", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(suite, "item_id long, text string")
    got = dec.decontaminate(docs, items).orderBy("doc_id").collect()
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == brute_hits(r.text, suite)
    assert [r["items"] for r in got[:5]] == [["1"], ["4"], ["2"], [], ["3"]]
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", items)):
        con.register(name, df.toPandas())
    want = {r[0]: r[1:] for r in con.execute(CONTAMINATION).fetchall()}
    digest = lambda x: hashlib.sha256(",".join(x).encode()).hexdigest()
    assert {r.doc_id: (r.n_words, r.n_hit, len(r["items"]), digest(r["items"]), r.contaminated) for r in got} == want


def brute_print(text):
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split(" ") if w]
    import xxhash

    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(corpus):
    for r in corpus.collect():
        assert simhash.fingerprint(r.text) % 2**64 == brute_print(r.text)
    assert simhash.fingerprint("Ａ b c d") % 2**64 == brute_print("Ａ b c d")


def brute_groups(fps, radius=2):
    name = list(range(len(fps)))

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    bits = np.array(fps, np.int64).view(np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(bits[i] ^ bits[:i]) <= radius):
            a, b = find(i), find(int(j))
            name[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize(("parts", "block", "visits"), [(1, 4096, 30000), (2, 8, 20), (4, 16, 50), (8, 4096, 30000)])
def test_links_keep_components(spark, parts, block, visits):
    rng = np.random.default_rng(5)
    fps = list(rng.integers(-(2**63), 2**63 - 1, 60, dtype=np.int64))
    for _ in range(240):
        x = np.uint64(fps[rng.integers(len(fps))])
        for b in rng.choice(64, rng.integers(1, 4), replace=False):
            x ^= np.uint64(1) << np.uint64(b)
        fps.append(x.view(np.int64))
    fps = sorted({int(f) for f in fps})
    names = brute_groups(fps)
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {f: f for f in fps} | {r.node: r.root for r in simhash.components(simhash.tile_links(nodes, 2, parts, block, visits)).collect()}
    assert got == {f: fps[n] for f, n in zip(fps, names, strict=True)}


def test_near_duplicates_and_keep_one(spark, corpus):
    base = [f"w{i % 97} v{i % 89}" for i in range(400)]
    near = spark.createDataFrame([(100 + i, " ".join(base[:-1] + [f"tail{i}"]), "x", "c") for i in range(6)], DOCS)
    docs = corpus.unionByName(near)
    found = simhash.near_duplicates(docs).collect()
    prints = [r.fp for r in found]
    groups = brute_groups(prints)
    ids = {}
    for r, g in zip(found, groups, strict=True):
        ids.setdefault(g, []).append(r.doc_id)
    smallest = {g: min((i for i in v if i is not None), default=None) for g, v in ids.items()}
    assert [r.component_id for r in found] == [smallest[g] for g in groups]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == sorted(-1 if s is None else s for s in smallest.values())
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_fill_respects_every_limit_and_wastes_little():
    rng = np.random.default_rng(1)
    limits = (1024, 6, 500)
    tokens = rng.integers(1, 1025, 700)
    sizes = np.stack([tokens, np.ones(700, np.int64), np.minimum(500, (tokens * rng.random(700)).astype(int))], axis=1)
    bins = packing.fill(sizes, limits)
    assert sorted(i for own in bins for i in own) == list(range(700))
    assert all((sizes[own].sum(axis=0) <= limits).all() for own in bins)
    assert len(bins) <= 1.1 * max(np.ceil(sizes.sum(axis=0) / limits))
    assert packing.fill(np.empty((0, 3), np.int64), limits) == []
    with pytest.raises(ValueError, match="limit"):
        packing.fill(np.array([[1, 1, 501]]), limits)


def test_sized_examples(spark):
    rows = [(i, 1 + i * 37 % 300, 1, None if i % 11 == 0 else i * 5 % 90, "clash") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, tokens long, segments long, loss long, slot string")
    got = packing.pack_sized(df, ["tokens", "segments", "loss"], (512, 4, 150), pool=64).toPandas()
    assert sorted(got["id"]) == list(range(300))
    sums = got.groupby("sequence_id")[["tokens", "segments", "loss"]].sum()
    assert (sums <= [512, 4, 150]).all().all()
    assert (got.groupby("sequence_id")["slot"].max() + 1 == got.groupby("sequence_id").size()).all()
    assert packing.pack_sized(df.limit(0), ["tokens", "segments", "loss"], (512, 4, 150)).count() == 0


def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_the_tokenizer():
    random.seed(3)
    texts = pd.read_parquet(f"{SMALL}/documents.parquet")["text"].tolist()
    odd = ["", " ", "\n\n  x", "\u0085  a b", "<|endoftext|> it's I'LL", "日本語　テスト", "🙂👩‍👩‍👧 ퟿", "a" * 5000, " " * 3000 + "x", "1234567 ½ ²³ Ⅷ", "\x00\x01\x7f"]
    odd += ["".join(chr(random.choice([random.randrange(32, 0x250), random.randrange(0x250, 0xD7FF), random.randrange(0xE000, 0x1F9FF)])) for _ in range(300)) for _ in range(80)]
    reference = [e.ids for e in tokenizer().encode_batch([*texts, *odd], add_special_tokens=False)]
    for name in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"):
        encode = encoder(vocabulary(name)).encode
        assert [encode(t) for t in [*texts, *odd]] == reference


def test_long_runs_of_white_space():
    texts = ["a" + " " * 50 + "b", " " * 40, "\n" * 30 + "x", "x" + " \u3000\t" * 20 + ", y" + " " * 60, "x \x1c\x1d" + " " * 33 + "'s", "a" * 90, " " * 21 + "\u200b" + " " * 25 + "1"]
    reference = [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]
    encode = encoder(vocabulary("byte_bpe_50k.json"), 20).encode
    assert [encode(t) for t in texts] == reference
    encode = encoder(vocabulary("byte_bpe_50k.json")).encode
    assert encode(" " * 2_000_000)[0] == encode("  " * 500)[0] and len(encode("a" + "\n" * 2_000_000 + "b c" * 400_000)) > 800_000


@pytest.mark.parametrize("pool", [8, 2048])
def test_packed_documents_are_whole(corpus, pool):
    got = packing.pack_documents(corpus, vocabulary("byte_bpe_50k.json"), limits=(64, 5, 64), pool=pool).toPandas()
    t = tokenizer()
    want = sorted((-1 if r.doc_id is None else r.doc_id, [*t.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in corpus.collect())
    got["doc_id"] = got["doc_id"].astype("Int64").fillna(-1)
    for number, ids in {i: x for i, x in want}.items():
        copies = sum(i == number for i, _ in want)
        own = got[got["doc_id"] == number].sort_values("start")
        assert (own["doc_tokens"] == len(ids)).all() and own["length"].sum() == copies * len(ids)
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert (got.groupby("sequence_id").size() <= 5).all() and (got.groupby("sequence_id")["length"].sum() <= 64).all()
    for _, own in got.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
    assert packing.pack_documents(corpus.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_small_partitions_cost_no_padding(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").repartition(100)
    got = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json")).toPandas()
    whole = got.groupby("sequence_id")["length"].sum()
    assert whole.max() <= 1024 and 1 - whole.mean() / 1024 < 0.01
    slots = got.sort_values(["sequence_id", "offset"])
    before = slots.groupby("sequence_id")["length"].cumsum() - slots["length"]
    assert (slots["offset"] == before).all() and (slots.groupby("sequence_id").cumcount() == slots["segment"]).all()


CHANGES = "source string, lang string, tokenizer string, kind string, tokens long, old_tokens long, n_docs string"


def test_rollup_equals_counting_anew(spark, tmp_path):
    store = TokenRollup(spark, str(tmp_path / "rollup"))
    rng = random.Random(2)
    state, expected = {}, {}
    for batch in range(4):
        rows = []
        for doc in range(60):
            key = (rng.choice(["a", "b", None]), rng.choice(["en", None]), "v1")
            if doc not in state:
                count = rng.choice([None, 0, rng.randrange(100)])
                state[doc] = (key, count or 0)
                rows.append((*key, "insert", count, None, "x"))
            elif rng.random() < 0.4:
                old_key, old = state.pop(doc)
                rows.append((*old_key, "delete", old, None, "x"))
            else:
                old_key, old = state[doc]
                new = rng.randrange(100)
                state[doc] = (old_key, new)
                rows.append((*old_key, "revise", new, old, "x"))
        frame = spark.createDataFrame(rows, CHANGES)
        assert store.commit(f"batch {batch}", frame) and not store.commit(f"batch {batch}", frame)
        expected = {}
        for key, n in state.values():
            docs, tokens = expected.get(key, (0, 0))
            expected[key] = (docs + 1, tokens + n)
        got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}
        assert got == expected
    assert store.commit("empty", frame.limit(0)) and store.holds("empty") and not store.holds("other")


def test_broken_commit_is_not_seen(spark, tmp_path):
    store = TokenRollup(spark, str(tmp_path / "r"))
    rows = spark.createDataFrame([("a", "en", "v1", "insert", 5, None, "x")], CHANGES)
    store.commit("one", rows)
    (tmp_path / "r" / "v=2").mkdir()
    (tmp_path / "r" / "v=2" / "part-0.parquet").write_bytes(b"half")
    assert store.commit("two", rows) and [tuple(r) for r in store.totals().collect()] == [("a", "en", "v1", 2, 10)]
    with pytest.raises(Exception, match="unknown kind"):
        store.commit("three", rows.withColumn("kind", F.lit(None).cast("string")))


def test_token_counters(corpus):
    t = tokenizer()
    rows = corpus.select("text", bpe_tokens(F.col("text"), vocabulary("byte_bpe_50k.tiktoken")).alias("b"), word_tokens(F.col("text")).alias("w")).collect()
    for r in rows:
        assert r.b == len(t.encode(r.text or "", add_special_tokens=False).ids) and r.w == len((r.text or "").split())


def test_op3_and_op4_digests(spark):
    from larder.llm.queries import op3_decontaminate, op4_simhash

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    windows = {}
    for i, t in items:
        own = brute_words(t)
        n = min(10, len(own))
        for a in range(len(own) - n + 1 if own else 0):
            windows.setdefault((n, tuple(own[a : a + n])), set()).add(str(i))
    sizes = {n for n, _ in windows}
    for r in op3_decontaminate(spark, SMALL).collect():
        words, hit, found = brute_words(docs[r.doc_id]), set(), set()
        for n in sizes:
            for b in range(len(words) - n + 1):
                own = windows.get((n, tuple(words[b : b + n])))
                if own:
                    hit.update(range(b, b + n))
                    found |= own
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(words), len(hit), len(found), digest, bool(hit))
    found = op4_simhash(spark, SMALL).collect()
    assert all(r.fingerprint == f"{brute_print(docs[r.doc_id]):016x}" for r in found) and len(found) == len(docs)
    names = brute_groups([np.uint64(int(r.fingerprint, 16)).view(np.int64) for r in found])
    first = {}
    for r, g in zip(found, names, strict=True):
        first[g] = min(first.get(g, r.doc_id), r.doc_id)
    assert [r.component_id for r in found] == [first[g] for g in names]
