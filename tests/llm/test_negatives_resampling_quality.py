"""Hard negatives, importance resampling and quality rules against brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from larder.llm import gnat, importance, quality
from tests.conftest import SMALL

VECTORS = "vec_id long, embedding array<double>, label int, id string, leaf string, windows int, vec string"


def brute_negatives(rows, positives=5, negatives=5):
    known = {}
    for vec_id, v, label, *_ in rows:
        if vec_id is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            known[(vec_id, label, tuple(math.floor(256 * x) for x in v))] = None
    known = sorted(known)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in known:
        if a[0] % 10:
            continue
        others = [(-dot(a[2], b[2]), *b) for b in known if b[0] != a[0]]
        for minus, pid, *_ in sorted(o for o in others if o[2] == a[1])[:positives]:
            fits = sorted(o for o in others if o[2] != a[1] and 80 * -minus <= 100 * -o[0] <= 100 * -minus)
            out += [(a[0], pid, r + 1, o[1], -minus, -o[0]) for r, o in enumerate(fits[:negatives])]
    return sorted(out)


def clustered(count, seed, labels=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, 6))
    out = []
    for i in range(count):
        v = centres[rng.integers(9)] + 0.2 * rng.normal(size=6)
        out.append((i, (v / np.linalg.norm(v)).tolist(), int(rng.integers(labels)), "x", "y", 1, "z"))
    return out


def odd_rows():
    base = clustered(60, 3)
    same = base[10][1]
    return base + [
        (100, None, 1, None, None, None, None), (101, [0.1, None, 0.0, 0.0, 0.0, 0.0], 1, None, None, None, None), (102, [math.nan] * 6, 1, None, None, None, None),
        (103, [math.inf] + [0.0] * 5, 1, None, None, None, None), (104, [0.5], 1, None, None, None, None), (105, [], 1, None, None, None, None),
        (None, [0.1] * 6, 1, None, None, None, None), (107, [0.1] * 6, None, None, None, None, None), base[10], base[10],
        *[(200 + i, same, i % 3, None, None, None, None) for i in range(30)], (10, base[11][1], 2, None, None, None, None),
    ]


@pytest.mark.parametrize(("rows", "shape"), [
    (clustered(400, 1), {"sample": 150, "fanout": 4, "leaf_rows": 20}), (clustered(300, 2, labels=60), {"fanout": 3, "leaf_rows": 10}),
    (odd_rows(), {"fanout": 3, "leaf_rows": 8}),
])
def test_hard_negatives_equal_brute_force(spark, rows, shape):
    table = spark.createDataFrame(rows, VECTORS)
    got = gnat.hard_negatives(table, F.col("id") % 10 == 0, **shape)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)


def test_hard_negatives_edges(spark):
    table = spark.createDataFrame(clustered(30, 4), VECTORS)
    assert gnat.hard_negatives(table.limit(0), F.col("id") % 10 == 0).count() == 0
    assert gnat.hard_negatives(table, F.col("id") < 0).count() == 0
    big = spark.createDataFrame([(0, [1e9], 1), (1, [1e9], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="exact"):
        gnat.hard_negatives(big, F.col("id") == 0)


def test_blocks_and_chunks_change_nothing(spark, monkeypatch):
    rows = clustered(300, 5)
    monkeypatch.setattr(gnat, "BLOCK", 40)
    monkeypatch.setattr(gnat, "CHUNK", 7)
    got = gnat.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("id") % 10 == 0, fanout=2, leaf_rows=100)
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows)


def test_ranges_pass_leaves_over_without_loss():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 8)) * 1000
    rows = centres[rng.integers(12, size=3000)] + rng.normal(size=(3000, 8)) * 20
    tree = gnat.Tree.fit(rows[:600], len(rows), fanout=6, leaf_rows=100)
    ranges = {}
    home = tree.homes(rows, ranges)
    for node in tree.nodes:
        node.low, node.high = ranges[node.number]
    queries = rows[::50] + 5
    near = gnat.distances(queries, rows)
    inner, outer = np.full((len(queries), 1), 30.0), np.full((len(queries), 1), 120.0)
    who, leaf = tree.reached(queries, inner, outer)
    visited = set(zip(who.tolist(), leaf.tolist(), strict=True))
    assert len(visited) < len(queries) * tree.leaves / 3  # most siblings are eliminated
    for q, r in zip(*np.nonzero((near >= 30) & (near <= 120)), strict=True):
        assert (q, home[r]) in visited


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_resample(docs, target, buckets, min_words, share, seed="2024"):
    at = lambda w: zlib.crc32(w.encode()) % buckets
    words = [[at(w) for w in WORD.findall(fold(t))] for _, t in docs]
    s, t = np.zeros(buckets, int), np.zeros(buckets, int)
    for found in words:
        np.add.at(s, found, 1)
    for text in target:
        np.add.at(t, [at(w) for w in WORD.findall(fold(text))], 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    out = []
    for (ident, _), found in zip(docs, words, strict=True):
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        out.append([ident, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    ranks = {id(r): i + 1 for i, r in enumerate(able[: share[0] * len(able) // share[1]])}
    return sorted(((*r, ranks.get(id(r))) for r in out), key=str)


def documents():
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "naïve", "x1", "日本"]
    rows = [(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(200)]
    return rows + [(500, None), (501, ""), (502, ".,;"), (None, " ".join(vocabulary)), (None, "w1 " * 30), (7, rows[7][1]), (7, "other words " * 20), (503, "W1, w2 w3 " * 5000)]


@pytest.mark.parametrize(("share", "pivots"), [((10, 100), 15), ((1, 3), 1), ((0, 100), 3), ((100, 100), 2)])
def test_resampling_equals_brute_force(spark, monkeypatch, share, pivots):
    monkeypatch.setattr(importance, "PIVOTS", pivots)
    target = ["w1 w2 w3 été", None, "w1 " * 20]
    docs = spark.createDataFrame([(*r, "a", 1) for r in documents()], "doc_id long, text string, rank string, row int")
    items = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(docs, items, share, buckets=50, keep=["doc_id"])
    rows = sorted(((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect()), key=str)
    assert rows == brute_resample(documents(), target, 50, 20, share)


def test_resampling_edges(spark):
    docs = spark.createDataFrame([(*r, "a", 1) for r in documents()], "doc_id long, text string, rank string, row int")
    none = spark.createDataFrame([], "text string")
    assert importance.resample(docs.limit(0), none).count() == 0
    got = importance.resample(docs, none, grams=2)
    assert got.count() == len(documents()) and {"text", "row", "rank"} <= set(got.columns)
    assert got.filter("row = 1").count() == len(documents())
    text = got.filter("doc_id = 503").first()
    assert (text.n_words, text.n_features) == (10000, 19999)


@pytest.mark.parametrize("pivots", [1, 4])
def test_kth_key_among_ties(spark, pivots):
    values = [3] * 40 + [1, 2, None, 5, 5] + list(range(10, 30))
    rows = spark.createDataFrame([(v, i % 3) for i, v in enumerate(values)], "a int, b int")
    order = sorted((r.a is not None, r.a or 0, r.b) for r in rows.collect())
    for k in (1, 2, 30, 42, len(values)):
        got = importance.kth_key(rows.withColumn("there", F.col("a").isNotNull()), ["there", "a", "b"], k, pivots)
        assert (got.there, got.a or 0, got.b) == order[k - 1]
    assert importance.kth_key(rows, ["b"], len(values) + 1) is None and importance.kth_key(rows, ["b"], 0) is None


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = collections.Counter(runs)
    covered = {j for i, r in enumerate(runs) if often[r] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    earlier = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), earlier, len(covered)


def odd_texts():
    rng = np.random.default_rng(2)
    few = ["a", "b", "ü", "c d", "#x", "日本語"]
    return [
        None, "", " ", "\n\n", "\x0b\x0c\r", "one", "a b\na b\n a b\n\na b", "x " * 7, "x " * 8, "x " * 9, "a b\x85c", "𝒳𝒴 é|<>&%$*#",
        *["".join(rng.choice([*few, *few, " ", " ", "\n", "\t"], rng.integers(1, 300))) for _ in range(60)],
        *[" ".join(rng.choice(few, rng.integers(1, 80))) for _ in range(60)], "lang " * 40_000, "z" * 70_000, " ".join(map(str, range(30_000))) * 2,
    ]


@pytest.mark.parametrize("size", [1 << 19, 1000, 7])
def test_counts_equal_brute_force(size):
    texts = [t for t in odd_texts() if size > 7 or len(t or "") < 1000]
    got = quality.measure(texts, None, size)
    expected = [brute_counts(t) for t in texts]
    assert [tuple(r) for r in got[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]].to_numpy().tolist()] == expected
    failed = [n < 20 or 100 * r > 30 * n for n, *_, r in expected]
    assert got["base_failed"].tolist() == failed and got["kept"].tolist() == [not f for f in failed]


def plain_slots(text):
    """Words and n-grams of a text, read one by one."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    padded = [f" {w} " for w in words]
    return words, list(zip(words, words[1:], strict=False)), [p[i : i + n] for p in padded for n in quality.CHARS for i in range(len(p) - n + 1)]


def test_ngrams_are_those_of_padded_words():
    text = "Ab ü cde\n\tab  Ab ü x"
    words, pairs, chars = plain_slots(text)
    by_gram = {}
    for cut in (1 << 19, 5):
        ((_, parts, hashes, owner, _),) = quality.read([text], cut)
        parts = [s for s, _ in parts]
        slots = quality.word_slots(hashes, owner)[0]
        assert len(hashes) == len(words) and len(slots) == len(words) + len(pairs) and sum(map(len, parts)) == len(chars)
        assert len(set(hashes.tolist())) == len(set(words))
        by_gram[cut] = sorted(np.concatenate(parts).tolist()), slots.tolist()
    assert by_gram[1 << 19] == by_gram[5]  # cutting a long text changes no n-gram
    one = lambda t: collections.Counter(np.concatenate([s for s, _ in next(quality.read([t]))[1]]).tolist())
    whole = collections.Counter()
    for w in words:
        whole += one(w)
    assert whole == one(text)


def test_scores_equal_weights_times_rates():
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=quality.SLOTS), 0.3, 0.7, -0.1)
    texts = [t for t in odd_texts() if t]
    for size in (1 << 19, 200):
        got = quality.measure(texts, model, size)
        for t, p in zip(texts, got["probability"], strict=True):
            at, rate = quality.sparse(t)
            z = model.base + float(model.weights[at] @ rate.astype(float))
            assert p == pytest.approx(1 / (1 + math.exp(-min(40, max(-40, 0.7 * z - 0.1)))), abs=1e-4)


def test_calibration_recovers_the_line():
    rng = np.random.default_rng(3)
    z = rng.normal(size=4000) * 3
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.5 * z + 1)))).astype(int)
    weights = np.zeros(quality.SLOTS)
    weights[5] = 1.0
    samples = [(int(a), np.array([5], np.int32), np.array([b], np.float32)) for a, b in zip(y, z, strict=True)]
    found = quality.calibrate(quality.Model(weights, 0.0), samples, float(y.mean()))
    assert found.slope == pytest.approx(0.5, abs=0.06) and found.shift == pytest.approx(1, abs=0.15)


def test_held_out_quality(spark):
    folder = SMALL.replace("sf0.001", "sf0.1")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    away = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    model = quality.learn(docs, labels.filter(~away))
    got = quality.judge(docs.join(labels.filter(away), "doc_id"), model).filter("not base_failed").toPandas()
    good = got[got["quality"] == 1]
    assert len(good) > 800 and good["kept"].mean() >= 0.99
    assert 1 - got[got["quality"] == 0]["kept"].mean() >= 0.9
    assert np.abs(got["probability"].mean() - got["quality"].mean()) < 0.05


def test_quality_edges(spark):
    rows = [(1, "w " * 30, "p", 1), (2, None, "p", 1), (None, " ".join(map(str, range(40))), "p", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, found int")
    none = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    assert quality.learn(docs, none) is None
    got = quality.judge(docs, None).toPandas().set_index("n_words")
    assert got["kept"].to_dict() == {30: False, 0: False, 40: True} and got["probability"].isna().all() and (got["found"] == 1).all()
    assert quality.judge(docs.limit(0), None).count() == 0
    both = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, quality int")
    assert quality.learn(docs, both) is None or isinstance(quality.learn(docs, both), quality.Model)
