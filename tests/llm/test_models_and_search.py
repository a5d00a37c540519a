"""Chat repair, Hamming search, resharding, URL filter and the trained classifiers."""

import itertools
import json
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larder.llm import chat, language, resharding, toxicity, url_filter
from larder.llm.hamming_search import search, sign_code
from tests.conftest import SMALL

TURNS = "conv_id string, turn int, role string, text string, piece string"


def brute_cost(roles):
    """Least cost over every way to repair, by trying all of them."""
    best = [10**9]

    def go(at, state, cost, inserts):
        if cost >= best[0]:
            return
        if at == len(roles):
            if state == chat.ASSISTANT:
                best[0] = cost
        elif state != chat.START:
            go(at + 1, state, cost + chat.MERGE + (0 if roles[at] == state - 1 else chat.RELABEL), 0)
        for role, after in chat.LEGAL[state]:
            if at < len(roles):
                go(at + 1, after, cost + (0 if roles[at] == role else chat.RELABEL), 0)
            if role and inserts < 3:
                go(at, after, cost + chat.INSERT, inserts + 1)

    go(0, chat.START, 0, 0)
    return best[0]


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5])
def test_repair_cost_is_least(length):
    for roles in itertools.product(range(4), repeat=length):
        cost, path = chat.best_path(np.array(roles, np.int8), chat.START, None)
        assert cost == brute_cost(roles)
        table = chat.summary(np.array(roles, np.int8))[0]
        ends = [table[chat.START, s] + chat.INSERT * len(chat.CLOSING[s]) for s in range(4)]
        assert min(ends) == cost


def legal(roles):
    state = chat.START
    for r in roles:
        state = dict(chat.LEGAL[state]).get(chat.ROLES.index(r))
        if state is None:
            return False
    return state == chat.ASSISTANT


@pytest.fixture(scope="module")
def turns(spark):
    rng = np.random.default_rng(4)
    roles = ["system", "user", "assistant", " USER ", "tool", None]
    rows = [(f"c{i % 37}", i // 37, roles[rng.integers(6)], f"t{i}", "clash") for i in range(300)]
    rows += [("long", i, roles[rng.integers(3)], f"l{i}", "x") for i in range(700)]
    rows += [(None, None, "user", None, "x"), (None, 1, "assistant", "", "x"), ("c1", 0, "user", "t1", "x"), ("c1", 0, "user", "t1", "x")]
    return spark.createDataFrame(rows, TURNS)


def repaired(spark, turns, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        return chat.format_chats(turns).toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("parts", [1, 13])
def test_chats_are_repaired_whole(spark, turns, parts):
    given = turns.toPandas()
    got = repaired(spark, turns, parts)
    assert set(got["conv_id"]) == set(given["conv_id"])
    for name, own in got.groupby("conv_id", dropna=False):
        own = own.sort_values("piece")
        rows = given[given["conv_id"].isna() if name is None or name != name else given["conv_id"] == name]
        rows = rows.sort_values(["turn", "role", "text"], na_position="first")
        assert own["piece"].tolist() == list(range(len(own)))
        firsts = own[own["action"] != "merge"]
        assert firsts["out_turn"].tolist() == list(range(len(firsts))) and legal(firsts["role"])
        codes = chat._codes(rows["role"])
        assert (own["repair_cost"] == chat.best_path(codes, chat.START, None)[0]).all()
        paid = own["action"].map({"keep": 0, "merge": chat.MERGE, "relabel": chat.RELABEL, "insert": chat.INSERT}).sum()
        change = own[(own["action"] == "merge")]
        paid += chat.RELABEL * sum(chat._codes(change["given_role"]) != [chat.ROLES.index(r) for r in change["role"]])
        assert paid == own["repair_cost"].iloc[0]
        texts = own[own["action"] != "insert"]["rendered"].str.replace(r"^(<\|end\|>\n)?<\|\w+\|>\n|^\n\n", "", regex=True).str.replace("<|end|>\n", "")
        assert texts.tolist() == rows["text"].fillna("").tolist()
        whole = "".join(own["rendered"])
        assert whole.count("<|end|>\n") == len(firsts) and whole.endswith("<|end|>\n")


def test_chat_slices_cost_the_same(spark, turns):
    one, many = repaired(spark, turns, 1), repaired(spark, turns, 40)
    costs = [x.groupby("conv_id", dropna=False)["repair_cost"].first() for x in (one, many)]
    assert costs[0].equals(costs[1])
    assert chat.format_chats(turns.limit(0)).count() == 0
    whole = chat.whole_chats(chat.format_chats(turns.filter("conv_id = 'c1'"))).first()
    assert whole.text.startswith("<|") and whole.text.endswith(chat.END)


@pytest.mark.parametrize(("segments", "spread"), [(8, 3), (4, 3), (8, 64)])
def test_search_equals_brute_force(spark, segments, spread):
    rng = np.random.default_rng(8)
    centres = rng.integers(-(2**63), 2**63 - 1, 5, dtype=np.int64)
    rows = []
    for i in range(260):
        code = np.uint64(centres[rng.integers(5)])
        for b in rng.choice(64, rng.integers(0, spread), replace=False):
            code ^= np.uint64(1) << np.uint64(b)
        rows.append((i, int(code.view(np.int64)), "x"))
    rows += [rows[0]] * 40 + [(1000 + i, rows[3][1], "x") for i in range(30)] + [(None, rows[5][1], "x"), (7, None, "x")]
    base = spark.createDataFrame(rows, "id long, code long, rank string")
    got = search(base, base.filter("id % 20 = 0"), 6, segments=segments).toPandas()
    known = sorted({(r[0], r[1]) for r in rows if r[1] is not None}, key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for i, c in known:
        if i is not None and i % 20 == 0:
            near = sorted(((bin((c ^ o) % 2**64).count("1"), n) for n, (j, o) in enumerate(known) if (j, o) != (i, c)))[:6]
            want += [(i, r + 1, known[n][0], d) for r, (d, n) in enumerate(near)]
    rows = [(int(r.query_id), int(r.rank), None if pd.isna(r.neighbor_id) else int(r.neighbor_id), int(r.distance)) for r in got.itertuples()]
    assert sorted(rows, key=str) == sorted(want, key=str)


def test_search_of_little(spark):
    base = spark.createDataFrame([(0, 5), (20, 6)], "id long, code long")
    assert sorted(map(tuple, search(base, base, 10).collect())) == [(0, 1, 20, 2), (20, 1, 0, 2)]
    assert search(base.limit(0), base.limit(0), 10).count() == 0
    df = spark.createDataFrame([([0.5, -1.0, None, 2.0],), (None,), ([],)], "v array<double>")
    assert [r[0] for r in df.select(sign_code("v")).collect()] == [9, None, 0]
    with pytest.raises(Exception, match="holds 64 numbers"):
        spark.createDataFrame([([1.0] * 65,)], "v array<double>").select(sign_code("v")).collect()


def test_flow_moves_the_fewest_bytes():
    rng = np.random.default_rng(0)
    for _ in range(30):
        n, m = rng.integers(1, 6), rng.integers(1, 6)
        supply = rng.integers(0, 50, n).tolist()
        room = resharding.even_capacities(sum(supply), int(m))
        flow = resharding.min_cost_flow(supply, room)
        assert [sum(v for (i, _), v in flow.items() if i == a) for a in range(n)] == supply
        assert [sum(v for (_, j), v in flow.items() if j == b) for b in range(m)] == room
        stays = sum(min(s, r) for s, r in zip(supply, room, strict=False))  # no plan can leave more in place
        assert sum(v for (i, j), v in flow.items() if i != j) == sum(supply) - stays
    with pytest.raises(ValueError, match="capacities"):
        resharding.min_cost_flow([5], [4])


def test_resharding(spark, tmp_path):
    rows = [(i if i % 50 else None, 1 + (i * 7919) % 400, 0 if i % 3 else i % 4, "x") for i in range(3000)] + [(7, 30, 1, "x")] * 5
    df = spark.createDataFrame(rows, "id long, size long, old int, slot string")
    got = resharding.reshard(df, "old", "size", ["id"]).toPandas()
    assert len(got) == 3005
    by = got.groupby("shard")
    # A border falls inside a row: each end of a shard is off by half the largest row at most.
    assert (by["size"].sum() - got["size"].sum() / 16).abs().max() <= 401 and len(by) == 16
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in by)
    moved = got[got["shard"] != got["old"]]["size"].sum()
    room = resharding.even_capacities(int(got["size"].sum()), 16)
    least = got["size"].sum() - sum(min(s, room[o]) for o, s in got.groupby("old")["size"].sum().items())
    assert abs(moved - least) <= 401
    assert resharding.reshard(df.limit(0), "old", "size", ["id"]).count() == 0


def test_only_affected_shards_are_rewritten(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", i % 3) for i in range(90)], "id long, text string, old int")
    folder = str(tmp_path / "shards")
    docs.withColumnRenamed("old", "shard").write.partitionBy("shard").parquet(folder)
    keep = sorted(p.name for p in (tmp_path / "shards" / "shard=2").iterdir())
    placed = docs.select("id", "old", F.when((F.col("old") == 0) & (F.col("id") < 9), 1).otherwise(F.col("old")).alias("shard"), F.col("id").alias("slot"))
    assert resharding.rewrite(docs, placed, "id", "old", folder) == [0, 1]
    assert sorted(p.name for p in (tmp_path / "shards" / "shard=2").iterdir()) == keep
    got = {r.id: r.shard for r in spark.read.parquet(folder).collect()}
    assert got == {r.id: r.shard for r in placed.collect()}
    assert {tuple(r) for r in resharding.moved(placed.withColumn("size", F.lit(2)), "old", "size").collect()} == {(0, 1, 6, 3)}


def test_rewriting_keeps_every_row_and_removes_emptied_shards(spark, tmp_path):
    rows = [(n, None if n % 5 == 0 else n % 40, f"text {n % 9}" * (1 + n % 7), n % 16) for n in range(400)]
    docs = spark.createDataFrame(rows, "row long, id long, text string, old int")
    folder = str(tmp_path / "shards")
    docs.withColumn("shard", F.col("old")).write.partitionBy("shard").parquet(folder)
    sized = docs.select("row", "id", "old", F.octet_length("text").cast("long").alias("size"))
    placed = resharding.reshard(sized, "old", "size", ["id", "row"], shards=8)
    assert resharding.rewrite(docs, placed, ["row", "id"], "old", folder) == list(range(16))
    assert sorted(p.name for p in (tmp_path / "shards").iterdir() if p.name.startswith("shard=")) == [f"shard={n}" for n in range(8)]
    got = spark.read.parquet(folder).collect()
    assert sorted((r.row, r.id, r.text, r.old) for r in got if r.id is not None) == sorted(r for r in rows if r[1] is not None)
    assert sorted((r.row, r.text, r.old) for r in got if r.id is None) == sorted((n, t, o) for n, i, t, o in rows if i is None)
    assert {r.row: (r.shard, r.slot) for r in got} == {r.row: (r.shard, r.slot) for r in placed.collect()}
    before = sorted(str(p) for p in (tmp_path / "shards").rglob("*.parquet"))
    with pytest.raises(ValueError, match="identify"):
        resharding.rewrite(docs, placed.withColumn("shard", F.lit(0)), "id", "old", folder)
    assert sorted(str(p) for p in (tmp_path / "shards").rglob("*.parquet")) == before


def test_resharded_documents_are_read_from_their_shards(spark, tmp_path):
    from larder.llm.queries import op6_reshard

    rows = [(None if n % 4 == 0 else n % 25, None if n == 7 else f"text {n % 3}" * (n % 6), f"s{n % 3}") for n in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = op6_reshard(spark, str(tmp_path))
    assert any("/shard=" in f for f in found.inputFiles())
    got = found.collect()
    want = [(i, len(t or "") + 1, zlib.crc32((t or "").encode()), zlib.crc32(s.encode()) % 16) for i, t, s in rows]
    assert sorted(map(str, ((r.doc_id, r["size"], r.text_crc32, r.old_shard) for r in got))) == sorted(map(str, want))
    for n in range(16):
        slots = sorted(r.slot for r in got if r.shard == n)
        assert slots == list(range(len(slots))) and slots


def test_gradients():
    net = language.new_network(["a", "b"], 3, 1, np.float64)
    rng = np.random.default_rng(0)
    steps, wanted = rng.integers(0, 256, (7, 4)), np.array([0, 1, 1, 0])
    _, grads = language.loss_and_gradients(net, steps, wanted)
    for array, grad in zip(net.arrays(), grads, strict=True):
        for at in [tuple(x) for x in np.argwhere(np.abs(grad) > 0)[:: max(1, grad.size // 20)]]:
            array[at] += 1e-6
            up = language.loss_and_gradients(net, steps, wanted)[0]
            array[at] -= 2e-6
            down = language.loss_and_gradients(net, steps, wanted)[0]
            array[at] += 1e-6
            assert (up - down) / 2e-6 == pytest.approx(grad[at], rel=1e-4, abs=1e-8)


def test_blocks_and_runs_agree_with_plain_reading():
    net = language.new_network(["a", "b", "c"], 4, 2)
    text = "été abc " * 50
    raw = np.frombuffer(text.encode(), np.uint8)
    plain = []
    for a in range(0, len(raw), language.WINDOW):
        steps = raw[a : a + language.WINDOW].reshape(-1, 1).astype(np.int64)
        ahead, back = language._read(net.ahead, steps), language._read(net.back, steps[::-1])
        plain += [language._softmax(net.out @ np.concatenate([ahead[t][5], back[len(steps) - 1 - t][5]]) + net.bias)[:, 0] for t in range(len(steps))]
    p, votes = language.document_probabilities(net, ["x", text, "", None])
    assert p[:, 1] == pytest.approx(np.mean(plain, axis=0), abs=1e-4) and votes[:, 1].sum() == len(raw) and p[:, 2:].sum() == 0
    runs = language.label_runs(net, text)
    assert "".join(n * (b - a) for a, b, n in runs) == "".join(net.labels[k] for k in np.argmax(plain, axis=1)) and language.label_runs(net, "") == []


def test_language_on_held_out_rows(spark):
    from larder.llm.queries import op7_language

    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = op7_language(spark, SMALL).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)


def test_language_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "abc abc", "en", "c"), (2, None, "en", "c"), (3, "", None, "c"), (None, "1234 ...", "en", "c"), (5, "x" * 200_000, None, "c"), (1, "abc abc", "en", "c")], "doc_id long, text string, lang string, score string")
    net = language.learn(docs, "text", "lang", "doc_id", steps=2)
    got = {(r.doc_id, r.lang_pred, r.score) for r in language.identify(docs, net).collect()}
    assert {(i, p) for i, p, _ in got} == {(1, "en"), (2, "und"), (3, "und"), (None, "und"), (5, "en")}
    assert language.learn(docs.limit(0), "text", "lang", "doc_id") is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}


def test_hot_language_takes_no_room_from_rare_ones(spark):
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(11)), F.lit(1_000_000))
    first = spark.range(3000).orderBy(place).first().id
    rows = [(first, f"many words {n}", "aa") for n in range(2000)] + [(n, "few words", "bb") for n in range(5000, 5010)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.learn(docs, "text", "lang", "doc_id", per_language=10, steps=2).labels == ["aa", "bb"]


def test_toxicity_on_held_out_rows(spark):
    from larder.llm.queries import op9_toxicity

    folder = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = op9_toxicity(spark, folder).collect()
    held = [r for r in got if r.held_out and r.doc_id in toxic]
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.93 * len(held)
    assert all(not r.predicted for r in held if not toxic[r.doc_id])


def test_counterfactual_penalty_clears_group_names(spark):
    rng = np.random.default_rng(3)
    filler = ["river", "stone", "walks", "green", "table", "seven", "music", "paper"]
    rows = []
    for i in range(400):
        bad = i % 2
        words = list(rng.choice(filler, 8))
        if rng.random() < (0.8 if bad else 0.1):
            words[rng.integers(8)] = "muslims"
        if bad and rng.random() < 0.7:
            words[0] = "scumbag"
        rows.append((i, " ".join(words) + ".", bad, None))
    rows += [(1000, None, 1, None), (1001, "", 0, None), (0, rows[0][1], 0, None)]
    docs = spark.createDataFrame([(r[0], r[1], "s") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    neutral = spark.createDataFrame([(1, "muslims walks river green stone table music paper"), (2, "scumbag walks river green stone table music paper"), (3, None)], "doc_id long, text string")
    scores = {}
    for fairness in (0.0, 50.0):
        model = toxicity.learn(docs, labels, fairness=fairness)
        scores[fairness] = {r.doc_id: r.score for r in toxicity.judge(neutral, model).collect()}
    assert scores[0.0][1] > 0.5 > scores[50.0][1] and scores[50.0][2] > 0.5
    assert toxicity.learn(docs, labels.filter("toxic = 1")) is None
    assert {r.score for r in toxicity.judge(docs, None).collect()} == {0.0}


def test_swaps_only_sentences_with_names():
    assert not toxicity.swaps("nothing here.") and not toxicity.swaps(None)
    change = toxicity.swaps("Women walk. Stones lie.")
    assert change["=women"] < 0 < change["=men"] and "=stones" not in change


def brute_split(model, name):
    best = None
    for cuts in itertools.product([0, 1], repeat=len(name) - 1):
        parts, start = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(name[start:i])
                start = i
        if all(p in model.costs or len(p) == 1 for p in parts):
            cost = sum(model.costs.get(p, model.character) for p in parts)
            best = cost if best is None else min(best, cost)
    return best


def test_viterbi_split_is_cheapest():
    model = url_filter.Unigrams({"free": 3.0, "bets": 4.0, "freeb": 9.0, "ets": 5.0, "the": 1.0, "there": 2.5, "re": 2.0}, 8.0)
    assert model.split("freebets") == ["free", "bets"] and model.split("there") == ["there"] and model.split("xqfree") == ["xq", "free"] and model.split("") == []
    for name in ("freebets", "therefree", "xbets", "qqq", "freeets"):
        words = model.split(name)
        cost = sum(model.costs[w] if w in model.costs else model.character * len(w) for w in words)
        assert "".join(words) == name and cost == pytest.approx(brute_split(model, name))


URLS = [
    ("http://A.Example.ORG/es/1?x", "a.example.org", "/es/1", "example.org/es/", "block"), ("https://example.org/en/1", "example.org", "/en/1", "example.org/en/1", "block"),
    ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"), ("http://x.com/fr/#a", "x.com", "/fr/", "com/fr/", "allow"), ("http://com/de/9", "com", "/de/9", "com/de/", "block"),
    ("http://notcom/de/9", "notcom", "/de/9", None, None), ("http://x.com", "x.com", "", None, None), ("ftp://h?x://y", "h", "", None, None), ("x.com/fr/", "", "", None, None),
    (None, "", "", None, None), ("", "", "", None, None), ("http://myorg/", "myorg", "/", None, None), ("http://x.org", "x.org", "", None, None),
]


def test_hosts_paths_and_rules(spark):
    rows = [(i, u, "free bets win the river green " * 3, "c") for i, (u, *_) in enumerate(URLS)]
    rows += [(100 + i, f"http://{'free' * (i % 2)}bets{i}.net/a{i}", "free bets", "c") for i in range(6)] + [(200 + i, f"http://river{i}.net/green", "river green", "c") for i in range(30)]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string, score string")).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
    assert got[101].host_segments == ["free", "bets"] and got[101].verdict == "block" and got[200].verdict == "allow"
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_no_word_is_dropped_from_splits_and_scores(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rare = ["".join(p) for p in itertools.islice(itertools.product(letters, repeat=4), 60_000)]  # one step of counts, above the cap of old
    long = "rindfleischetikettierungsueberwachung"
    rows = [(0, f"http://{rare[7]}{rare[30_000]}.net/{long}{rare[59_999]}", " ".join([*rare, long] * 2)), (1, "http://casino.net/win", "river"), (2, "http://casino.net/win", None)]
    rows += [(3, "http://river.net/win", ""), (4, None, "river")]
    got = {r.page_id: r for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0].host_segments == [rare[7], rare[30_000]] and got[0].path_segments == [long, rare[59_999]]
    bad, good = {"casino": 2, "win": 2}, {rare[7]: 1, rare[30_000]: 1, long: 1, rare[59_999]: 1, "river": 1, "win": 1}
    known = {w for r in got.values() for w in r.host_segments + r.path_segments}
    for r in got.values():
        want = np.log(2 / 3)
        for w in r.host_segments + r.path_segments:
            want += np.log((bad.get(w, 0) + 1) / (4 + len(known) + 1)) - np.log((good.get(w, 0) + 1) / (6 + len(known) + 1))
        assert r.score == pytest.approx(want)
    assert len(got) == 5 and got[4].host_segments == []


def test_queries_and_sql_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert json.dumps(sorted(entry.oracle_sql()))


def test_toxicity_scores_equal_weights_times_rates(spark):
    rng = np.random.default_rng(6)
    texts = ["You ROTTEN scum, scum!", "the river is green", "", None, "a-b c_d 12x", "Éé été nation " * 50, "women and men walk. The women read"]
    known = sorted({f for t in texts for f in toxicity.rates(toxicity.tokens(t))})
    model = toxicity.Classifier(dict(zip(known[::2], rng.normal(size=len(known[::2])).tolist(), strict=True)), -0.4)
    got = toxicity.judge(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        words = toxicity.tokens(t)
        z = model.base
        for word in words:  # one by one, without counting first
            z += sum(model.weights.get(f, 0.0) for f in [f"={word}", *(word[:k] for k in toxicity.STARTS if k <= len(word))]) * 100 / (len(words) + toxicity.SMOOTH)
        assert got.loc[i, "score"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9) and got.loc[i, "predicted"] == (z >= 0)


def test_toxicity_training_ends_where_no_step_helps():
    rng = np.random.default_rng(7)
    samples = [(int(y), [0, 1 + int(rng.integers(3))], [1.0, float(rng.random())], [1, 2] if i % 3 == 0 else [], [0.5, -0.5] if i % 3 == 0 else []) for i, y in enumerate(rng.random(60) < 0.4)]
    prior, fairness, decay = 0.2, 5.0, 1e-2
    model = toxicity.fit(samples, ["a", "b", "c", "d"], prior, fairness, rounds=4000, decay=decay)
    share = np.mean([s[0] for s in samples])

    def loss(at):
        w, base = at[:4], at[4]
        z = np.array([base + sum(w[f] * v for f, v in zip(s[1], s[2], strict=True)) for s in samples])
        y = np.array([s[0] for s in samples])
        mass = np.where(y == 1, prior / share, (1 - prior) / (1 - share)) / len(y)
        change = [sum(w[f] * v for f, v in zip(s[3], s[4], strict=True)) for s in samples if s[3]]
        return (mass * (np.logaddexp(0, z) - y * z)).sum() + decay / 2 * (w @ w) + fairness * np.mean(np.square(change))

    at = np.array([*(model.weights[f] for f in "abcd"), model.base])
    slope = [(loss(at + e) - loss(at - e)) / 2e-5 for e in np.eye(5) * 1e-5]
    assert np.abs(slope).max() < 2e-3
