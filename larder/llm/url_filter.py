"""URL filter: host words by unigram Viterbi, a naive Bayes verdict over them, and host rules before it.

Names in a host are often several words run together. A unigram model, learned from all words of the
pages themselves, splits each name into the words whose product of probabilities is largest; names that no
words cover fall back to single characters at a small probability. Multinomial naive Bayes then scores
the words of host and path. Its training labels come from ``seeds``: a URL whose host has a seed word
is of the unwanted class; what else goes along with such hosts is learned from all URLs.

Scale: ``judge_urls`` keeps every word. Counts of words and tokens are tables, and only their totals reach
the driver. Distinct names meet the words inside them, names of urls their splits, tokens their ratios, and
pages the verdict of their host and path by equality; keys with over a thousandth of the rows, so a thousand
at most, are broadcast instead. Words longer than ``LONGEST`` are found by their first ``LONGEST`` letters.

Defined results: a null url, or one without ``://``, has an empty host and path, no rule, and no words: it
gets the verdict of the class that is more frequent. Equal probabilities go to the longer first word.
Without a page of either class no url is blocked but by rule. Repeated rows are judged alike; other
columns are kept and the operator's own names replace clashing ones.
"""

from __future__ import annotations

import functools
import math
import re
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.workspace import Workspace

LONGEST = 24
#: Words that mark an unwanted host.
SEEDS = ("casino", "bets", "pills", "poker", "viagra", "xxx", "porn", "escort", "jackpot", "gambling", "warez", "payday")
Rule = tuple[str, str, str]
#: (verdict, host, path beginning).
RULES: tuple[Rule, ...] = (
    ("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"),
)
_WORD = re.compile(r"[^\W\d_]+")


def host_of(url: Column) -> Column:
    """What is after the first ``://`` up to ``/``, ``?``, ``#`` or the end, ``A-Z`` in lower case."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; both null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, own, start in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):
        fits = ((host == own) | F.endswith(host, F.lit(f".{own}"))) & F.startswith(path, F.lit(start))
        name, verdict = F.when(fits, f"{own}{start}").otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


@dataclass
class Unigrams:
    """Costs (negative logarithms) of words, and of a character that no word covers."""

    costs: Mapping[str, float]
    character: float

    @functools.cached_property
    def longest(self) -> int:
        return max(map(len, self.costs), default=1)

    def split(self, name: str) -> list[str]:
        """The cheapest split of one name; characters that no word covers stay together as one word."""
        best = [0.0] + [math.inf] * len(name)
        came = [0] * (len(name) + 1)
        for end in range(1, len(name) + 1):
            for start in range(max(0, end - max(1, self.longest)), end):
                cost = self.costs.get(name[start:end])
                cost = best[start] + (self.character if cost is None and end - start == 1 else math.inf if cost is None else cost)
                if cost < best[end] - 1e-12:
                    best[end], came[end] = cost, start
        words, end, known = [], len(name), True
        while end:
            start = came[end]
            word = name[start:end]
            found = word in self.costs
            if not found and not known:
                words[-1] = word + words[-1]
            else:
                words.append(word)
            known = found
            end = start
        return words[::-1]


def count_words(texts: DataFrame, text: str) -> DataFrame:
    """Every word of at least two letters with its number of occurrences."""
    words = texts.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("w")).filter(F.length("w") >= 2)
    return words.groupBy("w").agg(F.count("*").alias("n"))


def attach(rows: DataFrame, side: DataFrame, on: Sequence[str], weight: str) -> DataFrame:
    """``rows`` joined to the one row of ``side`` with their key; ``weight`` says how many rows each has."""
    total = side.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * 1000 > total
    hot = F.broadcast(side.filter(heavy).drop(weight))  # under 1,000 rows
    return rows.join(hot, list(on)).unionByName(rows.join(hot.select(*on), list(on), "left_anti").join(side.filter(~heavy).drop(weight), list(on)))


def split_names(names: DataFrame, counts: DataFrame, extra: Sequence[str] = SEEDS) -> DataFrame:
    """``names`` (distinct, in ``name``) with ``words``, their cheapest splits by the counts of all words;
    ``extra`` words are as frequent as the most frequent one."""
    spark = names.sparkSession
    whole, most = counts.agg(F.sum("n"), F.max("n")).first()
    most = most or 1
    seeds = spark.createDataFrame([(w, most) for w in sorted(set(extra))], "w string, n long")
    held = counts.filter(F.col("w").isin(*extra)).agg(F.sum("n")).first()[0] or 0
    total = (whole or 0) - held + most * len(set(extra)) + 1
    known = counts.filter(~F.col("w").isin(*extra)).unionByName(seeds)

    at = names.select("name", F.explode(F.sequence(F.lit(1), F.length("name"))).alias("at")).filter(F.col("at") < F.length("name"))
    room = F.least(F.lit(LONGEST), F.length("name") - F.col("at") + 1)
    parts = at.select("name", F.explode(F.transform(F.sequence(F.lit(2), room), lambda k: F.substring("name", F.col("at"), k))).alias("w"))
    short = parts.join(known.filter(F.length("w") <= LONGEST), "w").select("name", "w", "n")
    long = known.filter(F.length("w") > LONGEST).select(F.substring("w", 1, LONGEST).alias("w"), F.col("w").alias("word"), "n")
    begun = parts.filter(F.length("w") == LONGEST).distinct().join(long, "w").filter(F.contains("name", "word")).select("name", F.col("word").alias("w"), "n")
    inside = short.unionByName(begun).groupBy("name").agg(F.collect_set(F.struct("w", "n")).alias("inside"))
    character = math.log(total) + 2

    @F.pandas_udf("array<string>")
    def split(own: pd.Series, words: pd.Series, numbers: pd.Series) -> pd.Series:
        costs = ({w: -math.log(n / total) for w, n in zip(ws, ns, strict=True)} if ws is not None else {} for ws, ns in zip(words, numbers, strict=True))
        return pd.Series([Unigrams(c, character).split(name) for name, c in zip(own, costs, strict=True)], dtype=object)

    return names.join(inside, "name", "left").withColumn("words", split("name", F.col("inside.w"), F.col("inside.n"))).drop("inside")


def host_words(host: str, split) -> list[str]:
    """Words of the host's names, without the top level name."""
    names = [p for part in host.split(":")[0].split(".")[:-1] for p in _WORD.findall(part)]
    return [w for name in names for w in split(name)]


def path_words(path: str, split) -> list[str]:
    return [w for name in _WORD.findall(path.lower()) for w in split(name)]


def _numbered(host: Column, path: Column) -> Column:
    """(kind, value) of an empty value (-1), of values of the host (0) and of the path (1), in this order."""

    def of(kind: int, values: Column) -> Column:
        return F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))

    return F.concat(of(-1, F.array(F.lit(""))), of(0, host), of(1, path))


def _names(host: Column, path: Column) -> Column:
    """The names of host and path, not yet split."""

    @F.pandas_udf("h array<string>, p array<string>")
    def run(hosts: pd.Series, paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"h": [host_words(h, lambda n: [n]) for h in hosts], "p": [path_words(p, lambda n: [n]) for p in paths]})

    return run(host, path)


def judge_urls(pages: DataFrame, url: str = "url", text: str = "html", rules: Sequence[Rule] = RULES, seeds: Sequence[str] = SEEDS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path beginning of the longest fitting one),
    ``host_segments``, ``path_segments``, ``score`` (log-odds of the unwanted class) and ``verdict``: the
    rule's, else ``block`` for a positive score and ``allow`` otherwise."""
    space = Workspace(pages.sparkSession, f"url filter {uuid.uuid4()}")
    counts = space.write(count_words(pages, text), "words")
    own = {"host", "path", "rule", "host_segments", "path_segments", "score", "verdict"}
    kept = [c for c in pages.columns if c not in own]
    urls = pages.withColumn("_u", F.coalesce(F.col(url), F.lit(""))).select(*kept, host_of(F.col("_u")).alias("host"), path_of(F.col("_u")).alias("path"))
    key = ["host", "path"]

    pairs = urls.groupBy(*key).agg(F.count("*").alias("_n")).withColumn("_f", _names(F.col("host"), F.col("path")))
    listed = pairs.select(*key, "_n", F.posexplode(_numbered(F.col("_f.h"), F.col("_f.p"))).alias("pos", "x"))
    named = space.write(listed.select(*key, "_n", "pos", "x.kind", F.col("x.value").alias("name")), "names")
    names = named.groupBy("name").agg(F.count("*").alias("uses"))
    splits = space.write(split_names(names, counts, seeds), "splits")

    several = lambda c, k, f: F.flatten(F.transform(F.filter(c, lambda x: x["kind"] == k), lambda x: x[f]))
    whole = attach(named, splits, ["name"], "uses").groupBy(*key).agg(F.first("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("pos", "kind", "words"))).alias("_p"))
    segments = whole.select(*key, "_n", several(F.col("_p"), 0, "words").alias("h"), several(F.col("_p"), 1, "words").alias("p"))
    unwanted = F.arrays_overlap("h", F.array(*[F.lit(s) for s in seeds]).cast("array<string>")).cast("long")
    tokens = space.write(
        segments.select(*key, "_n", unwanted.alias("y"), F.posexplode(_numbered(F.col("h"), F.col("p"))).alias("pos", "x"))
        .select(*key, "_n", "y", "pos", "x.kind", F.col("x.value").alias("w")), "tokens",
    )
    seen = tokens.groupBy("w").agg(F.sum(F.col("_n") * F.col("y")).alias("bad"), F.sum(F.col("_n") * (1 - F.col("y"))).alias("good"), F.count("*").alias("uses"))
    seen = space.write(seen, "classes")
    of = {r[0]: r[1:] for r in seen.groupBy(F.col("w") == "").agg(F.sum("bad"), F.sum("good"), F.count("*")).collect()}  # urls, words
    (bad_urls, good_urls, _), (bad_all, good_all, most) = of.get(True, (0, 0, 0)), of.get(False, (0, 0, 0))
    if bad_urls and good_urls:
        ratio = F.log((F.col("bad") + 1) / F.lit(float(bad_all + most + 1))) - F.log((F.col("good") + 1) / F.lit(float(good_all + most + 1)))
        prior = math.log(bad_urls / good_urls)
    else:
        ratio, prior = F.lit(0.0), math.inf if bad_urls else -math.inf
    ratios = seen.select("w", "uses", F.when(F.col("w") == "", F.lit(prior)).otherwise(ratio).alias("ratio"))

    every = attach(tokens, ratios, ["w"], "uses").groupBy(*key).agg(F.first("_n").alias("_n"), F.sort_array(F.collect_list(F.struct("pos", "kind", "w", "ratio"))).alias("_t"))
    only = lambda k: F.transform(F.filter("_t", lambda x: x["kind"] == k), lambda x: x["w"])
    judged = space.write(every.select(
        *key, "_n", only(0).alias("host_segments"), only(1).alias("path_segments"), F.aggregate("_t", F.lit(0.0), lambda a, x: a + x["ratio"]).alias("score")
    ), "judged")
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return attach(urls, judged, key, "_n").select(
        *kept, "host", "path", name.alias("rule"), "host_segments", "path_segments", "score",
        F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"),
    )
