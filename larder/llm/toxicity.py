"""Toxicity by a counterfactual-regularised classifier.

A text's features are its words and the beginnings of its words, each as a rate per hundred words; the
score is logistic in them. Training adds a penalty: where a labelled sentence names a group, the name is
swapped for others of its kind, and the squared change of the text's logit is charged at ``fairness``
times the loss. Neutral mentions of a group then no longer raise the score, though the names may be
more frequent in toxic texts.

Scale: training takes at most ``per_class`` documents of each label (a documented bound, chosen by a
hash of the id), of which only ids are broadcast; statistics of their features are grouped in Spark. Every
feature takes part whose frequencies in the two classes differ by ``SIGNIFICANT`` standard errors, however
many these are; they reach the driver with at most ``2 * per_class`` rows. Scoring is a narrow map over
whole texts: one table look-up a word.

Defined results: a null or empty text scores as no evidence (the learned base rate); without labels of
both kinds every score is 0. Repeated rows are scored alike; a document with both labels teaches both;
a null label teaches nothing. Other columns are kept, the operator's own names replace clashing ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.workspace import cut_lineage

PER_CLASS = 2000
SIGNIFICANT = 2.0
FAIRNESS = 5.0
STARTS = (3, 4, 5, 6, 7)
SMOOTH = 20
#: Names that are swapped for one another, kind by kind.
IDENTITIES: tuple[tuple[str, ...], ...] = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "natives", "refugees", "foreigners"), ("immigrant", "native", "refugee", "foreigner"),
    ("disabled", "deaf", "blind", "healthy"), ("old", "young"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
)
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")


def tokens(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def word_features(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [f"={word}", *(word[:k] for k in STARTS if k <= len(word))]


def rates(words: Sequence[str]) -> Counter:
    """Per feature how often it occurs in a hundred words (of the text and ``SMOOTH`` more)."""
    out: Counter = Counter()
    unit = 100.0 / (len(words) + SMOOTH)
    for word, n in Counter(words).items():
        for feature in word_features(word):
            out[feature] += n * unit
    return out


def swaps(text: str | None, identities=IDENTITIES) -> Counter:
    """What changes in the rates when every name in the sentences that have one is swapped for the next
    of its kind; empty if no sentence names a group."""
    after = {a: kind[(i + 1) % len(kind)] for kind in identities for i, a in enumerate(kind)}
    words = tokens(text)
    change: Counter = Counter()
    if not words or after.keys().isdisjoint(words):
        return change
    unit = 100.0 / (len(words) + SMOOTH)
    for sentence in _SENTENCE.split(text.lower()):
        for word in _LETTERS.findall(sentence):
            if word in after:
                for feature in word_features(word):
                    change[feature] -= unit
                for feature in word_features(after[word]):
                    change[feature] += unit
    return Counter({k: v for k, v in change.items() if v})


@dataclass
class Classifier:
    weights: dict[str, float]
    base: float
    _words: dict[str, tuple[float, int]] = field(default_factory=dict, repr=False)

    def _token(self, raw: str) -> tuple[float, int]:
        """Summed weights and number of the words in what stands between two blanks."""
        get, total, inside = self.weights.get, 0.0, _LETTERS.findall(raw)
        for word in inside:
            total += get(f"={word}", 0.0)
            for k in STARTS:
                if k > len(word):
                    break
                total += get(word[:k], 0.0)
        return total, len(inside)

    def logit(self, text: str | None) -> float:
        known, total, count = self._words, 0.0, 0
        for raw in text.lower().split() if text else ():
            pair = known.get(raw)
            if pair is None:
                if len(known) > 500_000:
                    known.clear()
                pair = known[raw] = self._token(raw)
            total += pair[0]
            count += pair[1]
        return self.base + 100.0 * total / (count + SMOOTH)


def _rows(sets: list[tuple[Sequence[int], Sequence[float]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of sparse rows."""
    row = np.repeat(np.arange(len(sets)), [len(s[0]) for s in sets])
    column = np.concatenate([np.asarray(s[0], np.int64) for s in sets]) if len(row) else np.empty(0, np.int64)
    value = np.concatenate([np.asarray(s[1], np.float64) for s in sets]) if len(row) else np.empty(0)
    return row, column, value


def fit(
    samples: list[tuple[int, Sequence[int], Sequence[float], Sequence[int], Sequence[float]]],
    features: Sequence[str],
    prior: float,
    fairness: float = FAIRNESS,
    rounds: int = 160,
    decay: float = 1e-4,
) -> Classifier:
    """Full-batch Adam. A sample is (label, numbers of features, rates, features that a swap changes, by how much);
    ``prior`` is the share of toxic labels among all, to which the sampled classes are weighted."""
    label = np.array([s[0] for s in samples], np.float64)
    row, col, val = _rows([(s[1], s[2]) for s in samples])
    srow, scol, sval = _rows([(s[3], s[4]) for s in samples])
    swapped = max(1, len(np.unique(srow)))
    share = label.mean()
    mass = np.where(label == 1, prior / share, (1 - prior) / (1 - share)) / len(label)
    w, base = np.zeros(len(features)), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(features) + 1), np.zeros(len(features) + 1)
    for step in range(1, rounds + 1):
        logit = base + np.bincount(row, weights=val * w[col], minlength=len(label))
        pull = mass * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - label)
        change = np.bincount(srow, weights=sval * w[scol], minlength=len(label))
        grad = np.bincount(col, weights=val * pull[row], minlength=len(features)) + decay * w
        grad += 2 * fairness / swapped * np.bincount(scol, weights=sval * change[srow], minlength=len(features))
        g = np.r_[grad, pull.sum()]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        move = 0.2 * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, base = w - move[:-1], base - move[-1]
    return Classifier(dict(zip(features, w.tolist(), strict=True)), base)


def learn(
    docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
    per_class: int = PER_CLASS, identities=IDENTITIES, **how,
) -> Classifier | None:
    """Train on at most ``per_class`` labelled documents of each class; None without both classes."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k is not null and y in (0, 1)").distinct()
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    place = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit(5)), F.lit(1_000_000))
    # A share of twice the bound first, so that sorting does not meet all labels in one place.
    share = {y: 2 * per_class * 1_000_000 // n + 1 for y, n in counts.items()}
    parts = [known.filter((F.col("y") == y) & (place < share[y])).orderBy(place, "k").limit(per_class) for y in (0, 1)]
    # At most 2 * per_class ids.
    sample = cut_lineage(docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(parts[0].union(parts[1])), "k"))

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for y, t in zip(part["y"], part["t"], strict=True):
                if found := {f for w in set(tokens(t)) for f in word_features(w)}:
                    yield pd.DataFrame({"f": list(found), "y": y})

    sizes = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    if len(sizes) < 2:
        return None
    totals = sample.select("y", "t").mapInPandas(seen, "f string, y int").groupBy("f").agg(
        F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0")
    )
    p1, p0 = F.col("n1") / sizes[1], F.col("n0") / sizes[0]
    pooled = (F.col("n1") + F.col("n0") + 0.5) / (sizes[0] + sizes[1] + 1)
    telling = F.abs(p1 - p0) / F.sqrt(pooled * (1 - pooled))
    error = (1 / sizes[0] + 1 / sizes[1]) ** 0.5
    chosen = sorted(r[0] for r in totals.filter(telling >= SIGNIFICANT * error).select("f").collect())
    wanted = {f: i for i, f in enumerate(chosen)}

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for y, t in zip(part["y"], part["t"], strict=True):
                now = {wanted[k]: v for k, v in rates(tokens(t)).items() if k in wanted}
                new = {wanted[k]: v for k, v in swaps(t, identities).items() if k in wanted}
                out.append((y, [*now], [*now.values()], [*new], [*new.values()]))
            yield pd.DataFrame(out, columns=["y", "f", "v", "sf", "sv"])

    shape = "y int, f array<int>, v array<double>, sf array<int>, sv array<double>"
    samples = [tuple(r) for r in sample.select("y", "t").mapInPandas(sparse, shape).collect()]
    samples.sort(key=lambda s: (s[0], sorted(zip(s[1], s[2], strict=True))))  # whatever the order of partitions
    return fit(samples, chosen, counts[1] / (counts[0] + counts[1]), **how)


def judge(docs: DataFrame, model: Classifier | None, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on)."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Classifier(model.weights, model.base) if model else None
        for texts in parts:
            logits = np.array([own.logit(t) if own else -40.0 for t in texts], np.float64)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logits, -40, 40))) if own else np.zeros(len(texts)))

    kept = [c for c in docs.columns if c not in {"score", "predicted"}]
    scored = docs.select(*kept, score(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
