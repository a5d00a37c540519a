"""Quality rules: counted rules first, then a hashed n-gram classifier with calibrated probabilities.

Words are runs of anything but ASCII blanks. The rules count words, letters in words, symbols, lines that
repeat an earlier one and words in windows of 8 words found at least twice; a text with too few words or too many
repeated ones fails. What passes is judged by a logistic regression over hashed word and character n-grams:
words, pairs of neighbouring words, and runs of 3 to 5 characters of each word with a blank on either side, as rates
per hundred. It is trained on labelled rows; a part of them, kept out of training, calibrates the logits (Platt)
to the true share of good rows, so that the fixed thresholds mean probabilities.

Scale: training takes at most ``per_class`` labelled documents of each class (a documented bound, chosen by a hash
of the id); a document gives at most ``SLOTS`` numbers. Scoring is a narrow map in Arrow batches: characters are
hashed in numpy over about ``UNIT`` characters at a time; a longer text is cut behind a blank, which
changes no n-gram. Equal windows have equal hashes, so only texts in which a hash repeats are compared word for word.

Defined results: a null or empty text has no words and fails; without labels of both kinds there is no
probability (null) and only the rules decide; a document with both labels teaches both; a null label teaches
nothing; repeated rows are judged alike, and teach once an id. Other columns are kept, the operator's own names replace clashing ones.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.workspace import cut_lineage

PER_CLASS = 400
SLOTS = 1 << 16
CHARS = (3, 4, 5)
WINDOW = 8
UNIT = 1 << 19
SMOOTH = 20
#: Rules and thresholds.
MIN_WORDS = 20
MAX_REPEATED = 30
KEEP = 0.5
GOOD = 0.9
SYMBOLS = "#*$%&|<>"
_BLANKS = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_IS_BLANK = np.zeros(128, bool)
_IS_BLANK[list(_BLANKS)] = True
_IS_SYMBOL = np.zeros(128, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True
RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "probability double, grade string, kept boolean"
)
_NAMES = [c.split(" ")[0] for c in RESULT.split(", ")]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def pieces(text: str, size: int = UNIT) -> Iterator[str]:
    """The text in pieces of about ``size`` characters, each but the last ending with a blank."""
    start = 0
    while len(text) - start > size:
        blank = _BLANK.search(text, start + size - 1)
        if blank is None:
            break
        yield text[start : blank.end()]
        start = blank.end()
    yield text[start:]


@dataclass
class Grams:
    """Hashes of the words and slots of the character n-grams of some pieces, each with the number of its piece."""

    words: np.ndarray
    word_piece: np.ndarray
    slots: list[np.ndarray]
    slot_piece: list[np.ndarray]
    letters: np.ndarray
    symbols: np.ndarray


def grams(parts: list[str]) -> Grams:
    """A blank is put before each piece, so that every word has one on either side."""
    codes = np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    piece = np.append(np.repeat(np.arange(len(parts), dtype=np.int32), lengths), np.int32(len(parts) - 1))
    low = np.minimum(codes, 127)
    blank = _IS_BLANK[low] & (codes < 128)
    symbol = _IS_SYMBOL[low] & (codes < 128)
    letters = np.bincount(piece[~blank], minlength=len(parts))
    symbols = np.bincount(piece[symbol], minlength=len(parts))
    chars = np.where(blank, np.uint64(32), codes.astype(np.uint64))
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    if len(starts):
        at = np.arange(len(codes)) - np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(codes)]))
        powers = np.cumprod(np.full(int(at.max()) + 1, _BASE))
        words = mixed(np.add.reduceat(np.where(blank, np.uint64(0), chars + np.uint64(1)) * powers[at], starts))
    else:
        words = np.empty(0, np.uint64)
    # An n-gram may begin or end with a blank but has none inside, so it never leaves its padded word.
    slots, owners = [], []
    run = chars.copy()
    clear = np.ones(len(codes), bool)  # no blank strictly inside the run that begins here
    for n in range(2, max(CHARS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        if n > 2:
            clear = clear[:m] & ~blank[n - 2 : n - 2 + m]
        run = run[:m] * _BASE + chars[n - 1 : n - 1 + m]
        if n in CHARS:
            good = np.flatnonzero(clear[:m])
            slots.append((mixed(run[good] + np.uint64(n)) & np.uint64(SLOTS - 1)).astype(np.int32))
            owners.append(piece[np.minimum(good + 1, len(piece) - 1)])  # the character after a leading blank
    return Grams(words, piece[starts], slots, owners, letters, symbols)


def word_slots(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of words and of pairs of neighbours with one owner."""
    same = owner[1:] == owner[:-1]
    pairs = mixed(hashes[:-1] * _BASE + hashes[1:])[same]
    slots = np.r_[mixed(hashes + np.uint64(1)), pairs] & np.uint64(SLOTS - 1)
    return slots.astype(np.int32), np.r_[owner, owner[:-1][same]]


def repeated_words(text: str, window: int = WINDOW) -> int:
    """Words that lie in a run of ``window`` (a power of two) words found at least twice in the text."""
    known: dict[str, int] = {}
    ranks = np.array([known.setdefault(w, len(known)) for w in _WORD.findall(text)], np.int64)
    n, width = len(ranks), 1
    if n <= window:
        return 0
    while width < window:  # equal ranks mean equal runs, at every width
        both = ranks[:-width] * (int(ranks.max()) + 1) + ranks[width:]
        ranks = np.unique(both, return_inverse=True)[1].astype(np.int64)
        width *= 2
    twice = np.bincount(ranks)[ranks] > 1
    change = np.zeros(n + 1, np.int64)
    change[:-window] += twice
    change[window:] -= twice
    return int((np.cumsum(change[:-1]) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if _WORD.search(line)]
    return len(lines) - len(set(lines))


def units(texts: list[str | None], size: int = UNIT) -> Iterator[list[int]]:
    """Numbers of neighbouring texts with about ``size`` characters together; a longer text is alone."""
    held: list[int] = []
    total = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if held and total + n > size:
            yield held
            held, total = [], 0
        held.append(i)
        total += n
    if held:
        yield held


def read(texts: list[str | None], size: int = UNIT) -> Iterator[tuple[int, str, list[tuple[np.ndarray, np.ndarray]], np.ndarray, tuple[int, int, int]]]:
    """Per unit of texts: (their numbers, character slots with owners in parts, word hashes, owner of each word, letters and
    symbols of each). Owners count from 0 inside the unit."""
    for own in units(texts, size):
        cut = [(k, p) for k, i in enumerate(own) for p in pieces(texts[i] or "", size)]
        parts, words, owners = [], [], []
        letters, symbols = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        batch: list[tuple[int, str]] = []
        for at, item in enumerate(cut):
            batch.append(item)
            if at + 1 < len(cut) and sum(len(p) for _, p in batch) + len(cut[at + 1][1]) <= 2 * size:
                continue
            whose = np.array([k for k, _ in batch], np.int64)
            g = grams([p for _, p in batch])
            words.append(g.words)
            owners.append(whose[g.word_piece])
            np.add.at(letters, whose, g.letters)
            np.add.at(symbols, whose, g.symbols)
            parts.append([(s, whose[o]) for s, o in zip(g.slots, g.slot_piece, strict=True)])
            batch = []
        yield own, itertools.chain.from_iterable(parts), np.concatenate(words), np.concatenate(owners), (letters, symbols)


def suspects(hashes: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Owners in which the hash of a window occurs twice; no other owner can repeat a window."""
    m = len(hashes) - window + 1
    if m < 2:
        return np.empty(0, np.int64)
    run = np.zeros(m, np.uint64)
    for j in range(window):
        run = run * _BASE + hashes[j : j + m]
    whole = np.flatnonzero(owner[:m] == owner[window - 1 :])
    run, own = mixed(run[whole] + owner[whole].astype(np.uint64) * _MIX), owner[whole]
    order = np.argsort(run, kind="stable")
    same = run[order][1:] == run[order][:-1]
    return np.unique(own[order][1:][same])


@dataclass
class Model:
    """Weights by slot, and the line that turns a logit into a calibrated one."""

    weights: np.ndarray
    base: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.shift, -40, 40)))


def measure(texts: list[str | None], model: Model | None, size: int = UNIT) -> pd.DataFrame:
    """The result columns of each text."""
    out = np.zeros((len(texts), 5), np.int64)
    logit = np.zeros(len(texts))
    for own, parts, words, owner, (letters, symbols) in read(texts, size):
        n = len(own)
        n_words = np.bincount(owner, minlength=n)
        out[own, 0], out[own, 1], out[own, 2] = n_words, letters, symbols
        out[own, 3] = [duplicate_lines(texts[i] or "") for i in own]
        for k in suspects(words, owner):
            out[own[k], 4] = repeated_words(texts[own[k]])
        if model is not None:
            chars, seen = np.zeros(n), np.zeros(n, np.int64)
            for slots, whose in parts:
                chars += np.bincount(whose, model.weights[slots], minlength=n)
                seen += np.bincount(whose, minlength=n)
            slots, whose = word_slots(words, owner)
            spoken = np.bincount(whose, model.weights[slots], minlength=n)
            logit[own] = model.base + 100 * chars / (seen + SMOOTH) + 100 * spoken / (n_words + SMOOTH)
    failed = (out[:, 0] < MIN_WORDS) | (100 * out[:, 4] > MAX_REPEATED * out[:, 0])
    found = pd.DataFrame(out, columns=_NAMES[:5])
    found["base_failed"] = failed
    p = model.probability(logit) if model is not None else None
    found["probability"] = p if p is not None else None
    found["grade"] = np.where(failed, "failed", "fair" if p is None else np.where(p >= GOOD, "good", np.where(p >= KEEP, "fair", "poor")))
    found["kept"] = ~failed & (True if p is None else p >= KEEP)
    return found


def sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of one text and their rates per hundred."""
    total = np.zeros(SLOTS, np.float64)
    for _, parts, words, owner, _ in read([text]):
        chars, seen = np.zeros(SLOTS), 0
        for slots, _whose in parts:
            chars += np.bincount(slots, minlength=SLOTS)
            seen += len(slots)
        total += 100 * chars / (seen + SMOOTH) + 100 * np.bincount(word_slots(words, owner)[0], minlength=SLOTS) / (len(words) + SMOOTH)
    at = np.flatnonzero(total)
    return at.astype(np.int32), total[at].astype(np.float32)


def fit(samples: list[tuple[int, np.ndarray, np.ndarray]], prior: float, rounds: int = 80, decay: float = 1e-5) -> Model:
    """Full-batch Adam on (label, slots, rates); ``prior`` is the share of label 1 among all, to which the classes are weighted."""
    label = np.array([s[0] for s in samples], np.float64)
    row = np.repeat(np.arange(len(samples), dtype=np.int32), [len(s[1]) for s in samples])
    col, val = np.concatenate([s[1] for s in samples]), np.concatenate([s[2] for s in samples])
    mass = np.where(label == 1, prior / label.sum(), (1 - prior) / (1 - label).sum())
    w, base = np.zeros(SLOTS), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(SLOTS + 1), np.zeros(SLOTS + 1)
    for step in range(1, rounds + 1):
        logit = base + np.bincount(row, val * w[col], minlength=len(label))
        pull = mass * (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - label)
        g = np.r_[np.bincount(col, val * pull[row], minlength=SLOTS) + decay * w, pull.sum()]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        move = 0.05 * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, base = w - move[:-1], base - move[-1]
    return Model(w, base)


def calibrate(model: Model, samples: list[tuple[int, np.ndarray, np.ndarray]], prior: float) -> Model:
    """Platt's line by Newton steps, with his softened targets, the classes weighted to ``prior``."""
    label = np.array([s[0] for s in samples], np.float64)
    good, bad = label.sum(), (1 - label).sum()
    if not good or not bad:
        return model
    z = np.array([model.base + float(model.weights[s[1]] @ s[2]) for s in samples])
    mass = np.where(label == 1, prior / good, (1 - prior) / bad)
    aim = np.where(label == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.c_[z, np.ones(len(z))]
    line = np.array([1.0, 0.0])

    def loss(at: np.ndarray) -> float:
        u = np.clip(x @ at, -700, 700)
        return float((mass * (np.logaddexp(0, u) - aim * u)).sum())

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -40, 40)))
        pull = x.T @ (mass * (p - aim))
        bend = (x * (mass * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        step, size = np.linalg.solve(bend, pull), 1.0
        while size > 1e-6 and loss(line - size * step) > loss(line):
            size /= 2
        line = line - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return Model(model.weights, model.base, float(line[0]), float(line[1])) if line[0] > 0 else model


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", per_class: int = PER_CLASS) -> Model | None:
    """Train on three quarters and calibrate on a quarter of at most ``per_class`` labelled documents of each class."""
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).filter("k is not null and y in (0, 1)").distinct()
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    place = F.pmod(F.xxhash64(F.col("k").cast("string"), F.lit(13)), F.lit(1_000_000_000))
    # A share of twice the bound first, so that sorting does not meet all labels in one place.
    share = {y: 2 * per_class * 1_000_000_000 // n + 1 for y, n in counts.items()}
    chosen = [known.filter((F.col("y") == y) & (place < share[y])).orderBy(place, "k").limit(per_class) for y in (0, 1)]
    # At most 2 * per_class ids; where rows share an id, the least text teaches.
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen[0].union(chosen[1])), "k")
    sample = sample.groupBy("k", "y").agg(F.min("t").alias("t"))

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            found = [sparse(t) for t in part["t"]]
            yield pd.DataFrame({"k": part["k"], "y": part["y"], "at": [a.tobytes() for a, _ in found], "rate": [r.tobytes() for _, r in found]})

    part = F.pmod(F.xxhash64("k", F.lit(14)), F.lit(4)).alias("part")
    rows = cut_lineage(sample.select(F.col("k").cast("string"), "y", "t").mapInPandas(described, "k string, y int, at binary, rate binary"))
    samples: dict[bool, list] = {True: [], False: []}
    for r in rows.select("k", "y", "at", "rate", part).orderBy("k", "y", "at", "rate").toLocalIterator():
        samples[r["part"] == 0].append((r["y"], np.frombuffer(r["at"], np.int32), np.frombuffer(r["rate"], np.float32)))
    if len({s[0] for s in samples[False]}) < 2:
        return None
    prior = counts[1] / (counts[0] + counts[1])
    return calibrate(fit(samples[False], prior), samples[True], prior)


def judge(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``probability``, ``grade`` (failed, poor, fair, good) and ``kept``."""

    @F.pandas_udf(RESULT)
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield measure([t if isinstance(t, str) else None for t in texts], model)

    kept = [c for c in docs.columns if c not in _NAMES]
    row = docs.select(F.struct(*[F.col(c) for c in kept]).alias("row"), found(F.col(text)).alias("found"))
    return row.select("row.*", "found.*")
