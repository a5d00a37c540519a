"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

A text is normalised to its words (``A-Z`` in lower case; a word is a run of digits, ``a-z`` and
letters beyond ASCII) with one space on either side of each. Every run of ``window`` consecutive
words of an item is a pattern; an item with fewer words is one pattern. Each text is scanned once
by the automaton; hits are mapped to word positions and to character offsets of the original.

Scale: a narrow map over the documents, no shuffle. The automaton is built in blocks of at most
``block_chars`` characters of patterns, so what is broadcast has a fixed bound; a suite larger than
one block is scanned block by block and the hits are united, with the same result.

Defined results: a null or empty text has no words; an item without words has no windows; repeated
rows are judged one by one; no items or no documents give no hits or no rows; a null item id is
reported as the empty string. Other columns are kept; the operator's own names replace clashing ones.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
BLOCK_CHARS = 16_000_000

_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_RESULT = (
    "n_words long, n_hit long, word_start array<int>, word_end array<int>, items array<string>, "
    "char_start array<int>, char_end array<int>"
)


def words(text: str | None) -> list[bytes]:
    """The words of a text, in UTF-8. Folding maps every separator to a space."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split(b" ") if text else []


def padded(text: str | None) -> tuple[str, int]:
    """Words with one space on either side of each, and their number."""
    found = [w for w in words(text) if w]
    return (" " + b" ".join(found).decode("utf-8", "surrogatepass") + " ", len(found)) if found else ("", 0)


def item_windows(text: str | None, window: int) -> set[tuple[str, int]]:
    """Padded patterns of one item with their word counts."""
    found = [w.decode("utf-8", "surrogatepass") for w in words(text) if w]  # str.split would also cut at blanks beyond ASCII
    size = min(window, len(found))
    return {(" " + " ".join(found[i : i + size]) + " ", size) for i in range(len(found) - size + 1)} if found else set()


def pattern_blocks(items: DataFrame, item_id: str, text: str, window: int, block_chars: int) -> Iterator[dict]:
    """Patterns with the items they come from, in blocks of bounded size; rows stream to the driver."""
    block: dict[str, tuple[int, list[str]]] = {}
    held = 0
    for row in items.select(F.col(item_id).cast("string"), F.col(text)).toLocalIterator():
        for pattern, size in item_windows(row[1], window):
            owners = block.setdefault(pattern, (size, []))[1]
            owners.append(row[0] or "")
            held += len(pattern) + 16
        if held >= block_chars:
            yield block
            block, held = {}, 0
    if block:
        yield block


_BUILT: dict[int, object] = {}


def automaton(key: int, packed: bytes):
    """The automaton of a block; built once per Python worker, one block at a time."""
    import ahocorasick

    if key not in _BUILT:
        _BUILT.clear()
        built = ahocorasick.Automaton()
        for pattern, value in pickle.loads(packed).items():
            built.add_word(pattern, value)
        built.make_automaton()
        _BUILT[key] = built
    return _BUILT[key]


def united(starts, ends) -> tuple[list[int], list[int]]:
    """Ranges merged where they touch or overlap."""
    order = np.argsort(starts, kind="stable")
    a, b = np.asarray(starts)[order], np.maximum.accumulate(np.asarray(ends)[order])
    opens = np.r_[True, a[1:] > b[:-1]]
    closes = np.r_[opens[1:], True]
    return a[opens].tolist(), b[closes].tolist()


def scan(text: str | None, built, known: tuple | None = None) -> tuple:
    """One text against one automaton; ``known`` holds what earlier blocks have found."""
    body, count = padded(text)
    starts, ends, items = ([], [], set()) if known is None else (list(known[0]), list(known[1]), set(known[2]))
    if built is not None and count:
        hits = [(at, size, owners) for at, (size, owners) in built.iter(body)]
        if hits:
            spaces = np.flatnonzero(np.frombuffer(body.encode("utf-32-le", "surrogatepass"), "<u4") == 32)
            last = np.searchsorted(spaces, [h[0] for h in hits])
            ends += last.tolist()
            starts += (last - [h[1] for h in hits]).tolist()
            items.update(x for h in hits for x in h[2])
    if not starts:
        return count, 0, [], [], [], [], []
    starts, ends = united(starts, ends)
    places = [m.span() for m in _WORD.finditer(text)]
    return (
        count, sum(ends) - sum(starts), starts, ends, sorted(items),
        [places[a][0] for a in starts], [places[b - 1][1] for b in ends],
    )


def _scanner(block: dict | None, spark):
    packed = spark.sparkContext.broadcast(pickle.dumps(block)) if block else None
    key = packed._jbroadcast.id() if packed else -1
    names = [c.split()[0] for c in _RESULT.split(", ")]

    def rows(texts: pd.Series, known: pd.DataFrame | None) -> pd.DataFrame:
        built = automaton(key, packed.value) if packed else None
        before = zip(known["word_start"], known["word_end"], known["items"], strict=True) if known is not None else [None] * len(texts)
        return pd.DataFrame([scan(t, built, k) for t, k in zip(texts, before, strict=True)], columns=names)

    @F.pandas_udf(_RESULT)
    def first(texts: pd.Series) -> pd.DataFrame:
        return rows(texts, None)

    @F.pandas_udf(_RESULT)
    def later(texts: pd.Series, known: pd.DataFrame) -> pd.DataFrame:
        return rows(texts, known)

    return first, later


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside any occurrence of a pattern), ``items`` (ids
    with occurring patterns, sorted as strings), ``contaminated`` and the hit ranges in words
    (``word_start``, ``word_end``) and in characters of the original (``char_start``, ``char_end``)."""
    spark = docs.sparkSession
    found: Column | None = None
    out = docs
    for n, block in enumerate(pattern_blocks(items, item_id, item_text, window, block_chars)):
        first, later = _scanner(block, spark)
        out = out.withColumn(f"_scan{n % 2}", first(F.col(text)) if found is None else later(F.col(text), found))
        found = F.col(f"_scan{n % 2}")
    if found is None:
        out = out.withColumn("_scan0", _scanner(None, spark)[0](F.col(text)))
        found = F.col("_scan0")
    names = [c.split()[0] for c in _RESULT.split(", ")]
    kept = [c for c in docs.columns if c not in {*names, "contaminated"}]
    return out.select(*kept, *[found[n].alias(n) for n in names], (found["n_hit"] > 0).alias("contaminated"))
