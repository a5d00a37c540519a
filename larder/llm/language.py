"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent layers of ``hidden`` units read a window of bytes in both directions; from both states a
softmax labels every position, and a document's probabilities are the mean over all of its positions.
The network is trained here, in numpy, by backpropagation through time with Adam. States and gates are
bounded by ``x / (1 + |x|)``, which costs a quarter of a hyperbolic tangent and trains as well here.

Scale: training takes at most ``per_language`` documents of each language (a documented bound, chosen
by a hash of the id) and ``SLICES`` slices of each, whatever the size of the corpus. Prediction is a
narrow map without a shuffle: every byte of every text goes through the network, in windows of
``WINDOW`` bytes and blocks of bounded size, so that a very long text needs no more memory than others.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if there
is nothing to learn from. Rows with null language teach nothing. Repeated rows are judged alike, ties
between languages go to the first in order of name, other columns are kept and the operator's own
names replace clashing ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 64
SLICES = 4
PER_LANGUAGE = 500
HIDDEN = 8
BLOCK = 4096
UNKNOWN = "und"


@dataclass
class Direction:
    """Byte weights (3H x 256), state weights (3H x H): rows of update gate, reset gate, candidate."""

    byte: np.ndarray
    state: np.ndarray


@dataclass
class Network:
    labels: list[str]
    ahead: Direction
    back: Direction
    out: np.ndarray  # L x 2H
    bias: np.ndarray  # L x 1

    def arrays(self) -> list[np.ndarray]:
        return [self.ahead.byte, self.ahead.state, self.back.byte, self.back.state, self.out, self.bias]


def new_network(labels: list[str], hidden: int, seed: int, kind=np.float32) -> Network:
    rng = np.random.default_rng(seed)

    def one() -> Direction:
        state = rng.normal(0, hidden**-0.5, (3 * hidden, hidden)).astype(kind)
        return Direction(rng.normal(0, 0.3, (3 * hidden, 256)).astype(kind), state)

    out = rng.normal(0, 0.3, (len(labels), 2 * hidden)).astype(kind)
    return Network(labels, one(), one(), out, np.zeros((len(labels), 1), kind))


def _bounded(x: np.ndarray) -> np.ndarray:
    """To (-1, 1); its slope is ``(1 - |y|) ** 2`` in terms of its value."""
    return x / (1 + np.abs(x))


def _gate(x: np.ndarray) -> np.ndarray:
    """To (0, 1); its slope is ``(1 - |2 y - 1|) ** 2 / 2``."""
    return 0.5 * _bounded(x) + 0.5


def _slope(y: np.ndarray) -> np.ndarray:
    return (1 - np.abs(y)) ** 2


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=0))
    return e / e.sum(axis=0)


def _read(layer: Direction, steps: np.ndarray) -> list[tuple]:
    """What each step leaves for the way back: update, reset, candidate, its state part, states before and after."""
    size = layer.state.shape[1]
    h = np.zeros((size, steps.shape[1]), layer.state.dtype)
    kept = []
    for column in steps:
        x, a = layer.byte[:, column], layer.state @ h
        gates = _gate(x[: 2 * size] + a[: 2 * size])
        z, r = gates[:size], gates[size:]
        n = _bounded(x[2 * size :] + r * a[2 * size :])
        kept.append((z, r, n, a[2 * size :], h, h := n + z * (h - n)))
    return kept


def _back_through(layer: Direction, steps: np.ndarray, kept: list[tuple], pulls: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the byte and state weights, from the pull on the state after each step."""
    size = layer.state.shape[1]
    state, inputs, dh = np.zeros_like(layer.state), [], np.zeros_like(pulls[0])
    for (z, r, n, a, before, _), pull in zip(reversed(kept), reversed(pulls), strict=True):
        dh = dh + pull
        dn = dh * (1 - z) * _slope(n)
        dz = dh * (before - n) * _slope(2 * z - 1) / 2
        dr = dn * a * _slope(2 * r - 1) / 2
        da = np.concatenate([dz, dr, dn * r])
        inputs.append(np.concatenate([dz, dr, dn]))
        state += da @ before.T
        dh = dh * z + layer.state.T @ da
    flat, seen = np.concatenate(inputs[::-1], axis=1), steps.ravel()
    byte = np.stack([np.bincount(seen, weights=row, minlength=256) for row in flat]).astype(layer.byte.dtype)
    return byte, state


def loss_and_gradients(net: Network, steps: np.ndarray, wanted: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy over all positions of windows (``steps`` is positions x windows) and its gradients."""
    count, hidden = steps.shape[0], net.ahead.state.shape[1]
    ahead, back = _read(net.ahead, steps), _read(net.back, steps[::-1])
    d_out, d_bias, loss = np.zeros_like(net.out), np.zeros_like(net.bias), 0.0
    pull_ahead, pull_back = [], [None] * count
    truth = np.eye(len(net.labels), dtype=net.out.dtype)[:, wanted]
    for t in range(count):
        both = np.concatenate([ahead[t][5], back[count - 1 - t][5]])
        p = _softmax(net.out @ both + net.bias)
        loss -= float(np.log(np.maximum((p * truth).sum(axis=0), 1e-12)).mean())
        d = (p - truth) / (count * len(wanted))
        d_out += d @ both.T
        d_bias += d.sum(axis=1, keepdims=True)
        pull = net.out.T @ d
        pull_ahead.append(pull[:hidden])
        pull_back[count - 1 - t] = pull[hidden:]
    return loss / count, [
        *_back_through(net.ahead, steps, ahead, pull_ahead), *_back_through(net.back, steps[::-1], back, pull_back), d_out, d_bias
    ]


def train(samples: dict[str, list[bytes]], hidden: int = HIDDEN, steps: int = 240, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Network | None:
    """Adam over batches with as many windows of each language. None if there is no sample."""
    labels = sorted(k for k, v in samples.items() if any(v))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    windows = [np.stack([np.frombuffer(s[:WINDOW].ljust(WINDOW, b" "), np.uint8) for s in samples[k] if s]) for k in labels]
    net = new_network(labels, hidden, seed)
    first, second = [np.zeros_like(a) for a in net.arrays()], [np.zeros_like(a) for a in net.arrays()]
    for step in range(1, steps + 1):
        wanted = np.arange(batch) % len(labels)
        chosen = np.stack([windows[k][rng.integers(len(windows[k]))] for k in wanted])
        _, grads = loss_and_gradients(net, np.ascontiguousarray(chosen.T), wanted)
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for a, g, m, v in zip(net.arrays(), grads, first, second, strict=True):
            g = np.clip(g, -1, 1)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def _states(layer: Direction, columns: Iterator[tuple[np.ndarray, np.ndarray]], windows: int) -> Iterator[np.ndarray]:
    """States after each step, in buffers that are used again. A 257th byte is beyond a text's end."""
    state, size = layer.state, layer.state.shape[1]
    byte = np.concatenate([layer.byte, np.zeros((3 * size, 1), np.float32)], axis=1)
    spare = np.empty((2 * size, windows), np.float32)
    h = np.zeros((size, windows), np.float32)
    x = np.empty((3 * size, windows), np.float32)
    a = np.empty_like(x)
    for column, inside in columns:
        np.take(byte, column, axis=1, out=x, mode="clip")
        np.matmul(state, h, out=a)
        gates = x[: 2 * size]
        gates += a[: 2 * size]
        np.abs(gates, out=spare)
        spare += 1
        gates /= spare
        gates *= 0.5
        gates += 0.5
        n = a[2 * size :]
        n *= gates[size:]
        n += x[2 * size :]
        np.abs(n, out=spare[:size])
        spare[:size] += 1
        n /= spare[:size]
        h -= n
        h *= gates[:size]
        h += n
        h *= inside
        yield h


def position_probabilities(net: Network, steps: np.ndarray, inside: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(position, labels x windows) for each position of windows, last position first."""
    count, windows = steps.shape
    hidden = net.ahead.state.shape[1]
    ahead = np.empty((count, hidden, windows), np.float32)
    for t, h in enumerate(_states(net.ahead, zip(steps, inside, strict=True), windows)):
        ahead[t] = h
    left, right = np.ascontiguousarray(net.out[:, :hidden]), np.ascontiguousarray(net.out[:, hidden:])
    for t, h in zip(range(count - 1, -1, -1), _states(net.back, zip(steps[::-1], inside[::-1], strict=True), windows), strict=True):
        p = left @ ahead[t]
        p += right @ h
        p += net.bias
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        yield t, p


def _blocks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(windows x bytes with 256 beyond the end, number of the text of each window), at most ``BLOCK`` windows."""
    rows, owners, held = [], [], 0
    for number, text in enumerate(texts):
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) if text else ()
        for a in range(0, len(raw), WINDOW * BLOCK):
            part = raw[a : a + WINDOW * BLOCK]
            count = -(-len(part) // WINDOW)
            padded = np.full(count * WINDOW, 256, np.int16)
            padded[: len(part)] = part
            rows.append(padded.reshape(count, WINDOW))
            owners.append(np.full(count, number))
            held += count
            if held >= BLOCK:
                yield np.concatenate(rows), np.concatenate(owners)
                rows, owners, held = [], [], 0
    if held:
        yield np.concatenate(rows), np.concatenate(owners)


def document_probabilities(net: Network, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Per text the mean probability of each label over its positions, and the positions given each label."""
    count = len(net.labels)
    sums, votes, sizes = np.zeros((count, len(texts))), np.zeros((count, len(texts)), np.int64), np.zeros(len(texts))
    for rows, owners in _blocks(texts):
        steps = np.ascontiguousarray(rows.T, np.intp)
        inside = (steps < 256).astype(np.float32)
        pooled, chosen = np.zeros((count, len(owners)), np.float32), np.zeros((count, len(owners)), np.float32)
        for t, p in position_probabilities(net, steps, inside):
            p *= inside[t]
            pooled += p
            chosen += (p == p.max(axis=0)) & (p > 0)
        for k in range(count):
            sums[k] += np.bincount(owners, weights=pooled[k], minlength=len(texts))
            votes[k] += np.bincount(owners, weights=chosen[k], minlength=len(texts)).astype(np.int64)
        sizes += np.bincount(owners, weights=inside.sum(axis=0), minlength=len(texts))
    return sums / np.maximum(sizes, 1), votes


def label_runs(net: Network, text: str | None) -> list[tuple[int, int, str]]:
    """The label of every byte of one text, as (start, end, language) runs."""
    labels = []
    for rows, _ in _blocks([text]):
        steps = np.ascontiguousarray(rows.T, np.intp)
        best = np.empty(steps.shape, np.int64)
        for t, p in position_probabilities(net, steps, (steps < 256).astype(np.float32)):
            best[t] = p.argmax(axis=0)
        labels.append(best.T[rows < 256])
    if not labels:
        return []
    found = np.concatenate(labels)
    edges = np.flatnonzero(np.r_[True, found[1:] != found[:-1], True])
    return [(int(a), int(b), net.labels[found[a]]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def learn(docs: DataFrame, text: str, lang: str, key: str, per_language: int = PER_LANGUAGE, **how) -> Network | None:
    """Train on at most about ``per_language`` documents of each language, chosen by a hash of ``key``."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}  # one row per language
    if not counts:
        return None
    place = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(11)), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1_000_000, 1 + per_language * 1_000_000 // n))])
    room = F.greatest(F.length(text) - WINDOW // 2, F.lit(1))
    slices = F.array(*[
        F.substring(F.col(text), (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(i)), room) + 1).cast("int"), F.lit(WINDOW)) for i in range(SLICES)
    ])
    chosen = known.filter(place < share[F.col(lang)]).select(F.col(lang).alias("lang"), slices.alias("s"), place.alias("p"))
    # Each language for itself: ids that repeat, or more rows than places, take no room from others.
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("p", "s"))
    samples: dict[str, list[bytes]] = {}
    for r in chosen.withColumn("nth", nth).filter(F.col("nth") <= 2 * per_language).orderBy("p", "lang", "s").collect():
        samples.setdefault(r[0], []).extend(s.encode() for s in r[1] if s)
    return train(samples, **how)


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (its pooled probability), and ``positions`` (bytes given each
    label, in the order of the network's labels)."""
    shape = "lang_pred string, score double, positions array<long>"

    @F.pandas_udf(shape)
    def predict(texts: pd.Series) -> pd.DataFrame:
        rows = list(texts)
        if net is None:
            return pd.DataFrame({"lang_pred": [UNKNOWN] * len(rows), "score": 0.0, "positions": [[]] * len(rows)})
        p, votes = document_probabilities(net, rows)
        return pd.DataFrame({"lang_pred": [net.labels[k] for k in p.argmax(axis=0)], "score": np.clip(p.max(axis=0), 0, 1), "positions": list(votes.T)})

    kept = [c for c in docs.columns if c not in {"lang_pred", "score", "positions"}]
    found = docs.withColumn("_found", predict(F.col(text)))
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return found.select(
        *kept, F.when(letters, F.col("_found.lang_pred")).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(letters, F.col("_found.score")).otherwise(0.0).alias("score"), F.col("_found.positions").alias("positions"),
    )


def remainder(key: str, parts: int) -> Column:
    """The fold of a row: CRC-32 of the id as text; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(parts))
