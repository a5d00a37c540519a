"""Chat formatting by minimum-cost role repair.

An automaton says which turns are legal: an optional system turn, then user and assistant in turn, ending
with the assistant. Dynamic programming over its states finds the cheapest way to make a conversation
legal: a turn keeps its role, is relabelled, or is merged into the turn before it, and empty turns may be
inserted. The repaired sequence is rendered with role and end markers.

The result has one row per turn of the input and per inserted turn (``piece`` counts them from 0 in each
conversation), with the repaired turn it belongs to; ``rendered`` in the order of ``piece``, put together,
is the formatted conversation. So no row grows with the number of turns.

Scale: rows are range-partitioned once by conversation, turn, role and text and written. A conversation
inside one partition is solved there. One that spans partitions, of any length, is solved in slices: each
slice first gives its table of least costs from every state to every state (at most two tables a
partition, which the driver chains), then, with its first and last state known, its own rows.

Defined results: turns are in order of ``turn``, then role and text; a null turn comes first; null roles and
roles not in ``ROLES`` have to be relabelled or merged; a null text counts as empty and stays a turn; repeated
rows are turns of their own (and get merged); rows without a conversation id are one conversation. Among
repairs of one cost the choice is fixed by the order keep, merge, relabel, insert and by the slices.
An empty table gives no rows. Other columns are not kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.workspace import cut_lineage

ROLES = ("system", "user", "assistant")
#: Costs of a merge, a relabelling and an inserted empty turn.
MERGE, RELABEL, INSERT = 1, 2, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: Legal turns: state before -> (role, state after).
LEGAL = {START: ((0, SYSTEM), (1, USER)), SYSTEM: ((1, USER),), USER: ((2, ASSISTANT),), ASSISTANT: ((1, USER),)}
FAR = 1 << 40
END = "<|end|>\n"


@dataclass(frozen=True)
class Step:
    """The cheapest way from one state to another over one turn of the input."""

    cost: int
    inserted: tuple[int, ...]
    action: str
    role: int

    @property
    def emitted(self) -> int:
        return len(self.inserted) + (self.action != "merge")


def _insertions(state: int) -> Iterator[tuple[int, tuple[int, ...]]]:
    """States that empty turns lead to, with the roles inserted on a shortest way (never a system turn)."""
    seen, queue = {state}, [(state, ())]
    while queue:
        at, roles = queue.pop(0)
        yield at, roles
        for role, after in LEGAL[at]:
            if role and after not in seen:
                seen.add(after)
                queue.append((after, (*roles, role)))


def _steps() -> dict[int, dict[tuple[int, int], Step]]:
    """Per role of the input (3 is any other) and pair of states. Ties: keep, merge, relabel, then fewer insertions."""
    rank = {"keep": 0, "merge": 1, "relabel": 2}
    out: dict[int, dict[tuple[int, int], Step]] = {}
    for given in range(4):
        table: dict[tuple[int, int], list] = {}
        for state in range(4):
            if state != START:
                change = 0 if state - 1 == given else RELABEL
                table.setdefault((state, state), []).append(Step(MERGE + change, (), "merge", state - 1))
            for at, inserted in _insertions(state):
                for role, after in LEGAL[at]:
                    action = "keep" if role == given else "relabel"
                    cost = INSERT * len(inserted) + (0 if role == given else RELABEL)
                    table.setdefault((state, after), []).append(Step(cost, inserted, action, role))
        out[given] = {k: min(v, key=lambda s: (s.cost, rank[s.action], len(s.inserted))) for k, v in table.items()}
    return out


STEPS = _steps()
#: Roles inserted after the last turn, by state.
CLOSING = {s: next(i for at, i in _insertions(s) if at == ASSISTANT) for s in range(4)}


def _arrays() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cost, emitted, inserted = (np.zeros((4, 4, 4), np.int64) for _ in range(3))
    cost += FAR
    for given, table in STEPS.items():
        for (a, b), step in table.items():
            cost[given, a, b], emitted[given, a, b], inserted[given, a, b] = step.cost, step.emitted, len(step.inserted)
    return cost, emitted, inserted


_COST, _EMITTED, _INSERTED = _arrays()


def summary(roles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least cost, turns emitted and turns inserted from every state to every state over a slice."""
    cost = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(cost, 0)
    emitted, inserted = np.zeros((4, 4), np.int64), np.zeros((4, 4), np.int64)
    rows, columns = np.indices((4, 4))
    for r in roles:
        ways = np.minimum(cost[:, :, None] + _COST[r][None], FAR)
        before = ways.argmin(axis=1)
        cost = ways.min(axis=1)
        emitted = emitted[rows, before] + _EMITTED[r][before, columns]
        inserted = inserted[rows, before] + _INSERTED[r][before, columns]
    return cost, emitted, inserted


def best_path(roles: np.ndarray, first: int, last: int | None) -> tuple[int, list[tuple[int, int]]]:
    """(cost, states before and after each turn); ``last`` None also pays for the closing turns."""
    cost = np.full(4, FAR, np.int64)
    cost[first] = 0
    back = np.empty((len(roles), 4), np.int8)
    for t, r in enumerate(roles):
        ways = cost[:, None] + _COST[r]
        back[t] = ways.argmin(axis=0)
        cost = np.minimum(ways.min(axis=0), FAR)
    if last is None:
        ends = cost + INSERT * np.array([len(CLOSING[s]) for s in range(4)])
        last = int(ends.argmin())
        total = int(ends[last])
    else:
        total = int(cost[last])
    path, at = [], last
    for t in range(len(roles) - 1, -1, -1):
        path.append((int(back[t, at]), at))
        at = int(back[t, at])
    return total, path[::-1]


@dataclass(frozen=True)
class Slice:
    """What a slice of a spanning conversation has to know: states at its ends and what went before it."""

    first: int
    last: int | None
    turns: int
    pieces: int
    cost: int


def chain(slices: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]) -> list[Slice]:
    """States at the ends of every slice of one conversation, from (cost, emitted, inserted, rows) tables in order."""
    cost = np.full(4, FAR, np.int64)
    cost[START] = 0
    entries = []
    for table, *_ in slices:
        entries.append(cost)
        cost = np.minimum((cost[:, None] + table).min(axis=0), FAR)
    ends = cost + INSERT * np.array([len(CLOSING[s]) for s in range(4)])
    at = int(ends.argmin())
    total = int(ends[at])
    path = [at]
    for entry, (table, *_) in zip(reversed(entries), reversed(slices), strict=True):
        at = int((entry + table[:, at]).argmin())
        path.append(at)
    path = path[::-1]
    out, turns, pieces = [], 0, 0
    for n, (_, emitted, inserted, rows) in enumerate(slices):
        a, b = path[n], path[n + 1]
        out.append(Slice(a, None if n == len(slices) - 1 else b, turns, pieces, total))
        turns, pieces = turns + int(emitted[a, b]), pieces + int(inserted[a, b]) + rows
    return out


def render(role: int, text: str, action: str, turn: int) -> str:
    """One piece: a merged one continues its turn, any other closes the turn before and opens its own."""
    return f"\n\n{text}" if action == "merge" else f"{END if turn else ''}<|{ROLES[role]}|>\n{text}"


def repair(roles: np.ndarray, texts: list[str], given: list, turns_given: list, part: Slice | None) -> list[tuple]:
    """Rows of one conversation, or of one slice of it."""
    part = part or Slice(START, None, 0, 0, -1)
    cost, path = best_path(roles, part.first, part.last)
    total = cost if part.cost < 0 else part.cost
    turn, piece, out = part.turns - 1, part.pieces, []

    def put(role: int, text: str, action: str, old_role, old_turn) -> None:
        nonlocal turn, piece
        turn += action != "merge"
        out.append((piece, turn, ROLES[role], action, old_role, old_turn, render(role, text, action, turn), total))
        piece += 1

    for t, (a, b) in enumerate(path):
        step = STEPS[int(roles[t])][a, b]
        for role in step.inserted:
            put(role, "", "insert", None, None)
        put(step.role, texts[t], step.action, given[t], turns_given[t])
    if part.last is None:
        for role in CLOSING[path[-1][1]]:
            put(role, "", "insert", None, None)
        last = out[-1]
        out[-1] = (*last[:6], last[6] + END, last[7])
    return out


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of one conversation; rows come in order, a run may go over several batches."""
    held: list[pd.DataFrame] = []
    for part in batches:
        keys = part["key"].to_numpy()
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(part)], strict=True):
            if held and held[-1]["key"].iloc[-1] != keys[lo]:
                yield pd.concat(held, ignore_index=True)
                held = []
            held.append(part.iloc[lo:hi])
    if held:
        yield pd.concat(held, ignore_index=True)


def _codes(roles: pd.Series) -> np.ndarray:
    known = {r: i for i, r in enumerate(ROLES)}
    return np.array([known.get(r.strip().lower(), 3) if isinstance(r, str) else 3 for r in roles], np.int8)


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Tables of the first and the last conversation of a partition."""
    first = last = None
    for run in _conversations(batches):
        last = run
        if first is None:
            first = run
    for run in [first] if first is last else [first, last]:
        if run is not None:
            tables = [x.ravel().tolist() for x in summary(_codes(run["role"]))]
            yield pd.DataFrame({"range": [run["range"].iloc[0]], "key": [run["key"].iloc[0]], "rows": [len(run)], "cost": [tables[0]], "emitted": [tables[1]], "inserted": [tables[2]]})


_SHAPE = "piece long, out_turn long, role string, action string, given_role string, given_turn long, rendered string, repair_cost long"


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations, piece by piece: ``conv_id``, ``piece``, ``out_turn``, ``role``, ``action`` (keep,
    merge, relabel or insert), ``given_role``, ``given_turn``, ``rendered`` and ``repair_cost`` of the conversation."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = turns.schema[conv_id].dataType.simpleString()
    named = turns.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv_id).cast("string")), F.lit("")).alias("key"),
        F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.monotonically_increasing_id().alias("tie"),
    )
    # The tie number parts equal rows, so one much repeated turn is spread like any other rows.
    order = [F.col("key"), F.col("turn"), F.col("role"), F.col("text"), F.col("tie")]
    ranged = cut_lineage(named.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie").withColumn("range", F.spark_partition_id()))
    shape = "range int, key string, rows long, cost array<long>, emitted array<long>, inserted array<long>"
    ends = ranged.select("range", "key", "role").mapInPandas(_ends, shape)
    # At most two rows a partition, and of those only conversations that go over a border.
    shared = ends.withColumn("slices", F.count("*").over(Window.partitionBy("key"))).filter("slices > 1")
    chains: dict[str, list] = {}
    for r in sorted(shared.collect(), key=lambda r: r["range"]):
        chains.setdefault(r["key"], []).append(r)
    known: dict[tuple[int, str], Slice] = {}
    for key, rows in chains.items():
        tables = [(*(np.array(r[c], np.int64).reshape(4, 4) for c in ("cost", "emitted", "inserted")), r["rows"]) for r in rows]
        known |= {(r["range"], key): s for r, s in zip(rows, chain(tables), strict=True)}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", *[c.split()[0] for c in _SHAPE.split(", ")]]
        held: list[tuple] = []
        for run in _conversations(batches):
            key = run["key"].iloc[0]
            given = [r if isinstance(r, str) else None for r in run["role"]]
            old = [None if pd.isna(t) else int(t) for t in run["turn"]]
            rows = repair(_codes(run["role"]), list(run["text"]), given, old, known.get((int(run["range"].iloc[0]), key)))
            held += [(key, *r) for r in rows]
            if len(held) >= 5000:
                yield pd.DataFrame(held, columns=names).astype({"given_turn": "Int64"})
                held = []
        if held:
            yield pd.DataFrame(held, columns=names).astype({"given_turn": "Int64"})

    out = ranged.mapInPandas(solve, f"key string, {_SHAPE}")
    name = F.when(F.col("key") == "", F.lit(None)).otherwise(F.substring("key", 2, 1 << 30)).cast(kind)
    return out.select(name.alias("conv_id"), *[c.split()[0] for c in _SHAPE.split(", ")])


def whole_chats(pieces: DataFrame) -> DataFrame:
    """One text per conversation. For conversations that fit a row; ``format_chats`` itself has no such bound."""
    parts = F.array_sort(F.collect_list(F.struct("piece", "rendered")))
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["rendered"]), "").alias("text"), F.max("repair_cost").alias("repair_cost"))
