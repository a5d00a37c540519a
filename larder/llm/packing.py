"""Vector bin packing of examples into fixed-length training sequences.

Each piece has three sizes: tokens, segments (one a piece) and loss-bearing tokens. A sequence has a
limit on each. Sequences are filled one at a time: of the pieces that still fit, the one with the
largest dot product between its sizes and what is left of the limits (both as shares of the limits)
goes in next, until none fits.

Documents are cut into pieces of at most ``limits[0]`` tokens; whole pieces fill a sequence alone, the
rest of each document is packed. Packing runs inside each input partition over a pool of bounded
size: a partition needs the memory of one pool, and a lost task repacks only its own rows, with the same
result. Badly filled sequences of a pool go back into the next one; those of a partition's last pool are
packed in a second pass, together with those of other partitions, so small partitions cost no padding.
Pieces are written as numbers between the passes; texts are read once and never shuffled.
In documents every token bears loss, so there the third limit says the same as the first.

Defined results: a null or empty text is one piece with the separator alone; repeated rows are packed
one by one; no rows give no pieces. A piece over a limit on its own raises an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larder.workspace import cut_lineage

LIMITS = (1024, 256, 1024)
POOL = 2048
WELL_FILLED = 0.98
#: Rows of one partition's sequence numbers; partitions do not meet.
STRIDE = 1 << 32
#: Where the numbers of sequences of the second pass begin.
SECOND = 1 << 61
POOLS_A_TASK = 16


def fill(sizes: np.ndarray, limits: tuple[int, ...]) -> list[list[int]]:
    """Positions of the pieces of each sequence, by the dot-product rule; ties go to the first piece
    in order of size and position."""
    cap = np.asarray(limits, np.int64)
    if len(sizes) and (sizes > cap).any():
        raise ValueError("a piece exceeds a limit on its own")
    order = np.lexsort((np.arange(len(sizes)), -sizes[:, 0])) if len(sizes) else np.empty(0, int)
    left = sizes[order]
    share = left / cap
    out = []
    while len(order):
        room, own = cap.copy(), []
        taken = np.zeros(len(order), bool)
        while True:
            fits = np.flatnonzero((left <= room).all(axis=1) & ~taken)
            if not len(fits):
                break
            best = fits[np.argmax(share[fits] @ (room / cap))]
            taken[best] = True
            own.append(int(order[best]))
            room -= left[best]
        out.append(own)
        order, left, share = order[~taken], left[~taken], share[~taken]
    return out


def pack_pool(sizes: np.ndarray, limits: tuple[int, ...], last: bool) -> tuple[list[list[int]], list[int]]:
    """Sequences to write, and positions that go back into the next pool."""
    done, back = [], []
    for own in fill(sizes, limits):
        full = (sizes[own].sum(axis=0) / np.asarray(limits)).max()
        if last or full >= WELL_FILLED or len(back) >= len(sizes) // 2:
            done.append(own)
        else:
            back += own
    return done, back


def pack_sized(df: DataFrame, sizes: list[str], limits: tuple[int, ...], pool: int = POOL) -> DataFrame:
    """Examples that are already sized (columns ``sizes``: tokens, segments, loss-bearing tokens) with
    ``sequence_id`` and ``slot`` in it. Other columns are kept. A null size counts as zero."""
    from pyspark import TaskContext

    schema = df.drop("sequence_id", "slot")
    shape = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema.schema.fields)}, sequence_id long, slot long"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, number = TaskContext.get().partitionId() * STRIDE, 0
        held = None
        for part, last in _with_end(parts):
            held = part if held is None else held if part is None else pd.concat([held, part], ignore_index=True)
            while held is not None and len(held) and (last or len(held) >= pool):
                now = held if last and len(held) <= pool else held.iloc[:pool]
                rest = held.iloc[len(now) :]
                ending = last and not len(rest)
                done, back = pack_pool(now[sizes].fillna(0).to_numpy(np.int64), limits, ending)
                rows = [i for own in done for i in own]
                yield now.iloc[rows].assign(
                    sequence_id=np.repeat(np.arange(number, number + len(done)) + base, [len(o) for o in done]),
                    slot=np.concatenate([np.arange(len(o)) for o in done]) if done else [],
                )
                number += len(done)
                held = pd.concat([now.iloc[back], rest], ignore_index=True) if back or len(rest) else None

    return schema.mapInPandas(run, shape)


def _with_end(parts: Iterator) -> Iterator[tuple]:
    """Each part with a mark on the last; an empty input gives one empty last part."""
    held = None
    for part in parts:
        if held is not None:
            yield held, False
        held = part
    yield held, True


def pieces_of(ids: np.ndarray, most: int) -> list[tuple[int, int, int]]:
    """(start, length, CRC-32 of the ids as little-endian unsigned 32-bit) of each piece."""
    return [(a, len(x := ids[a : a + most]), zlib.crc32(x.tobytes())) for a in range(0, len(ids), most)]


_COLUMNS = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "segment"]
_SHAPE = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, segment long"


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    separator: int = 0,
    limits: tuple[int, int, int] = LIMITS,
    pool: int = POOL,
) -> DataFrame:
    """One row per piece: the document's id, ``start`` (ids before it), ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset`` and ``segment`` in the sequence. Every token of a document
    bears loss. ``tokenizer`` is the path of a byte-level vocabulary; ``separator`` ends each document."""
    from pyspark import TaskContext

    from larder.llm.tokens import encoder

    kind = docs.schema[doc_id].dataType.simpleString()
    most = min(limits[0], limits[2])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, number = TaskContext.get().partitionId() * STRIDE, 0
        encode = encoder(tokenizer).encode
        held: list[tuple] = []

        def placed(sequences: list[list[tuple]]) -> pd.DataFrame:
            nonlocal number
            rows = []
            for own in sequences:
                offset = 0
                for slot, (i, start, length, crc, total) in enumerate(own):
                    rows.append((i, start, length, crc, total, base + number, offset, slot))
                    offset += length
                number += 1
            return pd.DataFrame(rows, columns=_COLUMNS)

        def flush() -> pd.DataFrame:
            nonlocal held
            sizes = np.array([(p[2], 1, p[2]) for p in held], np.int64).reshape(-1, 3)
            done, back = pack_pool(sizes, limits, False)
            out = placed([[held[i] for i in own] for own in done])
            held = [held[i] for i in back]
            return out

        def leave() -> Iterator[pd.DataFrame]:
            """What fills sequences well is placed; the rest is left for the second pass, without a sequence."""
            sizes = np.array([(p[2], 1, p[2]) for p in held], np.int64).reshape(-1, 3)
            groups = fill(sizes, limits)
            full = [(sizes[own].sum(axis=0) / np.asarray(limits)).max() >= WELL_FILLED for own in groups]
            yield placed([[held[i] for i in own] for own, f in zip(groups, full, strict=True) if f])
            rest = [held[i] for own, f in zip(groups, full, strict=True) if not f for i in own]
            yield pd.DataFrame([(*p, None, None, None) for p in rest], columns=_COLUMNS).astype(dict.fromkeys(_COLUMNS[5:], "Int64"))

        for part in parts:
            for a in range(0, len(part), 256):
                whole = []
                for i, t in zip(part[doc_id].iloc[a : a + 256], part[text].iloc[a : a + 256], strict=True):
                    ids = np.array([*(encode(t) if t else ()), separator], "<u4")
                    for start, length, crc in pieces_of(ids, most):
                        (whole if length == limits[0] else held).append((i, start, length, crc, len(ids)))
                if whole:
                    yield placed([[p] for p in whole])
                if len(held) >= pool:
                    yield flush()
        if held:
            yield from leave()

    # The id travels as text so that nulls and every type survive the way through Python.
    sent = docs.select(F.col(doc_id).cast("string").alias(doc_id), F.col(text).cast("string").alias(text))
    first = cut_lineage(sent.mapInPandas(run, f"id string, {_SHAPE}"))  # numbers only, no text
    left = first.filter("sequence_id is null")
    # Each task of the second pass fills many pools, however small the partitions of the documents are.
    tasks = max(1, left.count() // (POOLS_A_TASK * pool))
    again = left.select("id", "start", "length", "ids_crc32", "doc_tokens", F.lit(1).cast("long").alias("one")).repartition(tasks)
    packed = pack_sized(again, ["length", "one", "length"], limits, pool)
    inside = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most limits[1] rows
    second = packed.select(
        "id", "start", "length", "ids_crc32", "doc_tokens", (F.col("sequence_id") + SECOND).alias("sequence_id"),
        F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"), F.col("slot").alias("segment"),
    )
    out = first.filter("sequence_id is not null").unionByName(second)
    return out.select(F.col("id").cast(kind).alias(doc_id), *[c.split()[0] for c in _SHAPE.split(", ")])
