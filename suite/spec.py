"""How a query is registered: one column list shapes both the Spark and the SQL result."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPARK = {
    "s": lambda c: c.cast("string"),
    "i": lambda c: c.cast("bigint"),
    "b": lambda c: c.cast("boolean"),
    "d": lambda c: c.cast("date"),
    "t": lambda c: c.cast("timestamp_ntz"),
}
_SQL = {
    "s": "cast({0} as varchar)",
    "i": "cast({0} as bigint)",
    "b": "cast({0} as boolean)",
    "d": "cast({0} as date)",
    "t": "cast({0} as timestamp)",
}


def columns(text: str) -> list[tuple[str, str]]:
    """``"store_id:s units:i revenue:2"`` as (name, kind); a digit rounds a double."""
    return [tuple(part.split(":")) for part in text.split()]


# Halves go up with a margin for the last bits of distributed addition, by the same three
# operations in both engines.
HALF_UP = 0.500001


def shape_spark(df: DataFrame, cols) -> DataFrame:
    out = []
    for name, kind in cols:
        c = F.col(name)
        out.append(
            (F.floor(c.cast("double") * float(10 ** int(kind)) + HALF_UP) / float(10 ** int(kind)) if kind.isdigit() else _SPARK[kind](c)).alias(name)
        )
    return df.select(*out)


def shape_sql(body: str, cols) -> str:
    out = [
        (f"floor(cast({n} as double) * {10 ** int(k)}.0::double + {HALF_UP}::double) / {10 ** int(k)}.0::double" if k.isdigit() else _SQL[k].format(n)) + f" as {n}"
        for n, k in cols
    ]
    return f"select {', '.join(out)} from ({body}) final_rows"


def with_ctes(statement: str, library: dict[str, str]) -> str:
    """Prefix ``statement`` with the library entries it reads, each after those it needs."""
    order: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"[a-z_][a-z_0-9]*", text):
            if word in library and word not in order and word not in pending:
                pending.add(word)
                visit(library[word])
                order.append(word)

    pending: set[str] = set()
    visit(statement)
    if not order:
        return statement
    return "with " + ",\n".join(f"{n} as ({library[n].strip()})" for n in order) + "\n" + statement


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    cols: list[tuple[str, str]] | None = None
    sql: str | None = None
