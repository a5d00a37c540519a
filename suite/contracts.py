"""The contracts of the tables as SQL, and a damaged copy of each table that breaks them in every way it can.

Both are made from ``larder.quality.contracts``: the statement counts on the CTE of a table what the library counts on the
table. A damaged copy repeats the rows whose key hashes to a zero, and in the repeated rows breaks every column that has a rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larder.quality.contracts import CONTRACTS, Contract, contract_results
from suite.spec import columns

#: Tables whose statement is not one CTE, or that another module registers.
BODIES = {
    "stg_quarantine": ("select * from quarantine", "source_name:s reason_code:s record_key:s event_date:d arrival_date:d impact_units:2"),
    "stg_crm__customers": (
        "select *, dt as snapshot_date from customer_snapshot",
        "customer_id:s home_store_id:s acquisition_channel:s device:s is_member:b signup_date:d churn_date:d snapshot_date:d",
    ),
    "stg_crm__deal_exposure": (
        "select *, deal_arm = 'exposed' as is_deal_exposed from crm_deal_exposure", "customer_id:s deal_arm:s is_deal_exposed:b assigned_date:d holdout_share:2",
    ),
    "fct_price_history": (
        "select * from price_spans",
        "store_id:s sku_id:s interval_no:i effective_from_date:d effective_to_date:d duration_days:i base_price:2 realized_price:2 discount_amt:2 discount_pct:6 "
        "is_promo_stacked:b max_promos_active:i is_open_at_window_end:b",
    ),
    "mart_expiry_risk": (
        "select * from risk",
        "batch_id:s store_id:s sku_id:s l1_category:s sku_name:s date_day:d expiry_date:d days_to_expiry:i usable_days:i qty_remaining:i units_ahead_in_queue:i "
        "risk_state:s expiry_risk_score:6 units_at_risk:5 unit_landed_cost:2",
    ),
}


def shapes(tables: dict[str, tuple[str, str]]) -> dict[str, tuple[str, list[tuple[str, str]]]]:
    """Per contracted table its statement, and its columns with their kinds; ``tables`` has (CTE, columns) by name."""
    known = {name: (f"select * from {cte}", cols) for name, (cte, cols) in tables.items()} | BODIES
    return {t: (known[t][0], columns(known[t][1])) for t in CONTRACTS if t in known}


def narrowed(contract: Contract, names: set[str]) -> Contract:
    """What a contract says about some of the columns."""
    held = lambda *c: set(c) <= names
    return Contract(
        contract.nullable, tuple(c for c in contract.unique if held(c)), tuple(k for k in contract.compound_unique if held(*k)),
        tuple(r for r in contract.references if held(r[0])), {c: v for c, v in contract.accepted.items() if held(c)},
        {c: v for c, v in contract.between.items() if held(c)}, tuple(p for p in contract.at_least if held(*p)),
    )


def key_of(contract: Contract, cols: list[tuple[str, str]]) -> str:
    """The text, date or number whose hash picks the rows to damage."""
    return contract.unique[0] if contract.unique else contract.compound_unique[0][0] if contract.compound_unique else cols[0][0]


def broken(contract: Contract, cols: list[tuple[str, str]]) -> dict[str, tuple[str, str | float | None]]:
    """What the repeated rows hold instead: a strange name, a number out of bounds, the other column of a pair less one, a null."""
    keys = {*contract.unique, *(c for k in contract.compound_unique for c in k), key_of(contract, cols)}
    out: dict[str, tuple[str, str | float | None]] = {a: ("less", b) for a, b in contract.at_least if a not in keys}
    out |= {c: ("value", v[1] + 1) for c, v in contract.between.items() if c not in keys}
    out |= {c: ("value", "nobody") for c in [*contract.accepted, *(r[0] for r in contract.references)] if c not in keys}
    plain = [c for c, _ in cols if c not in keys and c not in out and c not in contract.nullable and c not in {b for _, b in contract.at_least}]
    return out | ({plain[0]: ("null", None)} if plain else {})


def damaged(df: DataFrame, contract: Contract, cols: list[tuple[str, str]]) -> DataFrame:
    changes = broken(contract, cols)

    def new(c: str) -> Column:
        kind, value = changes.get(c, (None, None))
        if kind is None:
            return F.col(c)
        return (F.col(value) - 1 if kind == "less" else F.lit(value)).cast(df.schema[c].dataType).alias(c)

    again = df.filter(F.startswith(F.md5(F.col(key_of(contract, cols)).cast("string")), F.lit("0")))
    return df.unionByName(again.select(*[new(c) for c in df.columns]))


def contract_checks(wh, tables: dict[str, tuple[str, str]], damage: bool = False) -> DataFrame:
    """The library's results over all contracted tables, or over a damaged copy of each; parents stay whole."""
    out = []
    for t, (_, cols) in shapes(tables).items():
        contract, df = narrowed(CONTRACTS[t], {c for c, _ in cols}), wh(t).select(*[c for c, _ in cols])
        out.append(contract_results(damaged(df, contract, cols) if damage else df, t, contract, wh))
    return reduce(DataFrame.unionByName, out)


def contract_sql(tables: dict[str, tuple[str, str]], damage: bool = False) -> str:
    """The same counts in SQL: one scan a table for the row tests, one more for each key and parent."""
    known, parts, ctes = shapes(tables), [], []
    quote = lambda v: "null" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    for t, (body, cols) in known.items():
        contract = narrowed(CONTRACTS[t], {c for c, _ in cols})
        plain = f"select {', '.join(c for c, _ in cols)} from ({body})"
        if damage:
            changes = broken(contract, cols)
            new = [f"{changes[c][1]} - 1" if changes.get(c, " ")[0] == "less" else quote(changes[c][1]) if c in changes else c for c, _ in cols]
            plain = f"with own as ({plain}) select * from own union all select {', '.join(new)} from own where md5(cast({key_of(contract, cols)} as varchar)) like '0%'"
        ctes.append(f"checked_{t} as materialized ({plain})")
        tests = [("not_null", c, f"{c} is null") for c, _ in cols if c not in contract.nullable]
        tests += [("accepted_values", c, f"{c} not in ({', '.join(map(quote, v))})") for c, v in contract.accepted.items()]
        tests += [("between", c, f"{c} not between {lo} and {hi}") for c, (lo, hi) in contract.between.items()]
        tests += [("at_least", f"{a},{b}", f"{a} < {b}") for a, b in contract.at_least]
        rows = ", ".join(f"{{'k': '{k}', 'c': '{c}', 'n': count(*) filter (where {bad})}}" for k, c, bad in tests)
        parts.append(f"select x.k as check_name, '{t}' as table_name, x.c as column_name, x.n as failed_rows from (select unnest([{rows}]) as x from checked_{t})")
        for keys in [(c,) for c in contract.unique] + list(contract.compound_unique):
            kind, listed = "unique" if len(keys) == 1 else "compound_unique", ", ".join(keys)
            filled = " and ".join(f"{c} is not null" for c in keys)
            parts.append(f"select '{kind}', '{t}', '{','.join(keys)}', count(*) from (select 1 from checked_{t} where {filled} group by {listed} having count(*) > 1)")
        for column, parent, key in contract.references:
            parts.append(f"select 'relationships', '{t}', '{column}', count(*) from checked_{t} where {column} is not null and {column} not in (select {key} from ({known[parent][0]}) where {key} is not null)")
    return f"with {', '.join(ctes)} {' union all '.join(parts)}"
