"""Run registered queries against their SQL: ``python -m suite.check FOLDER [name ...]``."""

from __future__ import annotations

import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(frame):
    import pandas as pd

    out = pd.DataFrame()
    if frame.empty:
        return pd.DataFrame({c: pd.Series(dtype=object) for c in sorted(frame.columns)})
    for c in sorted(frame.columns):
        col = frame[c]
        if pd.api.types.is_bool_dtype(col):
            out[c] = col.map(lambda v: "null" if v is None or v is pd.NA or v != v else str(bool(v)))
        elif pd.api.types.is_numeric_dtype(col):
            out[c] = col.astype("float64").map(lambda v: "null" if v != v else f"{v:.6f}")
        else:
            out[c] = col.map(lambda v: "null" if v is None or v is pd.NaT or v != v else str(v).replace(" 00:00:00", "").replace(".000000", ""))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def main(folder: str, names: list[str]) -> int:
    import duckdb
    from pyspark.sql import SparkSession

    from suite.registry import all_queries

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    bad = 0
    for name, query in all_queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            got = query.run(spark, folder).toPandas()
        except Exception as e:  # a check run reports every query
            bad += 1
            print(f"ERROR {name} spark: {str(e)[:1200]}", flush=True)
            continue
        took = time.time() - start
        if query.sql is None:
            print(f"rows  {name} {len(got)} {took:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            want = con.execute(query.sql).df()
        except Exception as e:
            bad += 1
            print(f"ERROR {name} sql: {str(e)[:1200]}", flush=True)
            continue
        sql_took = time.time() - start
        a, b = canonical(got), canonical(want)
        if list(a.columns) == list(b.columns) and len(a) == len(b) and a.equals(b):
            print(f"ok    {name} {len(a)} spark {took:.1f}s sql {sql_took:.1f}s", flush=True)
            continue
        bad += 1
        print(f"DIFF  {name} rows {len(a)} vs {len(b)} cols {set(a.columns) ^ set(b.columns)}", flush=True)
        if len(a) == len(b):
            for c in a.columns:
                differs = a[c] != b[c]
                if differs.any():
                    i = differs.idxmax()
                    print(f"      {c}: {differs.sum()} e.g. {a[c][i]!r} vs {b[c][i]!r}", flush=True)
        else:
            import pandas as pd

            merged = a.merge(b, how="outer", indicator=True)
            print(merged[merged._merge != "both"].head(4).to_string(), flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
