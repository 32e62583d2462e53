"""Compare every query with its SQL statement run by DuckDB on the same tables.

    python check_oracle.py [sf_dir] [name part ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from panelspark.plans import catalog
from panelspark.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].astype(str)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: None if v is None else str(v))
    return df.sort_values(list(df.columns), kind="stable", na_position="first").reset_index(drop=True)


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} vs {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} vs {len(sql_df)}"
    a, b = normal(spark_df), normal(sql_df)
    notes = []
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = (~same).idxmax()
            notes.append(f"{c}: {int((~same).sum())} differ, first {a.loc[i].to_dict()} vs {b.loc[i].to_dict()}")
        if str(a[c].dtype) != str(b[c].dtype) and not a[c].isna().any():
            notes.append(f"{c}: type {a[c].dtype} vs {b[c].dtype}")
    return "; ".join(notes)


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    spark = local_session(8)
    con = connect(sf_dir)
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            sql = catalog.ORACLES.get(name)
            if sql is None:
                print(f"----  {name}: {len(got)} rows, {took:.1f}s, no SQL", flush=True)
                continue
            start = time.time()
            want = con.execute(sql).df()
            note = differences(got, want)
        except Exception as e:  # noqa: BLE001
            took, note, got = time.time() - start, f"{type(e).__name__}: {str(e)[:600]}", []
        bad += bool(note)
        print(f"{'FAIL' if note else 'ok  '}  {name}: {len(got)} rows, spark {took:.1f}s, sql {time.time() - start:.1f}s {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
