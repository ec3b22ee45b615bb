"""Run registered queries next to their SQL in DuckDB: ``python tools/check.py [sf] [filter ...]``."""

from __future__ import annotations

import importlib
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tidemark.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda v: "<null>" if v is None or v is pd.NaT or v != v else str(v))
        elif df[c].dtype == bool:
            df[c] = df[c].astype(str)
        else:
            df[c] = df[c].astype("float64").fillna(-1.2345e300)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(a: pd.DataFrame, b: pd.DataFrame) -> str:
    if sorted(a.columns) != sorted(b.columns):
        return f"COLUMNS {sorted(a.columns)} != {sorted(b.columns)}"
    if len(a) != len(b):
        return f"ROWS {len(a)} != {len(b)}"
    a, b = canonical(a), canonical(b)
    for c in a.columns:
        if a[c].dtype == object or b[c].dtype == object:
            bad = a[c].astype(str) != b[c].astype(str)
        else:
            bad = pd.Series(~np.isclose(a[c], b[c], rtol=0, atol=0))
        if bad.any():
            i = int(np.argmax(bad.to_numpy()))
            return f"VALUES {c}: {int(bad.sum())} differ, e.g. {a[c][i]!r} != {b[c][i]!r}"
    return "ok"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    spark = local_session("check", "8")
    entry = importlib.import_module("__spark_entry__")
    queries, oracle = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            got = fn(spark, folder).toPandas()
            took = time.time() - t0
            if name in oracle:
                t1 = time.time()
                want = con.execute(oracle[name]).df()
                status = compare(got, want)
                status += f" (duckdb {time.time() - t1:.1f}s)" if time.time() - t1 > 2 else ""
            else:
                status = f"ok rows-only nulls={int(got.isna().sum().sum())}"
        except Exception as err:
            took, got = time.time() - t0, None
            status = "ERROR " + str(err)[:1500]
        if not status.startswith("ok"):
            bad += 1
        rows = -1 if got is None else len(got)
        print(f"{name:34s} {took:6.2f}s rows={rows:6d} {status}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
