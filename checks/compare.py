"""Run queries next to their SQL: ``python -m checks.compare [sf_dir] [name ..]``."""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows in one order, missing values alike."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype) in ("string", "str", "bool"):
            df[c] = df[c].map(lambda v: "<null>" if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v)).astype(object)
        else:
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    """What differs, or None."""
    a, b = canonical(spark_rows), canonical(sql_rows)
    if list(a.columns) != list(b.columns):
        return f"columns {list(a.columns)} against {list(b.columns)}"
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    for c in a.columns:
        x, y = a[c], b[c]
        if x.dtype != y.dtype:
            if x.isin(["<null>"]).all() or x.isna().all():
                if (y.isin(["<null>"]) | y.isna()).all():
                    continue
            return f"{c}: type {x.dtype} against {y.dtype}"
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            at = int(np.argmin(same.to_numpy()))
            return f"{c}: {int((~same).sum())} values differ, first {x[at]!r:.200} against {y[at]!r:.200}"
    return None


def main(argv: list[str]) -> int:
    from checks.oracles import ORACLES
    from checks.queries import QUERIES
    from citeflow.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark, con, failed = local_session(), connect(sf_dir), []
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf_dir).toPandas()
            took = time.time() - start
            found = difference(got, con.execute(ORACLES[name]).df()) if name in ORACLES else "no SQL"
        except Exception as e:  # noqa: BLE001
            got, took, found = [], time.time() - start, f"{type(e).__name__}: {str(e)[:600]}"
        if found:
            failed.append(name)
        print(f"{name:28s} {len(got):7d} rows {took:6.2f} s  {found or 'ok'}", flush=True)
    print("failed:", failed or "none")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
