"""Holds Spark rows against DuckDB's for the same tables."""

from __future__ import annotations

import glob
import math
import os


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


def rows_of(names, rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con, sql: str) -> str:
    cursor = con.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    got = rows_of(df.columns, df.collect())
    if want[0] != got[0]:
        return f"columns {got[0]} instead of {want[0]}"
    if len(want[1]) != len(got[1]):
        return f"{len(got[1])} rows instead of {len(want[1])}"
    for a, b in zip(got[1], want[1], strict=True):
        if a != b and not all(x == y or isinstance(x, float) and isinstance(y, (int, float)) and abs(x - y) <= 1e-5 * max(1, abs(x)) for x, y in zip(a, b, strict=True)):
            return f"{a} instead of {b}"
    return ""
