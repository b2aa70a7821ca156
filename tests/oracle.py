"""Compare a registered query with its SQL on the same parquet tables."""

from __future__ import annotations

import math
import threading

import duckdb

SQL_SECONDS = 60

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql: str) -> tuple[bool, str]:
    got = rows_of(df.columns, df.collect())
    stop = threading.Timer(SQL_SECONDS, con.interrupt)
    stop.start()
    try:
        res = con.execute(sql)
        names = [d[0] for d in res.description]
        want = rows_of(names, res.fetchall())
    finally:
        stop.cancel()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        return False, f"{len(got)} rows vs {len(want)}"
    for a, b in zip(got, want):
        if a != b and not all(
            x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9))
            for x, y in zip(a, b)
        ):
            return False, f"{a} vs {b}"
    return (True, f"{len(got)} rows") if got else (False, "empty")
