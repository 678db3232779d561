"""Compare a registered query with its SQL on the same files."""

from __future__ import annotations

import math

import duckdb

from querybook.inputs import TABLES


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=0, abs_tol=2e-6) or (math.isnan(a) and math.isnan(b))
    return a == b


def sort_key(row):
    return [(v is None, str(type(v).__name__), round(v, 5) if isinstance(v, float) else v) if v is not None else (True, "", 0) for v in row]


def compare(spark_df, con, sql: str) -> str | None:
    """None if equal; else what differs first. Also reports values that differ only in rounding."""
    cols = sorted(spark_df.columns)
    got = sorted((tuple(r[c] for c in cols) for r in spark_df.collect()), key=sort_key)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {names} != {cols}"
    at = [names.index(c) for c in cols]
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=sort_key)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    if not want:
        return "no rows"
    exact = 0
    for g, w in zip(got, want):
        for c, x, y in zip(cols, g, w):
            if not same(x, y):
                return f"column {c}: {x!r} != {y!r} in {dict(zip(cols, g))} / {dict(zip(cols, w))}"
            exact += x != y and not (isinstance(x, float) and math.isnan(x))
            if type(x) is not type(y):
                return f"column {c}: type {type(x)} != {type(y)}"
    return f"rounding differs in {exact} values" if exact else None
