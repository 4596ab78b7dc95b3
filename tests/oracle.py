"""Compare a query with its SQL in DuckDB: columns by name, rows as a multiset."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    norm = lambda v: bytes(v) if isinstance(v, bytearray) else round(v, 9) if isinstance(v, float) else v
    return sorted(columns), Counter(tuple(norm(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str):
    """None if equal, else a short account."""
    got = _rows(df.columns, df.collect())
    cur = con.execute(sql)
    want = _rows([d[0] for d in cur.description], cur.fetchall())
    if got == want:
        return None
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    return f"{sum(got[1].values())} and {sum(want[1].values())} rows; only here {list((got[1] - want[1]).items())[:3]}; only there {list((want[1] - got[1]).items())[:3]}"
