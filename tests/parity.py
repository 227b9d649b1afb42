"""Spark query against DuckDB SQL over the same tables: columns, rows and values."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def cell(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return "nan" if math.isnan(x) else round(float(x), 6) + 0.0
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return tuple(cell(v) for v in x)
    return x


def compare(df, sql: str, sf: str) -> str | None:
    """None if both agree, else what differs."""
    con = duckdb.connect()
    con.execute("SET threads = 2")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    a = Counter(tuple(cell(r[c]) for c in order) for r in df.collect())
    at = [names.index(c) for c in order]
    b = Counter(tuple(cell(r[i]) for i in at) for r in want)
    if a == b:
        return None
    return f"{sum(a.values())} rows against {sum(b.values())}; only in Spark {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"
