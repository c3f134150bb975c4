"""Runs a query and its SQL over the same tables and compares them as sets of rows."""

from __future__ import annotations

import datetime
import math
from collections import Counter

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v, digits: int = 9):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.{digits}g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x, digits) for x in v)
    if isinstance(v, (bytearray, bytes)):
        return bytes(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows(columns, data) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in data)


def difference(spark, fn, sql: str, sf_dir: str) -> str:
    """Empty if both give the same columns and rows."""
    df = fn(spark, sf_dir)
    left, a = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duck(sf_dir)
    got = con.execute(sql)
    right, b = rows([d[0] for d in got.description], got.fetchall())
    con.close()
    if left != right:
        return f"columns {left} and {right}"
    if a != b:
        return f"{sum(a.values())} and {sum(b.values())} rows; only here {list((a - b).items())[:3]}; only in SQL {list((b - a).items())[:3]}"
    return ""
