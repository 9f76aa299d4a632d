"""Compare registered queries with their SQL on one data folder."""

from __future__ import annotations

import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _clean(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cleaned = [tuple(_clean(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(cleaned, key=_key)


def compare(spark, con, folder, run, sql) -> tuple[str, int, float]:
    """Empty text when equal, else what differs; the row count; Spark's seconds."""
    started = time.time()
    df = run(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - started
    if sql is None:
        return "", len(got[1]), seconds
    result = con.execute(sql)
    want = rows_of([d[0] for d in result.description], result.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}", len(got[1]), seconds
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}", len(got[1]), seconds
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"{a} != {b}", len(got[1]), seconds
    return "", len(got[1]), seconds
