"""Run a report in Spark and its oracle SQL in DuckDB and compare the results.

Comparison as the driver does it: column names sorted, row count, and the
multiset of rows (order-insensitive). Doubles must be equal exactly, since
both sides round in exact decimal arithmetic before converting.
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

FIXTURE_VIEWS = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in FIXTURE_VIEWS:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if isinstance(v, dt.datetime):
        return v.date().isoformat() if v.time() == dt.time() else v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, key: str, sf_dir: str, spark_df=None):
    """Return (ok, message) for one report key."""
    import __spark_entry__ as entry

    sdf = spark_df if spark_df is not None else entry.queries()[key](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = _rows(s_cols, [tuple(r) for r in sdf.collect()])
    res = con.execute(entry.oracle_sql()[key])
    o_cols = [d[0] for d in res.description]
    o_rows = _rows(o_cols, res.fetchall())
    if sorted(s_cols) != sorted(o_cols):
        return False, f"columns differ: spark={sorted(s_cols)} oracle={sorted(o_cols)}"
    if len(s_rows) != len(o_rows):
        return False, f"row count differs: spark={len(s_rows)} oracle={len(o_rows)}"
    bad = [(a, b) for a, b in zip(s_rows, o_rows) if a != b]
    if bad:
        return False, f"{len(bad)} rows differ, e.g. spark={bad[0][0]} oracle={bad[0][1]}"
    return True, f"{len(s_rows)} rows match"
