"""Run registered queries in Spark and their oracle SQL in DuckDB, compare.

Mirrors the driver's correctness gate: same column names, same row count,
order-insensitive exact values (decimals, strings, dates exactly; doubles by
repr).  Usage: python check_oracle.py [sf_dir] [query_id ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

from tranche.plans.catalog import QUERIES, Tables
from tranche.session import get_session

VIEWS = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v)
    if isinstance(v, decimal.Decimal):
        return str(v.normalize()) if v == v.to_integral_value() else str(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v) if not isinstance(v, (int, str, bool)) else v


def key(row):
    return tuple((x is None, str(x)) for x in row)


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in VIEWS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, sf_dir: str, qid: str) -> tuple[bool, str, float, float]:
    qq = QUERIES[qid]
    t0 = time.time()
    sdf = qq.spark(Tables(spark, sf_dir))
    s_cols = sdf.columns
    s_rows = sdf.collect()
    ts = time.time() - t0
    if qq.sql is None:
        return True, f"rows-only: {len(s_rows)} rows", ts, 0.0
    t0 = time.time()
    rel = con.sql(qq.sql)
    d_cols = [c for c in rel.columns]
    d_rows = rel.fetchall()
    td = time.time() - t0
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark-only {sorted(set(s_cols) - set(d_cols))} duck-only {sorted(set(d_cols) - set(s_cols))}", ts, td
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    a = sorted((tuple(norm(r[i]) for i in si) for r in s_rows), key=key)
    b = sorted((tuple(norm(r[i]) for i in di) for r in d_rows), key=key)
    if len(a) != len(b):
        return False, f"row count spark={len(a)} duck={len(b)}", ts, td
    for ra, rb in zip(a, b):
        if ra != rb:
            diff = [(order[i], ra[i], rb[i]) for i in range(len(order)) if ra[i] != rb[i]]
            return False, f"value mismatch ({len(a)} rows) e.g. {diff[:4]}", ts, td
    return True, f"{len(a)} rows match", ts, td


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    ids = argv[2:] or list(QUERIES)
    spark = get_session("local[8]")
    con = duck(sf_dir)
    bad = 0
    for qid in ids:
        try:
            ok, msg, ts, td = compare(spark, con, sf_dir, qid)
        except Exception as e:  # report and continue
            ok, msg, ts, td = False, f"ERROR {type(e).__name__}: {str(e)[:300]}", 0, 0
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {qid:34s} spark {ts:6.2f}s duck {td:5.2f}s  {msg}", flush=True)
    print(f"{len(ids) - bad}/{len(ids)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
