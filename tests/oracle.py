"""Runs registered queries next to their SQL checks and compares whole results.

    python tests/oracle.py /root/testdata/sf0.01 [key ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return "~null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 6) + 0.0)
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 2 ** 53 else str(value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, key, build, sql):
    """(ok, message, seconds)"""
    start = time.time()
    df = build(spark, folder)
    columns, rows = df.columns, [tuple(r) for r in df.collect()]
    seconds = time.time() - start
    if sql is None:
        return True, f"rows only: {len(rows)}", seconds
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    if sorted(columns) != sorted(names):
        return False, f"columns {sorted(columns)} <> {sorted(names)}", seconds
    ours, theirs = rows_of(columns, rows), rows_of(names, expected)
    if ours != theirs:
        only_us = sorted(set(ours) - set(theirs))[:3]
        only_them = sorted(set(theirs) - set(ours))[:3]
        return False, f"{len(ours)} vs {len(theirs)} rows; ours {only_us}; theirs {only_them}", seconds
    return True, f"{len(ours)} rows", seconds


def main(folder: str, *keys: str) -> int:
    import __spark_entry__ as entry

    from veilwork.session import build_session

    spark = build_session("veilwork-oracle", 8)
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for key in keys or queries:
        try:
            ok, message, seconds = compare(spark, con, folder, key, queries[key], oracles.get(key))
        except Exception as error:  # report and go on
            ok, message, seconds = False, f"{type(error).__name__}: {str(error)[:1500]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {key:28s} {seconds:6.2f}s  {message[:1800]}", flush=True)
    print(f"{bad} failed of {len(keys or queries)}")
    return bad


if __name__ == "__main__":
    sys.exit(min(1, main(*sys.argv[1:])))
