"""Runs catalogue queries next to their SQL twins and compares the results.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v if isinstance(v, str) or v is None else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    body = sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows),
        key=lambda r: tuple((x is not None, str(x)) for x in r),
    )
    return names, body


def compare(frame, con, sql) -> str | None:
    """None when equal, else a description of the first difference."""
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"{dict(zip(got[0], a))} != {dict(zip(got[0], b))}"
    return None


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry
    from voxmetric.session import build_session

    spark = build_session(
        master="local[8]",
        extra={
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(args.sf), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            if name in sqls:
                problem = compare(run(spark, args.sf), con, sqls[name])
            else:
                problem = None
                print(f"      {name}: {run(spark, args.sf).count()} rows, no SQL")
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
            if "-v" in sys.argv:
                traceback.print_exc()
        took = time.time() - start
        if problem:
            bad += 1
        print(f"{'FAIL' if problem else 'ok  '}  {name}  {took:.1f}s  {problem or ''}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
