"""Run every registered query next to its SQL counterpart in DuckDB and compare the rows.

usage: python tools/check_oracle.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from casegrid.plans.registry import all_queries, full_sql, runnable  # noqa: E402
from casegrid.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def canonical(value):
    if isinstance(value, float):
        return "nan" if value != value else repr(round(value, 6) + 0.0)
    if isinstance(value, (list, tuple)):
        return [canonical(v) for v in value]
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([canonical(row[i]) for i in order]) for row in rows)


def kinds(value):
    return {"Decimal": "decimal"}.get(type(value).__name__, type(value).__name__)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(
        "check", master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{args.sf}/{table}.parquet'")
    failed = []
    for name, item in all_queries().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            frame = runnable(item)(spark, args.sf)
            rows = [tuple(r) for r in frame.collect()]
            spent = time.time() - start
            got = rows_of(frame.columns, rows)
        except Exception as error:  # noqa: BLE001
            failed.append(name)
            print(f"SPARK {name}: {str(error)[:1500]}", flush=True)
            continue
        sql = full_sql(item)
        if sql is None:
            print(f"rows  {name}: {len(got)} rows {spent:.1f}s", flush=True)
            continue
        start = time.time()
        try:
            cursor = db.execute(sql)
            columns = [d[0] for d in cursor.description]
            raw = cursor.fetchall()
            want = rows_of(columns, raw)
        except Exception as error:  # noqa: BLE001
            failed.append(name)
            print(f"SQL   {name}: {str(error)[:1500]}", flush=True)
            continue
        note = ""
        if rows and raw:
            mine = {c: kinds(v) for c, v in zip(frame.columns, rows[0]) if v is not None}
            theirs = {c: kinds(v) for c, v in zip(columns, raw[0]) if v is not None}
            odd = {c: (mine[c], theirs[c]) for c in mine if c in theirs and mine[c] != theirs[c]}
            note = f" TYPES {odd}" if odd else ""
        if sorted(frame.columns) != sorted(columns):
            failed.append(name)
            print(f"COLS  {name}: {sorted(frame.columns)} vs {sorted(columns)}", flush=True)
        elif got != want:
            failed.append(name)
            extra = [r for r in got if r not in set(want)][:3]
            lacking = [r for r in want if r not in set(got)][:3]
            print(f"DIFF  {name}: {len(got)} vs {len(want)}\n   spark: {extra}\n   sql:   {lacking}", flush=True)
        else:
            print(f"ok    {name}: {len(got)} rows {spent:.1f}s sql {time.time() - start:.1f}s{note}", flush=True)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
