"""Run registered queries and compare them with their SQL twins in DuckDB.

usage: python tools/check.py [--sf DIR] [name or prefix ...]
"""

import argparse
import math
import sys
import time
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from caseledger.session import local_session  # noqa: E402
from catalogue import oracle_sql, queries  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return round(value, 6) + 0.0
    if isinstance(value, (datetime, date)):
        return str(value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark_df, con, sql):
    """None when equal, else what differs."""
    columns, rows = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = con.execute(sql)
    wanted_columns, wanted = table([d[0] for d in cursor.description], cursor.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} / {wanted_columns}", len(rows)
    if rows != wanted:
        gone = [r for r in wanted if r not in set(rows)][:3]
        extra = [r for r in rows if r not in set(wanted)][:3]
        return f"rows {len(rows)}/{len(wanted)}\n   {columns}\n   only sql   {gone}\n   only spark {extra}", len(rows)
    for i, c in enumerate(columns):
        kinds = {type(r[i]) for r in rows if r[i] is not None}
        others = {type(r[i]) for r in wanted if r[i] is not None}
        if kinds != others:
            return f"types of {c}: {kinds} / {others}", len(rows)
    return None, len(rows)


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = local_session("8", 8)
    con = duck(args.sf)
    bad = 0
    oracles = oracle_sql()
    for name, run in queries().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            df = run(spark, args.sf)
            if name in oracles:
                problem, n = compare(df, con, oracles[name])
            else:
                problem, n = None, len(df.collect())
        except Exception as error:  # noqa: BLE001
            problem, n = f"{type(error).__name__}: {str(error)[:900]}", -1
        mark = "ok " if problem is None and n > 0 else ("EMPTY" if problem is None else "BAD")
        bad += mark != "ok "
        oracle = "sql" if name in oracles else "rows"
        print(f"{mark} {name} {oracle} rows={n} {time.time() - start:.1f}s", flush=True)
        if problem:
            print("   ", problem, flush=True)
    print("problems:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
