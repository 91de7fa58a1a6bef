"""Run catalogue queries beside their DuckDB checks.

    python tools/check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((repr([_cell(r[i]) for i in order]) for r in rows))


def kinds(columns, rows):
    out = {}
    for i, c in enumerate(columns):
        out[c] = {type(r[i]).__name__ for r in rows if r[i] is not None}
    return out


def compare(spark, con, sf: str, name: str, fn, sql: str | None) -> tuple[bool, str]:
    start = time.time()
    df = fn(spark, sf)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if sql is None:
        return bool(got), f"{len(got)} rows, no check, {took:.2f}s"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = canonical(df.columns, got), canonical(columns, want)
    if a != b:
        extra = [x for x in a if x not in set(b)][:2]
        lacking = [x for x in b if x not in set(a)][:2]
        return False, f"{len(a)} rows vs {len(b)}\n   spark: {extra}\n   check: {lacking}"
    if kinds(df.columns, got) != kinds(columns, want):
        return False, f"types {kinds(df.columns, got)} != {kinds(columns, want)}"
    return bool(a), f"{len(a)} rows, {took:.2f}s"


def main(argv: list[str]) -> int:
    from sheafline.plans.catalog import CHECKS, QUERIES
    from sheafline.session import build_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = build_session(
        master="local[8]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="8",
        spark__sheafline__scanTasks="8",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle(sf)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, sf, name, QUERIES[name], CHECKS.get(name))
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + note, flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
