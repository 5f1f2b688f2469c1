"""Run queries beside their SQL and compare: ``python -m checks.compare [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from checks.oracle import oracle_sql
from checks.queries import queries
from cuematch.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return repr(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    t0 = time.time()
    df = queries()[name](spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    sql = oracle_sql().get(name)
    if sql is None:
        return True, f"no sql, {len(got)} rows, {t1 - t0:.1f}s"
    cur = con.execute(sql)
    want_columns, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    note = f"{len(got)} rows, spark {t1 - t0:.1f}s sql {time.time() - t1:.1f}s"
    if got_columns != want_columns:
        return False, f"columns {got_columns} / {want_columns}"
    if got != want:
        a, b = set(got), set(want)
        return False, (f"{len(got)} / {len(want)} rows; only spark {len(a - b)}: {sorted(a - b)[:2]}; "
                       f"only sql {len(b - a)}: {sorted(b - a)[:2]}")
    return True, note


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(queries())
    spark, con = local_session(), connect(sf_dir)
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, note, flush=True)
    missing = sorted(set(queries()) ^ set(oracle_sql()))
    print(f"{len(names) - bad} of {len(names)} ok; without a partner: {missing}")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
