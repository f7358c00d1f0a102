"""Compare registered queries with their SQL on the same tables: ``python -m tests.oracle [name ...]``."""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

import __spark_entry__ as entrypoint

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)):
        return f"{float(x):.6f}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


def _normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str) -> str | None:
    df = entrypoint.queries()[name](spark, sf_dir)
    got = _normal(df.columns, [tuple(r) for r in df.collect()])
    sql = entrypoint.oracle_sql().get(name)
    if sql is None:
        return None if got[1] else "no rows"
    cur = con.execute(sql)
    want = _normal([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return f"rows {len(got[1])} vs {len(want[1])}; only spark {sorted(a - b)[:3]}; only sql {sorted(b - a)[:3]}"
    return None if got[1] else "empty on both sides"


if __name__ == "__main__":
    from tests.conftest import make_session

    directory = "/root/testdata/sf0.01"
    spark, con = make_session(), duck(directory)
    names = sys.argv[1:] or list(entrypoint.queries())
    names = [n for q in names for n in entrypoint.queries() if n == q or (q.endswith("*") and n.startswith(q[:-1]))]
    bad = 0
    for name in names:
        t = time.time()
        try:
            problem = compare(spark, con, name, directory)
        except Exception as exc:  # noqa: BLE001
            problem = f"{type(exc).__name__}: {str(exc)[:400]}"
        kind = "sql" if name in entrypoint.oracle_sql() else "rows"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - t:6.2f}s {name} {problem or ''}", flush=True)
    print("failures:", bad)
