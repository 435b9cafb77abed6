"""Run registered queries against their SQL in DuckDB: check_catalog.py [sf] [name ...]."""

import importlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from medloom.catalog.registry import ORACLES, QUERIES  # noqa: E402
from medloom.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def rows(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in records), key=repr)


def compare(spark, con, folder, name):
    df = QUERIES[name](spark, folder)
    t0 = time.time()
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if name not in ORACLES:
        return f"rows only {len(got)}", t1 - t0, 0.0
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    t2 = time.time()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {df.columns} {names}", t1 - t0, t2 - t1
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return (
            f"DIFFER spark {len(got)} sql {len(want)}\n   only spark {list(a)[:3]}\n   only sql {list(b)[:3]}",
            t1 - t0, t2 - t1,
        )
    return f"ok {len(got)}", t1 - t0, t2 - t1


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    for module in os.environ.get("MODULES", "").split():
        importlib.import_module(f"medloom.catalog.{module}")
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session("8"), oracle(folder)
    for name in args[1:] or list(QUERIES):
        try:
            verdict, a, b = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001
            verdict, a, b = f"ERROR {type(error).__name__} {str(error)[:1500]}", 0, 0
        print(f"{name:28s} {a:6.1f}s {b:6.1f}s  {verdict}", flush=True)
