"""Run queries against their SQL: ``python tests/compare.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        v = v.item()
    if hasattr(v, "is_finite") or isinstance(v, float):  # decimals and floats
        return round(float(v), 9) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, function, sql):
    """(same, rows, detail)"""
    df = function(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got[1]), ""
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return False, len(got[1]), f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return False, len(got[1]), f"{len(want[1])} rows in SQL; only Spark {list(a - b)[:3]}; only SQL {list(b - a)[:3]}"
    return True, len(got[1]), ""


def main(argv):
    from conftest import session
    import __spark_entry__ as entry

    folder = f"/root/testdata/sf{argv[0] if argv else '0.01'}"
    spark, con = session(), duck(folder)
    bad = 0
    for name, function in entry.queries().items():
        if argv[1:] and not any(name.startswith(a) for a in argv[1:]):
            continue
        start = time.time()
        try:
            same, n, detail = compare(spark, con, folder, name, function, entry.oracle_sql().get(name))
        except Exception as e:  # noqa: BLE001
            same, n, detail = False, 0, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += same is False
        print(f"{'ok' if same else 'rows' if same is None else 'BAD'} {name} {n} {time.time() - start:.1f}s {detail}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main(sys.argv[1:])
