"""Run registered queries against DuckDB on the same files and compare values.

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import signal
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
LIMIT = 120


def _too_long(*_):
    raise TimeoutError(f"over {LIMIT}s")


TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, Decimal):
        return f"decimal {v}"
    return str(v)


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark, con, fn, check: str, sf_dir: str) -> str | None:
    df = fn(spark, sf_dir)
    mine = normalise(df.columns, [tuple(x) for x in df.collect()])
    cur = con.execute(check)
    theirs = normalise([d[0] for d in cur.description], cur.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} != {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        only = [x for x in mine[1] if x not in set(theirs[1])][:2], [x for x in theirs[1] if x not in set(mine[1])][:2]
        return f"rows {len(mine[1])} != {len(theirs[1])}; e.g. {only}"
    bad = [(a, b) for a, b in zip(*[mine[1], theirs[1]]) if a != b]
    return f"{len(bad)} of {len(mine[1])} rows differ, e.g.\n   spark {bad[0][0]}\n   duck  {bad[0][1]}" if bad else None


def main(argv):
    from plumbline.session import local_session
    import __spark_entry__ as e

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(e.queries())
    spark, con = local_session("compare"), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    signal.signal(signal.SIGALRM, _too_long)
    for name in names:
        fn, check, t = e.queries()[name], e.oracle_sql().get(name), time.time()
        signal.alarm(LIMIT)
        try:
            if check:
                message, size = compare(spark, con, fn, check, sf_dir), ""
            else:
                size, message = f" {len(fn(spark, sf_dir).collect())} rows (no SQL)", None
        except Exception as err:  # noqa: BLE001
            message, size = f"{type(err).__name__}: {str(err)[:700]}", ""
        signal.alarm(0)
        failed += bool(message)
        print(f"{'FAIL' if message else 'ok  '} {name} {time.time() - t:.1f}s{size}" + (f"\n   {message}" if message else ""), flush=True)
    print(f"{len(names) - failed} ok, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
