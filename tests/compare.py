"""Run registered queries beside their SQL: ``python tests/compare.py [folder] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([repr(tuple(_plain(r[i]) for i in order)) for r in rows])


def compare(spark, con, folder: str, name: str, query, sql: str) -> str | None:
    """None when both give the same rows, else what differs."""
    frame = query(spark, folder)
    got_columns = frame.columns
    got = rows_of(got_columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = rows_of(want_columns, cursor.fetchall())
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        missing = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows, expected {len(want)}\n  only here: {extra}\n  only in SQL: {missing}"
    return None if got else "no rows at all"


def main() -> None:
    import __spark_entry__ as entry
    from clausemill.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    spark = local_session(8, checkpoint_dir=tempfile.mkdtemp(prefix="compare-"))
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, sql = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not args or any(n.startswith(a) for a in args)]
    bad = []
    for name in chosen:
        started = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, folder, name, queries[name], sql[name])
                note = "same" if problem is None else problem
            else:
                problem, note = None, f"{queries[name](spark, folder).count()} rows, no SQL"
        except Exception as exc:  # noqa: BLE001
            problem = note = f"{type(exc).__name__}: {str(exc)[:1500]}"
        if problem:
            bad.append(name)
        print(f"{'BAD ' if problem else 'ok  '} {name} {time.time() - started:.1f}s {note}", flush=True)
    print(f"{len(chosen) - len(bad)} of {len(chosen)} good; bad: {bad}")


if __name__ == "__main__":
    main()
