"""Compare every query with its SQL: `python -m tests.oracle [directory] [name ...]`."""

from __future__ import annotations

import pathlib
import sys
import time
import traceback

import duckdb

import __spark_entry__ as entry
from tracewright import get_spark


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(pathlib.Path(directory).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(value):
        return round(value, 9) if isinstance(value, float) else value

    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, name: str, directory: str) -> str:
    """Empty if both give the same columns and rows."""
    frame = entry.queries()[name](spark, directory)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    want = rows(columns, cursor.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} instead of {sorted(columns)}"
    if repr(got) != repr(want):
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 20000 else "..."
        missing = [r for r in want if r not in set(got)][:2] if len(want) < 20000 else "..."
        return f"{len(got)} rows instead of {len(want)}; extra {extra}; missing {missing}"
    return ""


if __name__ == "__main__":
    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = get_spark(master="local[8]", spark__ui__enabled="false", spark__driver__memory="8g",
                        spark__sql__shuffle__partitions="8")
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(directory)
    for query in sys.argv[2:] or list(entry.oracle_sql()):
        began = time.time()
        try:
            problem = compare(session, connection, query, directory)
        except Exception:
            problem = traceback.format_exc()[-1500:]
        print(f"{'ok  ' if not problem else 'FAIL'} {query} {time.time() - began:.1f}s {problem}", flush=True)
