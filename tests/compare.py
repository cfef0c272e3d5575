"""Run registered queries in Spark and in DuckDB and compare every value.

Usage: python -m tests.compare [scale folder] [name pattern ...]
"""

from __future__ import annotations

import fnmatch
import math
import sys
import time
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs first."""
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, {got_cols}: {bad[0][0]} != {bad[0][1]}"
    return None if got else "EMPTY"


def main(argv: list[str]) -> int:
    from busward.catalog import QUERIES
    from busward.session import local_session

    scale = argv[0] if argv else "sf0.01"
    patterns = argv[1:] or ["*"]
    folder = str(DATA / scale)
    spark = local_session()
    failed = 0
    for name, q in QUERIES.items():
        if not any(fnmatch.fnmatch(name, p) for p in patterns):
            continue
        start = time.time()
        try:
            df = q.run(spark, folder)
            if q.body is None:
                note = f"rows {df.count()}"
                problem = None
            else:
                problem = difference(df, duck(folder), q.sql())
                note = "ok"
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem, note = f"{type(error).__name__}: {str(error)[:1500]}", ""
        failed += problem is not None and problem != "EMPTY"
        print(f"{name:40s} {time.time() - start:6.2f}s {problem or note}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
