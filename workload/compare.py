"""Compare registered queries with their SQL: ``python -m workload.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from workload import catalog, oracles
from workload.session import build

TABLES = """region nation customer supplier part orders lineitem events documents embeddings
pages benchmark labels conversations""".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def cell(value):
        if value is None or (isinstance(value, float) and value != value) or value is pd.NA:
            return None
        if isinstance(value, float) and value == int(value) and abs(value) < 1e15:
            return int(value)
        return value.item() if hasattr(value, "item") else value

    names = sorted(frame.columns)
    rows = [tuple(cell(v) for v in row) for row in frame[names].astype(object).itertuples(index=False)]
    return sorted(rows, key=repr)


def differences(left: pd.DataFrame, right: pd.DataFrame) -> str:
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} / {sorted(right.columns)}"
    a, b = canonical(left), canonical(right)
    if a == b:
        return ""
    in_a, in_b = set(a), set(b)
    only_a, only_b = sorted(in_a - in_b, key=repr), sorted(in_b - in_a, key=repr)
    return f"{len(a)} / {len(b)} rows; {len(only_a)}: {only_a[:2]} / {len(only_b)}: {only_b[:2]}"


def main(arguments: list[str]) -> int:
    sf = arguments[0] if arguments else "/root/testdata/sf0.01"
    names = arguments[1:] or list(catalog.QUERIES)
    spark, con, sql, failed = build(), connect(sf), oracles.all_sql(), 0
    for name in names:
        start = time.time()
        try:
            got = catalog.QUERIES[name](spark, sf).toPandas()
            middle = time.time()
            problem = differences(got, con.execute(sql[name]).df()) if name in sql else "no SQL"
        except Exception as error:  # report every query
            middle, problem = time.time(), f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem) and problem != "no SQL"
        spent = f"{middle - start:6.2f}s {time.time() - middle:6.2f}s"
        print(f"{name:24s} {len(got):8d} {spent} {problem[:1500] or 'ok'}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
