"""Run queries against their SQL in DuckDB: python -m tests.oracle [sf] [name...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def connect(d: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(d).glob("*.parquet")):
        target = f"{p}/*.parquet" if p.is_dir() else p
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{target}')")
    return con


def canonical(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return float(value)
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canonical(r[i]) for i in order) for r in rows), key=str)


def compare(spark, con, name: str, fn, sql: str, d: str) -> str:
    df = fn(spark, d)
    got = rows_of(df.columns, df.collect())
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} and {b}"
    return "" if got else "no rows"


def main() -> int:
    import __spark_entry__ as entry
    from evalloom.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    names = sys.argv[2:]
    spark = local_session(cpus=4)
    con, d, bad = connect(f"{DATA}/{sf}"), f"{DATA}/{sf}", 0
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in names or oracle:
        began = time.time()
        try:
            said = compare(spark, con, name, queries[name], oracle[name], d)
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:300]}"
        bad += bool(said)
        if said:
            print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
    print(f"{len(names or oracle)} compared, {bad} differ")
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
