"""Run registered queries on both engines and compare rows as multisets.

    python -m tests.compare [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import time
from collections import Counter
from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata")


def duck(folder: Path) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in sorted(folder.glob("*.parquet")):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _value(v):
    if isinstance(v, float):
        return float(f"{v:.6g}") + 0.0
    if isinstance(v, list):
        return tuple(_value(x) for x in v)
    return v


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_value(row[i]) for i in order) for row in rows)


def compare(spark, connection, folder: Path, build, sql: str | None) -> tuple[bool, str]:
    df = build(spark, str(folder))
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return True, f"{sum(got.values())} rows, no SQL"
    cursor = connection.execute(sql)
    columns = [d[0] for d in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns differ: only spark {set(df.columns) - set(columns)}, only sql {set(columns) - set(df.columns)}"
    if got != want:
        extra, missing = list((got - want))[:2], list((want - got))[:2]
        return False, f"{sum(got.values())} vs {sum(want.values())} rows\n  {sorted(columns)}\n  spark {extra}\n  sql   {missing}"
    return True, f"{sum(got.values())} rows"


def main() -> None:
    import __spark_entry__ as entry
    from delaymill.session import build_session, scratch_cleared

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    options = parser.parse_args()
    spark = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    spark.sparkContext.setLogLevel("ERROR")
    folder = TESTDATA / f"sf{options.sf}"
    connection = duck(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = []
    for name in options.names or queries:
        began = time.time()
        try:
            with scratch_cleared(spark):
                ok, note = compare(spark, connection, folder, queries[name], sqls.get(name))
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - began:.1f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main()
