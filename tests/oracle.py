"""Run registered queries against DuckDB on the same Parquet files.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
SIMPLE = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
          "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "DATE": "date", "HUGEINT": "hugeint"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, f"{value:+025.9f}") if math.isfinite(value) else (2, str(value))
    if isinstance(value, dt.datetime):
        return (1, value.replace(tzinfo=None).isoformat())
    return (1, str(value))


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: [_key(v) for v in r])


def difference(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None when both engines agree exactly (names, types, rows), else a short description."""
    df = fn(spark, sf_dir)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: SIMPLE.get(str(d[1]), str(d[1])) for d in result.description}
    theirs = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    types = dict(df.dtypes)
    wrong = {c: (types[c], kinds[c]) for c in names if types[c] != kinds[c]}
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs)
           if [_key(x) for x in a] != [_key(x) for x in b]]
    if bad:
        return f"{len(bad)} of {len(ours)} rows differ, e.g.\n   {bad[0][0]}\n   {bad[0][1]}"
    return f"types {wrong}" if wrong else None


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from riskweave.session import get_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    only_sql = "--sql" in argv
    wanted = [a for a in argv[1:] if a != "--sql"]
    spark = get_session("oracle", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = oracle_sql()
    failed = 0
    for name, fn in queries().items():
        if only_sql and name not in sql:
            continue
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1]))
                              for w in wanted):
            continue
        start = time.perf_counter()
        try:
            if name in sql:
                gap = difference(spark, con, sf_dir, fn, sql[name])
            else:
                df = fn(spark, sf_dir)
                gap = None if df.count() else "no rows"
                name += " (rows only)"
        except Exception as error:  # noqa: BLE001
            gap = f"{type(error).__name__}: {str(error)[:600]}"
        failed += gap is not None
        print(f"{'ok  ' if gap is None else 'FAIL'} {time.perf_counter() - start:6.2f}s {name}"
              + (f": {gap}" if gap else ""), flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
