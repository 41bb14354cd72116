"""Compare registered queries with their SQL on DuckDB: columns, row count and every value."""

from __future__ import annotations

import datetime as dt
import sys
import time

import duckdb

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]


def _plain(value: object) -> str:
    if isinstance(value, float):
        return format(value, ".9g")
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def _rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def difference(spark, connection, folder: str, run, sql: str) -> str | None:
    """None when Spark and SQL agree, else what differs."""
    frame = run(spark, folder)
    got = _rows(frame.columns, frame.collect())
    answer = connection.execute(sql)
    names = [d[0] for d in answer.description]
    want = _rows(names, answer.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    if len(got) != len(want):
        extra = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return f"rows {len(got)} != {len(want)}; spark only / sql only {extra}"
    for mine, theirs in zip(got, want):
        if mine != theirs:
            return f"first difference\n   {mine}\n   {theirs}"
    return None


def main(folder: str, wanted: list[str]) -> int:
    from srcgraph import catalog
    from srcgraph.session import local_session

    catalog.load()
    spark, connection = local_session(), connect(folder)
    bad = 0
    for name, run in catalog.QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            if name in catalog.ORACLES:
                problem = difference(spark, connection, folder, run, catalog.ORACLES[name])
            else:
                problem = None if run(spark, folder).count() else "no rows"
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"@@ {'FAIL' if problem else 'ok  '} {name} {time.time() - started:.1f}s {problem or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    sys.exit(main(sys.argv[1], sys.argv[2:]))
