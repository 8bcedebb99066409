"""Run queries and their SQL side by side: ``python -m tests.oracle [--sf 0.01] [name ...]``."""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _kind(value) -> str:
    return type(value).__name__


def normalise(columns: list[str], rows: list) -> tuple[list[str], list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(cells, key=repr)


def compare(frame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    found = normalise(frame.columns, [tuple(r) for r in frame.collect()])
    cursor = connection.execute(sql)
    expected = normalise([d[0] for d in cursor.description], cursor.fetchall())
    if found[0] != expected[0]:
        return f"columns {found[0]} != {expected[0]}"
    if len(found[1]) != len(expected[1]):
        return f"rows {len(found[1])} != {len(expected[1])}"
    differing = [(a, b) for a, b in zip(found[1], expected[1], strict=True) if a != b]
    if differing:
        return f"{len(differing)} rows differ, first: {differing[0][0]} != {differing[0][1]}"
    for i, name in enumerate(found[0]):
        kinds = [
            {_kind(row[i]) for row in side[1] if row[i] is not None and row[i] != "nan"}
            for side in (found, expected)
        ]
        if kinds[0] != kinds[1]:
            return f"column {name}: types {kinds[0]} != {kinds[1]}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from plumbline.session import local_session

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--chars", type=int, default=400)
    parser.add_argument("names", nargs="*")
    arguments = parser.parse_args()
    sf_dir = f"/root/testdata/sf{arguments.sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    sqls = oracle_sql()
    bad = 0
    for name, query in queries().items():
        if arguments.names and name not in arguments.names:
            continue
        start = time.time()
        try:
            frame = query(spark, sf_dir)
            if name in sqls:
                problem = compare(frame, connection, sqls[name])
                n = frame.count() if problem else ""
            else:
                n, problem = len(frame.collect()), None
            state = "ok" if problem is None else f"DIFFERS {problem}"
            if name not in sqls:
                state += f" rows only ({n})"
        except Exception as error:  # noqa: BLE001
            state = f"FAILED {type(error).__name__}: {str(error)[:arguments.chars]}"
        bad += not state.startswith("ok")
        print(f"{name:28s} {time.time() - start:6.2f}s {state}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
