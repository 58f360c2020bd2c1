"""Run a registered query and its SQL counterpart and compare names, types and rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)

DUCK_TO_SPARK = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date",
    "BOOLEAN": "boolean",
}


def connect(data_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{data_dir}/{table}.parquet')")
    return connection


def _sorted(rows, names, order):
    picked = [tuple(row[names.index(name)] for name in order) for row in rows]
    return sorted(picked, key=lambda row: tuple((value is not None, str(value)) for value in row))


def _equal(left, right) -> bool:
    if isinstance(left, float) and isinstance(right, float):
        return left == right or (math.isnan(left) and math.isnan(right))
    return left == right


def differences(frame, connection, sql: str) -> list[str]:
    relation = connection.sql(sql)
    order = sorted(frame.columns)
    if order != sorted(relation.columns):
        return [f"columns {order} against {sorted(relation.columns)}"]
    found = []
    duck_types = {name: DUCK_TO_SPARK.get(str(kind), str(kind)) for name, kind in zip(relation.columns, relation.types)}
    for name, kind in frame.dtypes:
        if duck_types[name] != kind:
            found.append(f"{name}: {kind} against {duck_types[name]}")
    ours = _sorted([tuple(row) for row in frame.collect()], frame.columns, order)
    theirs = _sorted(relation.fetchall(), relation.columns, order)
    if len(ours) != len(theirs):
        found.append(f"{len(ours)} rows against {len(theirs)}")
    for left, right in zip(ours, theirs):
        if not all(_equal(a, b) for a, b in zip(left, right)):
            found.append(f"{dict(zip(order, left))} against {dict(zip(order, right))}")
            break
    return found
