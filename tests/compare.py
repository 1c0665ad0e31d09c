"""Compare Spark results with DuckDB: names, row count, types and order-insensitive values."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v + 0.0
    return v


def rows(columns, data) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in data)


def compare(df, con, sql: str) -> list[str]:
    """Differences between a DataFrame and a statement, as text; empty if equal."""
    cur = con.execute(sql)
    sql_cols = [d[0] for d in cur.description]
    sql_types = {d[0]: str(d[1]) for d in cur.description}
    sql_rows = cur.fetchall()
    out = []
    if sorted(df.columns) != sorted(sql_cols):
        return [f"columns {sorted(df.columns)} <> {sorted(sql_cols)}"]
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP"}
    for name, kind in df.dtypes:
        if same.get(kind) != sql_types[name]:
            out.append(f"type {name}: {kind} <> {sql_types[name]}")
    a, b = rows(df.columns, [tuple(r) for r in df.collect()]), rows(sql_cols, sql_rows)
    if a != b:
        out.append(f"rows {sum(a.values())} <> {sum(b.values())}; only spark {list((a - b).items())[:3]}; only sql {list((b - a).items())[:3]}; differing {sum((a - b).values())}")
    return out
