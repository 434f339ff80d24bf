"""Comparison of a Spark result with the SQL oracle: same columns, kinds, row count and values."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES.split():
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def table_rows(table, columns):
    data = [table.column(c).to_pylist() for c in columns]
    return sorted((tuple(normal(v) for v in row) for row in zip(*data)), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None if equal, else what differs."""
    got = spark_df.toArrow()
    want = con.execute(sql).to_arrow_table()
    columns = sorted(got.column_names)
    if columns != sorted(want.column_names):
        return f"columns {columns} / {sorted(want.column_names)}"
    kinds = [(c, str(got.schema.field(c).type), str(want.schema.field(c).type)) for c in columns]
    differing = [k for k in kinds if k[1].removeprefix("large_") != k[2].removeprefix("large_")]
    if differing:
        return f"types {differing}"
    if got.num_rows != want.num_rows:
        return f"rows {got.num_rows} / {want.num_rows}"
    a, b = table_rows(got, columns), table_rows(want, columns)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{columns} {len(wrong)} values differ, first {wrong[0]}" if wrong else None
