"""Rows of a query and of its SQL in DuckDB, made comparable."""

from __future__ import annotations

import math

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v: object) -> object:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.5g}"
    if isinstance(v, list):
        return [plain(x) for x in v]
    return v


def rows(table: pa.Table) -> list[str]:
    names = sorted(table.column_names)
    return sorted(repr([plain(r[n]) for n in names]) for r in table.select(names).to_pylist())


def kind(t: pa.DataType) -> str:
    if pa.types.is_list(t) or pa.types.is_large_list(t):
        return f"list {kind(t.value_type)}"
    return "string" if pa.types.is_string(t) or pa.types.is_large_string(t) else str(t)


def sql_table(con: duckdb.DuckDBPyConnection, sql: str) -> pa.Table:
    got = con.sql(sql).arrow()
    return got.read_all() if hasattr(got, "read_all") else got


def compare(spark_rows: pa.Table, sql_rows: pa.Table) -> None:
    assert sorted(spark_rows.column_names) == sorted(sql_rows.column_names)
    a, b = rows(spark_rows), rows(sql_rows)
    assert len(a) == len(b)
    assert a == b, (sorted(set(a) - set(b))[:2], sorted(set(b) - set(a))[:2])
    for n in spark_rows.column_names:
        assert kind(spark_rows.schema.field(n).type) == kind(sql_rows.schema.field(n).type), n
