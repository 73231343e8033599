"""Holds a query against SQL that DuckDB runs over the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        con.sql(f"create view {table} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def rows_of(frame):
    columns = sorted(frame.columns)
    table = frame[columns].astype(object).where(frame[columns].notna(), None)
    return columns, sorted(repr(tuple(plain(v) for v in row)) for row in table.values.tolist())


def assert_equal(got, want):
    (columns, rows), (other_columns, other_rows) = rows_of(got), rows_of(want)
    assert columns == other_columns
    assert len(rows) == len(other_rows)
    assert [x for x in zip(rows, other_rows, strict=True) if x[0] != x[1]][:3] == []
