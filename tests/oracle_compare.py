"""Compares queries with their SQL in DuckDB, row for row."""

import glob
import os
from collections import Counter

import duckdb

FOLDER = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


def connect():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return tuple(map(plain, v)) if isinstance(v, list | tuple) else v


def rows(table):
    names = sorted(table.column_names)
    return names, [str(table.schema.field(n).type).replace("large_", "") for n in names], Counter(zip(*[map(plain, table.column(n).to_pylist()) for n in names], strict=True))


def compare(spark, con, query, sql):
    got, want = rows(query(spark, FOLDER).toArrow()), rows(con.sql(sql).to_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[2] == want[2]
