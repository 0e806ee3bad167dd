"""Every registered query against its SQL counterpart on whole tables of a small scale."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as contract

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)
OPTIONAL = re.compile(r"op\d+_|pipeline$")  # tested in their own folder
QUERIES = {k: v for k, v in contract.queries().items() if not OPTIONAL.match(k)}
ORACLES = {k: v for k, v in contract.oracle_sql().items() if not OPTIONAL.match(k)}
SQL_TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def sql(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return "~" if v is None else str(v)


def test_every_oracle_has_a_query():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, sql, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    rel = sql.sql(ORACLES[name])
    order = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert columns == sorted(rel.columns)
    types = dict(zip(rel.columns, map(str, rel.types)))
    assert {c: SQL_TYPES[t] for c, t in df.dtypes} == types
    assert got == sorted(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
