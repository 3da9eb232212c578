"""Every registered core query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from plumbline.plans import queries
from plumbline.session import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    relation = duck.sql(queries.ORACLE[name])
    theirs = list(relation.columns)
    assert sorted(theirs) == columns
    types = dict(zip(theirs, map(str, relation.types), strict=True))
    assert {c: KINDS[t] for c, t in df.dtypes} == types
    expected = [tuple(plain(r[theirs.index(c)]) for c in columns) for r in relation.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["total_items", "redundant_clusters", "redundant_items", "duplication_ratio"]
