"""Every registered query of the analytics catalogue against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from sedimenta.plans.catalogue import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp"}

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    return round(value, 5) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df, expected = QUERIES[name](spark, SF), duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    types = dict(zip(expected.columns, map(str, expected.types), strict=True))
    assert {c: t for c, t in df.dtypes} == {c: TYPES[t] for c, t in types.items()}
    at = [expected.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in expected.fetchall()), key=repr)
    ours = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_run(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.columns
    df.count()
