"""Every query that has SQL, against DuckDB on the smallest tables."""

import decimal
import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "labels", "conversations")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")
CORE = sorted(set(__spark_entry__.core.QUERIES) & set(__spark_entry__.core.SQL))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.fixture(scope="module", autouse=True)
def interpreted(spark):
    """On tables this small, generating code takes longer than all else."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    yield
    spark.conf.unset("spark.sql.codegen.wholeStage")


def plain(value):
    return round(float(value), 9) if isinstance(value, float | decimal.Decimal) else value


@pytest.mark.parametrize("name", CORE)
def test_query_equals_its_sql(spark, duck, name):
    found = __spark_entry__.core.QUERIES[name](spark, SF)
    asked = duck.execute(__spark_entry__.core.SQL[name])
    columns = sorted(found.columns)
    names = [d[0] for d in asked.description]
    assert sorted(names) == columns
    expected = [tuple(plain(row[names.index(c)]) for c in columns) for row in asked.fetchall()]
    assert sorted((tuple(plain(row[c]) for c in columns) for row in found.collect()), key=repr) == sorted(expected, key=repr)
