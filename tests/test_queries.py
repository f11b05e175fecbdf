"""Every registered query against its SQL, on the small test tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, SF_DIR)
    got = [tuple(r) for r in df.collect()]
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql.replace("/root/testdata/sf0.01/", f"{SF_DIR}/"))
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert comparable(got, df.columns) == comparable(cursor.fetchall(), columns)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
