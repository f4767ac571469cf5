"""Every registered query against its SQL on the same tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from corpuscope.plans import ORACLES, QUERIES
from tests.conftest import DATA

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    result = QUERIES[name](spark, DATA)
    cursor = con.execute(ORACLES[name])
    expected_columns = [d[0] for d in cursor.description]
    assert sorted(result.columns) == sorted(expected_columns)
    expected = canonical(expected_columns, cursor.fetchall())
    assert expected
    assert canonical(result.columns, result.collect()) == expected


def test_entry(spark):
    row = contract.entry(spark).first()
    assert row.totalFiles > 0 and row.averageWords > 0
