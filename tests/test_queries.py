"""Every registered query against its SQL on the smallest data."""

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, rows_of
from pathweave.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SEEDED = {"partition_edge_local", "partition_edge_random", "partition_boundary_local", "partition_boundary_random", "partition_trace"}


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES.split():
        connection.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return connection


def test_every_query_has_sql_but_the_seeded_ones():
    assert set(QUERIES) - set(oracle_sql()) == SEEDED
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = queries()[name](spark, FOLDER)
    found = db.execute(oracle_sql()[name])
    want = rows_of([c[0] for c in found.description], found.fetchall())
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want


def test_entry(spark):
    assert entry(spark).count() == 71
