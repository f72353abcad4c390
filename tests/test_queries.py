"""The registered queries against their SQL, and the driver's contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tabulore.plans import queries as engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    held = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        held.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return held


def key(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    found = entry.queries()[name](spark, SF)
    columns = sorted(found.columns)
    rel = db.sql(entry.oracle_sql()[name])
    assert columns == sorted(rel.columns)
    want = [tuple(dict(zip(rel.columns, row))[c] for c in columns) for row in rel.fetchall()]
    got = [tuple(row[c] for c in columns) for row in found.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_contract(spark):
    assert entry.entry(spark).count() == 11
    assert set(engine.queries()) == set(engine.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
