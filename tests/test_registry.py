"""Every registered query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as contract
from tidegraph.plans.oracles import ORACLES
from tidegraph.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    yield connection
    connection.close()


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("key", QUERIES)
def test_query_equals_sql(spark, tables, key):
    found = QUERIES[key](spark, SF_DIR)
    columns = sorted(found.columns)
    answer = tables.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[key]})").fetchall()
    assert sorted(map(tuple, found.select(columns).collect()), key=repr) == sorted(answer, key=repr)
    assert answer


def test_entry(spark):
    result = contract.entry(spark)
    assert result.columns == ["id", "arrival"]
    assert result.count() > 0
