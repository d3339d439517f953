"""The queries that SQL can express against their SQL."""

import glob
import os

import duckdb
import pytest

from tidegraph.llm.oracles import ORACLES
from tidegraph.llm.queries import QUERIES


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("key", ORACLES)
def test_query_equals_sql(spark, key, sf):
    folder = f"/root/testdata/sf{sf}"
    tables = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        tables.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    found = QUERIES[key](spark, folder)
    columns = sorted(found.columns)
    answer = tables.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[key]})").fetchall()
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(answer)
    assert answer
