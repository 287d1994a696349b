import glob
import json
import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from compare import rows_of  # noqa: E402
from freeze import digest  # noqa: E402

from gleanline.plans import registry  # noqa: E402


@pytest.fixture(scope="module")
def con(small):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, small, con, name):
    got, want = entry.queries()[name](spark, small).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


FROZEN = json.load(open(os.path.join(os.path.dirname(os.path.abspath(__file__)), "frozen.json")))


def test_every_core_query_is_checked():
    assert set(registry.QUERIES) - set(registry.ORACLES) == set(FROZEN)


@pytest.mark.parametrize("name", sorted(FROZEN))
def test_query_without_sql_keeps_its_rows(spark, small, name):
    frame = registry.QUERIES[name](spark, small)
    assert digest(frame) == FROZEN[name] and len(set(frame.columns)) == len(frame.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
