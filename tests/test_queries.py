import os

import duckdb
import pytest

from trajkit.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    found = duckdb.connect()
    found.sql("set enable_progress_bar = false")
    for name in os.listdir(SF):
        found.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return found


def plain(value):
    return round(value, 9) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    got, want = registry.QUERIES[name](spark, SF), tables.sql(registry.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall()) and rows
