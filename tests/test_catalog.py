"""A selection of the registered queries beside their SQL twins at the smallest scale."""
import duckdb
import pytest

import __spark_entry__ as entry
import check

SF_DIR = "/root/testdata/sf0.001"
SELECTED = ["clean_text", "dedup_signature", "build_windows", "keyword_shift", "scenario_metrics", "gaussian_stats", "split_reference", "inject_drift", "to_flat"]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in check.TABLES:
        connection.sql(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return connection


def test_registry():
    queries, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(queries) and len(queries) > 100
    assert set(SELECTED) <= set(twins)


@pytest.mark.parametrize("name", SELECTED)
def test_query_equals_its_twin(spark, db, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    assert check.differences(got, db.sql(entry.oracle_sql()[name]).df()) == ""
