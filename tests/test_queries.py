"""Every registered query against its SQL, on the smallest data."""

import pytest

import __spark_entry__ as entry
import check
from workload.registry import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check.connect(FOLDER)


# approximate or drawn results: compared with exact or plain ones in their own tests
WITHOUT_SQL = {"a3_sketch_users", "e13_kmeans_groups", "e14_hierarchical_labels"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, name):
    ok, note = check.compare(spark, duck, name, FOLDER)
    assert ok, note


def test_entry_runs(spark):
    assert entry.entry(spark).columns[:4] == ["country", "service", "trxn_group", "trxn_type"]


def test_every_other_query_has_sql():
    assert set(QUERIES) == set(ORACLE) | WITHOUT_SQL and not set(ORACLE) & WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_query_without_sql_has_rows(spark, name):
    assert not QUERIES[name](spark, FOLDER).isEmpty()
