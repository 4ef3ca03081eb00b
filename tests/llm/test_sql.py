"""Queries of the training-data operators against their SQL, on the smallest data."""

import pytest

import check
from tidemark.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    ok, note = check.compare(spark, check.connect(FOLDER), name, FOLDER)
    assert ok, note


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
