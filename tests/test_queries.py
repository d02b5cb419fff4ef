"""Queries of each section against their SQL on the smallest tables."""

from __future__ import annotations

import pytest

import suite.registry as registry
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SLOW = {"validate_docs", "validate_split", "validate_articles"}
FOUND = registry.all_queries()


@pytest.fixture(scope="module")
def tables():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", [n for n in FOUND if n not in SLOW])
def test_query(spark, tables, name):
    query, sql = FOUND[name]
    assert compare(tables, query(spark, SF_DIR), sql) in ("", "EMPTY")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
