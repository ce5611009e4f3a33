"""Every registered query against its SQL on a second engine."""

from __future__ import annotations

import re

import pytest
from compare import connect, differences

import __spark_entry__ as contract
from markspan.plans.catalog import spark_queries, sql_queries

QUERIES, SQL = spark_queries(), sql_queries()


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, folder, name):
    assert name in SQL
    assert differences(QUERIES[name](spark, folder), con, SQL[name]) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["candidate_id", "submission_id", "key_id", "match_kind", "correct", "total", "percentage"]
    assert df.count() > 0


def test_every_listed_operator_has_a_query():
    listed = {
        "s": range(1, 9), "p": range(1, 17), "j": range(1, 12), "a": range(1, 21), "w": range(1, 12), "t": range(1, 6),
        "u": range(1, 7), "f": range(1, 31), "x": range(1, 5), "r": range(1, 6),
    }
    have = {re.match(r"[a-z]\d+", n).group(0) for n in QUERIES}
    missing = [f"{k}{n}" for k, ns in listed.items() for n in ns if f"{k}{n}" not in have]
    assert missing == []
