"""Every registered query against its SQL, or against non-emptiness where it has none."""

from __future__ import annotations

import pytest
from check_oracle import compare, connect
from conftest import SMALL

import __spark_entry__ as entry
from lakeloom import suite

QUERIES, ORACLES = suite.all_queries(), suite.all_oracles()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, text = compare(spark, con, SMALL, name, QUERIES[name], ORACLES.get(name))
    assert ok, text


def test_entry_points(spark):
    assert set(ORACLES) <= set(QUERIES)
    assert entry.entry(spark).count() == 1500


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
