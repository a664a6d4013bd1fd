"""Every registered query against its SQL twin (or, without one, for sound rows)."""

from __future__ import annotations

import pytest
from compare import compare, connect

import __spark_entry__ as registry

QUERIES = registry.queries()
ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, con, name):
    _rows, problems = compare(QUERIES[name](spark, sf_dir), con, ORACLES[name])
    assert not problems, "\n".join(problems)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    assert frame.columns and len(frame.collect()) > 0


def test_registries_agree():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    frame = registry.entry(spark)
    assert frame.filter("method = 'grouped' AND leaked > 0").count() == 0
