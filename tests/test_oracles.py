"""Every core query against its DuckDB twin, and every other core query for rows and schema."""

from __future__ import annotations

import pytest

from tarnmill.plans import registry
from tests import oracle

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, sf_dir, name):
    oracle.check(spark, sf_dir, QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, sf_dir, name):
    out = QUERIES[name](spark, sf_dir)
    assert out.columns and out.count() > 0
