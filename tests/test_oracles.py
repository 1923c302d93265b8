"""Every query of the bar library against its SQL."""

from __future__ import annotations

import pytest

from barlab.plans import ORACLES, QUERIES

from .conftest import rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, oracle, name):
    got = QUERIES[name](spark, SF)
    want = oracle(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


def test_entry_and_registries(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["symbol", "session", "side", "signals", "win_rate"]
