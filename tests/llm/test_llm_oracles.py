"""The operators' queries against their SQL."""

from __future__ import annotations

import pytest

from barlab.llm.queries import ORACLES, QUERIES

from ..conftest import rows_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, oracle, name):
    got, want = QUERIES[name](spark, SF), oracle(ORACLES[name])
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())
