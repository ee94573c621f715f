"""Every SQL-expressible key equals its DuckDB oracle on the small fixture."""

from __future__ import annotations

import pytest

from ledgerloom.plans.registry import oracle_sql, queries
from ledgerloom.plans.verify import compare

from .conftest import SF_SMALL


def test_every_key_has_an_oracle():
    # The sequential jobs (confirm_drafts, apply_adjustments) have one-at-a-time recursive SQL.
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("key", sorted(set(oracle_sql())))
def test_key_matches_oracle(spark, key):
    res = compare(spark, SF_SMALL, [key], verbose=False)[key]
    assert "error" not in res, res
    assert res["match"], res
    assert "type_diff" not in res, res


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["sale_date", "challans", "revenue", "units"]
