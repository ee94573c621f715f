"""Numbers across batches, and the sales reports in one pass."""

from __future__ import annotations

import pytest

from ledgerloom.config import AS_OF
from ledgerloom.operators import sales
from ledgerloom.plans.report import plan_text
from ledgerloom.sources.counter import Counter, number_batch
from ledgerloom.sources.fixtures import Fixture

from .conftest import SF_SMALL

SCHEMA = "id long, created_at timestamp_ntz"


def test_no_gap_and_no_number_twice(spark, scratch):
    counter = Counter(f"{scratch}/counter")
    counter.start(spark, 41)
    batches = [spark.range(10 * b, 10 * b + n).selectExpr("id", "timestamp_ntz'2001-01-01' - make_dt_interval(id % 3) AS created_at") for b, n in ((0, 7), (1, 0), (2, 5))]
    first = [number_batch(counter, b, rows).collect() for b, rows in enumerate(batches)]
    again = [number_batch(counter, b, rows).collect() for b, rows in reversed(list(enumerate(batches)))]
    assert [sorted(r) for r in reversed(again)] == [sorted(r) for r in first]
    assert sorted(r.sequence for rows in first for r in rows) == list(range(42, 54))
    assert [r.sequence for r in sorted(first[2], key=lambda r: (r.created_at, r.id))] == list(range(49, 54))
    with pytest.raises(ValueError):
        number_batch(counter, 0, batches[2])


def test_overview_reads_the_lines_once_and_equals_the_reports(spark):
    fx = Fixture(spark, SF_SMALL)
    out = sales.sales_overview(fx.challans(), fx.items(), AS_OF, 30)
    assert plan_text(out).count("lineitem.parquet") == plan_text(sales.sales_daily(fx.challans(), fx.items(), AS_OF, 30)).count("lineitem.parquet")
    rows = out.collect()
    days = sorted((r.sale_date, r.challans, r.revenue, r.units) for r in rows if r.report == "day")
    assert days == sorted(tuple(r) for r in sales.sales_daily(fx.challans(), fx.items(), AS_OF, 30).collect())
    total = [r for r in rows if r.report == "total"]
    assert len(total) == 1 and total[0].units == sum(d[3] for d in days) == sum(r.units for r in rows if r.report == "seller")
