"""Pages by number from the rank directory equal offset paging, and open few files."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from ledgerloom.operators import listing as ls
from ledgerloom.sources.ranks import RankedTable
from tests.frames import ts

SCHEMA = "id long, created_at timestamp_ntz, name string"
DAY = dt.date(2001, 8, 1)


def _rows(ids, seed=1):
    dice = random.Random(seed)
    # a third of all rows at one instant, some without a time
    return [(i, None if i % 17 == 0 else ts(DAY, 9) if i % 3 == 0 else ts(DAY - dt.timedelta(days=dice.randrange(90)), dice.randrange(24)), f"n{i}")
            for i in ids]


@pytest.fixture()
def table(spark, scratch):
    return RankedTable(scratch, spark.createDataFrame([], SCHEMA).schema)


def _same_pages(spark, table, df, limit=30):
    n = df.count()
    assert table.total(spark) == n
    for k in (1, 2, 7, n // limit, n // limit + 1, n // limit + 2):
        if k:
            want = [r.id for r in ls.page(df, k, limit).collect()]
            assert [r.id for r in table.page(spark, k, limit).collect()] == want


def test_pages_equal_offset(spark, table):
    df = spark.createDataFrame(_rows(range(1000)), SCHEMA)
    table.create(df, 12)
    _same_pages(spark, table, df)
    assert sorted(map(tuple, table.read(spark).collect())) == sorted(map(tuple, df.collect()), key=lambda r: r[0])


def test_a_late_page_opens_as_few_files_as_the_first(spark, table):
    table.create(spark.createDataFrame(_rows(range(3000)), SCHEMA), 30)
    assert len(table.read(spark).inputFiles()) == table.directory(spark).count() > 20
    assert all(len(table.place(spark, k, 20).ranges) <= 2 for k in range(1, 151, 10))
    for k in (1, 60, 150):
        plan = table.page(spark, k, 20)._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [_range" in plan.replace("isnotnull(_range", "_range") or "PartitionFilters: [_range#" in plan


def test_added_rows_go_to_their_places(spark, table):
    df = spark.createDataFrame(_rows(range(0, 900, 2)), SCHEMA)
    table.create(df, 10)
    newest = spark.createDataFrame([(5001, ts(DAY, 20), "new"), (5003, ts(DAY, 21), "newer")], SCHEMA)
    assert table.add(newest) == [0]
    _same_pages(spark, table, df.union(newest))
    late = spark.createDataFrame(_rows(range(1, 400, 2), seed=5), SCHEMA)
    table.add(late)
    table.add(late)  # a replay changes nothing
    _same_pages(spark, table, df.union(newest).union(late))


def test_empty_tables(spark, table):
    none = spark.createDataFrame([], SCHEMA)
    table.create(none)
    assert table.total(spark) == 0 and table.page(spark, 1).collect() == []
    assert table.add(none) == []
    some = spark.createDataFrame(_rows(range(40)), SCHEMA)
    table.add(some)
    _same_pages(spark, table, some)
    with pytest.raises(ValueError):
        table.page(spark, 0)
