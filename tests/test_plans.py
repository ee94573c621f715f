"""Plan-level guards for the scale properties the design relies on."""

from __future__ import annotations

import re

import pytest

from ledgerloom.plans.registry import queries
from ledgerloom.plans.report import STREAM_KEYS, plan_text

from .conftest import SF_SMALL

PYTHON_NODES = re.compile(r"BatchEvalPython|ArrowEvalPython|FlatMapGroupsInPandas|MapInPandas|FlatMapGroupsWithState")


@pytest.fixture(scope="module")
def plans(spark):
    return {k: plan_text(job(spark, SF_SMALL)) for k, job in sorted(queries().items()) if k not in STREAM_KEYS}


def test_no_python_operators_anywhere(plans):
    offenders = [k for k, p in plans.items() if PYTHON_NODES.search(p)]
    assert offenders == []


def test_top_n_per_product_limits_before_the_shuffle(plans):
    p = plans["latest_movements_per_product"]
    assert "WindowGroupLimit" in p and ", Partial" in p and ", Final" in p


def test_running_balance_windows_are_split_by_bucket(plans):
    p = plans["stock_running_balance"]
    # the row-level window is partitioned by (product, day bucket), not by product alone
    assert re.search(r"windowspecdefinition\(product_id#\d+L?, _bkt#\d+", p), p


def test_sales_report_aggregates_partially_without_distinct(plans):
    p = plans["sales_daily"]
    assert "partial_sum" in p and "partial_count" in p
    assert "count(distinct" not in p.lower()


def test_scans_read_only_needed_columns(plans):
    p = plans["sales_daily"]
    orders = re.search(r"orders\.parquet\].*?ReadSchema: (struct<[^\n]*>)", p, re.S).group(1)
    assert "o_totalprice" not in orders and "o_orderpriority" not in orders
    lines = re.search(r"lineitem\.parquet\].*?ReadSchema: (struct<[^\n]*>)", p, re.S).group(1)
    assert "l_extendedprice" not in lines and "l_shipdate" not in lines


def test_broadcasts_only_when_size_allows(spark):
    # With broadcasting disabled, the same sales plan must fall back to shuffle joins (no hint forces it).
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = plan_text(queries()["sales_detail"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" not in p and "SortMergeJoin" in p
