"""Registered reports over the stored tables (S1, J3): challans with their total units,
and challans and lines in buckets of the challan id."""

from __future__ import annotations

from functools import cached_property

from ledgerloom.config import AS_OF
from ledgerloom.operators import listing as ls
from ledgerloom.operators import sales
from ledgerloom.plans import keys_listing, keys_sales
from ledgerloom.plans.oracle import with_views
from ledgerloom.plans.registry import register
from ledgerloom.sources.domain import materialize_bucketed
from ledgerloom.sources.fixtures import Fixture
from ledgerloom.sources.scratch import scratch_path

BUCKETS = 8


class _Stored:
    def __init__(self, spark, d):
        self.fx, self.spark = Fixture(spark, d), spark

    @cached_property
    def tables(self):
        return materialize_bucketed(self.fx, scratch_path(self.spark, "stored"), BUCKETS)


@register("stored_sales_daily", keys_sales.SQL_DAILY)
def q_stored_sales_daily(spark, d):
    challans, items = _Stored(spark, d).tables
    return sales.sales_daily(challans, items, AS_OF, keys_sales.DAYS)


@register("stored_challan_search", with_views(f"SELECT * FROM ({keys_listing._LIST_SQL}) WHERE {keys_listing._challan_match(keys_listing.CHALLAN_TERM)}",
                                              "challans", "customers", "users"))
def q_stored_challan_search(spark, d):
    stored = _Stored(spark, d)
    challans, items = stored.tables
    return ls.with_units(ls.search_heads(challans, stored.fx.customers(), stored.fx.users(), keys_listing.CHALLAN_TERM), items)


@register("stored_challan_page", with_views(f"""
SELECT * FROM ({keys_listing._LIST_SQL}) ORDER BY created_at DESC NULLS LAST, id DESC
LIMIT {keys_listing.PAGE_SIZE} OFFSET {(keys_listing.PAGE_NO - 1) * keys_listing.PAGE_SIZE}""", "challans", "customers", "users"))
def q_stored_challan_page(spark, d):
    stored = _Stored(spark, d)
    challans, items = stored.tables
    heads = ls.challan_heads(challans, stored.fx.customers(), stored.fx.users())
    return ls.page_with_units(ls.page(heads, keys_listing.PAGE_NO, keys_listing.PAGE_SIZE), items)
