"""Registered searches by the trigram index (P3-P5): the same rows as the scans."""

from __future__ import annotations

from ledgerloom.operators import inventory as inv
from ledgerloom.operators import listing as ls
from ledgerloom.plans import keys_listing
from ledgerloom.plans.registry import ORACLE, register
from ledgerloom.sources.fixtures import Fixture
from ledgerloom.sources.keyed import KeyedTable
from ledgerloom.sources.scratch import scratch_path
from ledgerloom.sources.trigrams import TrigramIndex, indexed_search

BUCKETS = 16


def _indexed(spark, rows, columns, term):
    path = scratch_path(spark, "search")
    table, index = KeyedTable(f"{path}/table", rows.schema, ("id",), BUCKETS), TrigramIndex(f"{path}/index", "id", tuple(columns))
    table.create(rows)
    index.build(table.read(spark))
    return indexed_search(table, index, spark, term)


@register("indexed_challan_search", ORACLE["challan_search"])
def q_indexed_challan_search(spark, d):
    return _indexed(spark, keys_listing.challan_rows(Fixture(spark, d)), ls.CHALLAN_SEARCH, keys_listing.CHALLAN_TERM)


@register("indexed_product_search", ORACLE["product_search"])
def q_indexed_product_search(spark, d):
    fx = Fixture(spark, d)
    found = _indexed(spark, fx.products(), ls.PRODUCT_SEARCH, keys_listing.PRODUCT_TERM)
    return inv.products_with_stock(found, inv.stock_levels(fx.movements()))


@register("indexed_customer_search", ORACLE["customer_search"])
def q_indexed_customer_search(spark, d):
    found = _indexed(spark, Fixture(spark, d).customers(), ls.CUSTOMER_SEARCH, keys_listing.CUSTOMER_TERM)
    return ls.search_customers(found)
