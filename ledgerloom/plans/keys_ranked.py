"""Registered list pages by the rank directory (T1): the same rows as by offset."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import listing as ls
from ledgerloom.plans import keys_listing
from ledgerloom.plans.oracle import with_views
from ledgerloom.plans.registry import ORACLE, register
from ledgerloom.sources.domain import with_totals
from ledgerloom.sources.fixtures import Fixture
from ledgerloom.sources.ranks import RankedTable
from ledgerloom.sources.scratch import scratch_path

DEEP_PAGE = 40


def ranked_challans(spark, fx: Fixture) -> RankedTable:
    """The challan list, with its names and total units, stored by rank."""
    heads = ls.challan_heads(with_totals(fx.challans(), fx.raw_lines()), fx.customers(), fx.users())
    table = RankedTable(scratch_path(spark, "ranked"), heads.schema)
    table.create(heads)
    return table


@register("ranked_challan_page", ORACLE["challan_page"])
def q_ranked_challan_page(spark, d):
    return ranked_challans(spark, Fixture(spark, d)).page(spark, keys_listing.PAGE_NO, keys_listing.PAGE_SIZE)


@register("ranked_challan_deep_page", with_views(f"""
SELECT * FROM ({keys_listing._LIST_SQL}) ORDER BY created_at DESC NULLS LAST, id DESC
LIMIT {keys_listing.PAGE_SIZE} OFFSET {(DEEP_PAGE - 1) * keys_listing.PAGE_SIZE}""", "challans", "customers", "users"))
def q_ranked_challan_deep_page(spark, d):
    return ranked_challans(spark, Fixture(spark, d)).page(spark, DEEP_PAGE, keys_listing.PAGE_SIZE)


@register("ranked_challan_pages", with_views(f"""
SELECT CAST((rn - 1) // {keys_listing.PAGE_SIZE} + 1 AS BIGINT) AS page_no, COUNT(*) AS rows,
       CAST(SUM(total_quantity) AS BIGINT) AS total_quantity, MAX(id) AS largest_id
FROM (SELECT l.*, ROW_NUMBER() OVER (ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM ({keys_listing._LIST_SQL}) l)
GROUP BY 1""", "challans", "customers", "users"))
def q_ranked_challan_pages(spark, d):
    ranked = ranked_challans(spark, Fixture(spark, d)).ranked(spark)
    page_no = F.floor((F.col("rank") - 1) / keys_listing.PAGE_SIZE) + 1
    return ranked.groupBy(page_no.alias("page_no")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("total_quantity").alias("total_quantity"), F.max("id").alias("largest_id"))
