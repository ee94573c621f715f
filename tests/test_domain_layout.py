"""Stored domain tables: same results as the views, with partition pruning and pushed filters."""

from __future__ import annotations

import glob
import re

from ledgerloom.config import AS_OF
from ledgerloom.operators import inventory as inv
from ledgerloom.operators import listing as ls
from ledgerloom.operators import sales
from ledgerloom.plans.report import plan_text
from ledgerloom.sources.domain import DOMAIN_SCHEMAS, materialize_bucketed, materialize_fixture, open_bucketed, read_domain_table
from ledgerloom.sources.fixtures import Fixture

from .conftest import SF_SMALL


def test_stored_tables_prune_and_match(spark, scratch):
    fx = Fixture(spark, SF_SMALL)
    materialize_fixture(fx, scratch)
    ch = read_domain_table(spark, scratch, "challans")
    it = read_domain_table(spark, scratch, "challan_items")
    stored = sales.sales_daily(ch, it, AS_OF, 30)
    view = sales.sales_daily(fx.challans(), fx.items(), AS_OF, 30)
    assert sorted(stored.collect()) == sorted(view.collect())
    plan = plan_text(stored)
    assert re.search(r"PartitionFilters: \[.*confirmed_month#\d+ >= 2001-07", plan)
    assert "GreaterThanOrEqual(confirmed_at,2001-07-02T00:00)" in plan and "EqualTo(status,CONFIRMED)" in plan
    mv = read_domain_table(spark, scratch, "stock_movements")
    assert sorted(inv.stock_levels(mv).collect()) == sorted(inv.stock_levels(fx.movements()).collect())
    assert set(read_domain_table(spark, scratch, "users").columns) == {f.name for f in DOMAIN_SCHEMAS["users"].fields}


def test_window_filter_reaches_the_items_scan_at_scale(spark, scratch):
    # At scale neither side can be broadcast and the items scan is large: Spark then
    # injects a bloom filter built from the filtered challans into the items scan.
    fx = Fixture(spark, SF_SMALL)
    materialize_fixture(fx, scratch)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1KB"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        ch = read_domain_table(spark, scratch, "challans")
        it = read_domain_table(spark, scratch, "challan_items")
        plan = plan_text(sales.sales_daily(ch, it, AS_OF, 30))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert re.search(r"might_contain\(.*xxhash64\(challan_id", plan)


def test_stock_as_of_a_date_prunes_ledger_months(spark, scratch):
    import datetime as dt
    fx = Fixture(spark, SF_SMALL)
    materialize_fixture(fx, scratch)
    mv = read_domain_table(spark, scratch, "stock_movements")
    until = dt.datetime(1998, 1, 1)
    stored = inv.stock_levels(mv, until=until)
    assert re.search(r"PartitionFilters: \[.*created_month#\d+ <= 1998-01", plan_text(stored))
    assert sorted(stored.collect()) == sorted(inv.stock_levels(fx.movements(), until=until).collect())


def _columns_of(folder, *names):
    import pyarrow.parquet as pq
    for path in sorted(glob.glob(f"{folder}/**/part-*", recursive=True)):
        yield path, list(zip(*(pq.ParquetFile(path).read([n]).column(0).to_pylist() for n in names), strict=True))


def test_files_are_sorted_and_all_columns_are_kept(spark, scratch):
    fx = Fixture(spark, SF_SMALL)
    materialize_fixture(fx, scratch)
    for table, sort in (("challans", ("confirmed_at", "id")), ("stock_movements", ("product_id", "created_at")), ("challan_items", ("challan_id",))):
        found = list(_columns_of(f"{scratch}/{table}", *sort))
        assert found
        for path, rows in found:
            keys = [tuple((v is not None, v) for v in r) for r in rows]
            assert keys == sorted(keys), path
    ch = read_domain_table(spark, scratch, "challans")
    total = dict(read_domain_table(spark, scratch, "challan_items").groupBy("challan_id").sum("quantity").collect())
    assert {r.id: r.total_quantity for r in ch.collect()} == {r.id: total.get(r.id, 0) for r in fx.challans().select("id").collect()}
    assert read_domain_table(spark, scratch, "customers").where("address IS NOT NULL").count() == fx.customers().count()
    for table, names in (("stock_requests", {"reviewed_at", "review_note"}), ("customer_reviews", {"created_at"}),
                         ("customer_queries", {"created_at", "resolved_at"}), ("customer_query_replies", {"created_at"})):
        assert names <= set(read_domain_table(spark, scratch, table).columns)


def test_bucketed_lines_are_joined_without_a_shuffle(spark, scratch):
    fx = Fixture(spark, SF_SMALL)
    challans, items = materialize_bucketed(fx, scratch, 4)
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = sales.sales_daily(challans, items, AS_OF, 30)
        plan = plan_text(out)
        view = sales.sales_daily(fx.challans(), fx.items(), AS_OF, 30)
        assert sorted(out.collect()) == sorted(view.collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    shuffles = re.findall(r"Arguments: (hashpartitioning\([^)]*\))", plan)
    assert len(shuffles) == 1 and "sale_date" in shuffles[0], shuffles
    assert "SelectedBucketsCount: 4 out of 4" in plan
    for path, rows in _columns_of(f"{scratch}/challan_items", "challan_id", "line_no"):
        assert rows == sorted(rows), path
    assert len(list(_columns_of(f"{scratch}/challan_items", "challan_id"))) == 4
    again = open_bucketed(spark.newSession(), scratch, "challan_items", 4)
    assert sorted(again.collect()) == sorted(items.collect())


def test_a_stored_total_needs_no_lines(spark, scratch):
    fx = Fixture(spark, SF_SMALL)
    challans, items = materialize_bucketed(fx, scratch, 4)
    heads = ls.search_heads(challans, fx.customers(), fx.users(), "CH-199")
    assert "lineitem" not in plan_text(ls.with_units(heads, fx.raw_lines()))
    assert "line_no" not in plan_text(ls.with_units(heads, items)) and "/challan_items]" not in plan_text(ls.with_units(heads, items))
    page = ls.page_with_units(ls.page(ls.challan_heads(challans, fx.customers(), fx.users()), 2, 20), items)
    assert "/challan_items]" not in plan_text(page)
    plain = ls.page_with_units(ls.page(ls.challan_heads(fx.challans(), fx.customers(), fx.users()), 2, 20), fx.raw_lines())
    assert sorted(plain.collect()) == sorted(page.select(*plain.columns).collect())
    assert "In(l_orderkey" in plan_text(plain)
