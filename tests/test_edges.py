"""Semantic edge cases (FIXTURES.md §4), one small frame each."""

from __future__ import annotations

import csv
import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import alerts as al
from ledgerloom.operators import allocation as alloc
from ledgerloom.operators import commands as cm
from ledgerloom.operators import crm, listing, requests, sales
from ledgerloom.operators import inventory as inv

from .frames import (CHALLANS, CUSTOMERS, ITEMS, MOVEMENTS, PRODUCTS, QUERIES, REQUESTS, USERS, frame,
                     money, ts)

AS_OF = dt.date(2026, 3, 15)


def _users(spark):
    return frame(spark, [(1, "Asha", "a@x.test", "SALES"), (2, "Bala", "b@x.test", "WAREHOUSE"),
                         (3, "Chen", "c@x.test", "ADMIN")], USERS)


def test_window_start_and_future_sale(spark):
    start = AS_OF - dt.timedelta(days=30)
    ch = frame(spark, [
        (1, "CH-1", 1, 1, "CONFIRMED", ts(start), ts(start), None),                     # at the start: in
        (2, "CH-2", 1, 1, "CONFIRMED", ts(start), ts(start) - dt.timedelta(seconds=1), None),  # 1 s before: out
        (3, "CH-3", 1, 1, "CONFIRMED", ts(AS_OF), ts(AS_OF + dt.timedelta(days=3)), None),     # future: in
        (4, "CH-4", 1, 1, "DRAFT", ts(AS_OF), None, None)], CHALLANS)
    it = frame(spark, [(c, 1, 1, "p", "s", money(10), 1) for c in (1, 2, 3, 4)], ITEMS)
    got = {r.sale_date: r.challans for r in sales.sales_daily(ch, it, AS_OF, 30).collect()}
    assert got == {start: 1, AS_OF + dt.timedelta(days=3): 1}


def test_low_stock_is_inclusive(spark):
    p = frame(spark, [(1, "a", "A", "c", money(1), 5, "L"), (2, "b", "B", "c", money(1), 5, "L")], PRODUCTS)
    mv = frame(spark, [(1, 5, "IN", "r", "OPENING_STOCK", None, 1, ts(AS_OF)),
                       (2, 6, "IN", "r", "OPENING_STOCK", None, 1, ts(AS_OF))], MOVEMENTS)
    ps = {r.id: (r.is_low_stock, r.stock_status) for r in inv.products_with_stock(p, inv.stock_levels(mv)).collect()}
    assert ps == {1: (True, "Low stock"), 2: (False, "Healthy")}


def test_follow_up_window(spark):
    days = [-1, 0, 7, 8, None]
    cu = frame(spark, [(i, f"c{i}", "b", "+910000000000", None, None, "RETAIL", "LEAD",
                        None if d is None else AS_OF + dt.timedelta(days=d)) for i, d in enumerate(days)], CUSTOMERS)
    assert sorted(r.id for r in crm.followups_due(cu, AS_OF).collect()) == [1, 2]
    details = [r.detail for r in al.alerts_follow_up(cu, AS_OF).collect()]
    assert sorted(details)[0].endswith(AS_OF.strftime("%b ") + str(AS_OF.day))


def _confirm(spark, stock_rows, challan_rows, item_rows, batch_ids, products=(1, 2)):
    ch = frame(spark, challan_rows, CHALLANS)
    lines = frame(spark, item_rows, "challan_id bigint, line_no int, product_id bigint, quantity int")
    stock = frame(spark, stock_rows, "product_id bigint, available bigint")
    prods = frame(spark, [(p, f"p{p}", f"S{p}", "c", money(1), 0, "L") for p in products], PRODUCTS)
    batch = frame(spark, [(c, ts(AS_OF, 0, i)) for i, c in enumerate(batch_ids)],
                  "challan_id bigint, requested_at timestamp_ntz")
    return alloc.confirm_drafts(ch, lines, stock, prods, batch, ts(AS_OF))


def _draft(cid, status="DRAFT"):
    return (cid, f"CH-{cid}", 1, 1, status, ts(AS_OF), None, None)


def test_all_or_nothing_and_exact_stock(spark):
    res = _confirm(spark, [(1, 10), (2, 3)],
                   [_draft(1), _draft(2)],
                   [(1, 1, 1, 4), (1, 2, 2, 5),      # second item short: nothing applied
                    (2, 1, 1, 10), (2, 2, 2, 3)],    # exactly the stock: applied, level 0
                   [1, 2])
    dec = {r.challan_id: (r.outcome, r.short_product_id) for r in res["decisions"].collect()}
    assert dec == {1: ("insufficient_stock", 2), 2: ("applied", None)}
    assert sorted((r.product_id, r.quantity_changed) for r in res["movements"].collect()) == [(1, 10), (2, 3)]
    assert {r.product_id: r.available for r in res["stock"].collect()} == {1: 0, 2: 0}


def test_deleted_product_and_not_draft(spark):
    res = _confirm(spark, [(1, 10)],
                   [_draft(1), _draft(2, "CONFIRMED"), _draft(3, "CANCELLED")],
                   [(1, 1, None, 1), (2, 1, 1, 1), (3, 1, 1, 1)], [1, 2, 3, 4])
    dec = {r.challan_id: r.outcome for r in res["decisions"].collect()}
    assert dec == {1: "product_missing", 2: "conflict", 3: "conflict", 4: "not_found"}


def test_export_escaping(spark, scratch):
    rows = [("=1+1",), ("+x",), ("-x",), ("@x",), ("\tx",), ('a"b',), (None,)]
    df = frame(spark, rows, "v string").select(listing.csv_safe(F.col("v")).alias("v"))
    got = [r.v for r in df.collect()]
    assert got == ["'=1+1", "'+x", "'-x", "'@x", "'\tx", 'a"b', ""]
    listing.write_export(df.select(*[F.col("v").alias(c) for c in
                                     ["challan", "customer", "business", "status", "units", "created",
                                      "created_by"]]).coalesce(1), scratch + "/out")
    text = open(glob.glob(scratch + "/out/*.csv")[0], encoding="utf-8").read()
    assert '"a""b"' in text and text.splitlines()[0].startswith('"Challan","Customer"')
    parsed = list(csv.reader(open(glob.glob(scratch + "/out/*.csv")[0], encoding="utf-8")))
    assert parsed[1][0] == "'=1+1"


def test_search_trim_case_accents(spark):
    df = frame(spark, [("CH-1", "Évergreen Stores", "x"), ("CH-2", "Other", "y")],
               "challan_number string, customer_name string, business_name string").withColumn("status", F.lit("DRAFT"))
    assert listing.filter_challans(df, "").count() == 2
    assert [r.challan_number for r in listing.filter_challans(df, " EVER ").collect()] == ["CH-1"]
    assert listing.filter_challans(df, "100%").count() == 0      # % is literal (Q3)
    with pytest.raises(ValueError):
        listing.filter_challans(df, None, "SHIPPED")              # unknown status (Q4)


def test_numbering(spark):
    from ledgerloom.functions.text import challan_number
    df = frame(spark, [(7,), (123456,)], "n bigint").select(challan_number(F.lit(2026), F.col("n")).alias("c"))
    assert [r.c for r in df.collect()] == ["CH-2026-00007", "CH-2026-123456"]
    new = frame(spark, [(10, ts(AS_OF, 9)), (11, ts(AS_OF, 8)), (12, ts(AS_OF - dt.timedelta(days=1)))],
                "id bigint, created_at timestamp_ntz")
    got = {r.id: r.challan_number for r in cm.challan_numbers(new, F.lit(6)).collect()}
    assert got == {12: "CH-2026-00007", 11: "CH-2026-00008", 10: "CH-2026-00009"}


def _alert_world(spark, stock_a):
    p = frame(spark, [(1, "Marker", "M", "c", money(1), 6, "L")], PRODUCTS)
    mv = frame(spark, [(1, stock_a, "IN", "r", "OPENING_STOCK", None, 1, ts(AS_OF))], MOVEMENTS)
    cu = frame(spark, [], CUSTOMERS)
    q = frame(spark, [], QUERIES)
    return al.alerts_live(inv.products_with_stock(p, inv.stock_levels(mv)), cu, q, AS_OF)


def test_alert_returns_unread(spark):
    now = ts(AS_OF)
    low = _alert_world(spark, 6)
    snap1 = al.alerts_merge(al.as_snapshot(low, now).limit(0), low, now)
    assert [r.detail for r in snap1.collect()] == ["Marker has 6 units left"]
    reads = al.mark_read(snap1, frame(spark, [], "notification_id string, user_id bigint, read_at timestamp_ntz"),
                         1, now)
    assert al.unread_count(snap1, reads, 1).collect()[0].unread_count == 0
    healthy = _alert_world(spark, 50)
    snap2 = al.alerts_merge(snap1, healthy, now)
    assert snap2.count() == 0 and al.stale_alerts(snap1, healthy).count() == 1
    reads2 = al.surviving_reads(reads, snap2)
    snap3 = al.alerts_merge(snap2, low, now)
    assert al.unread_count(snap3, reads2, 1).collect()[0].unread_count == 1


def test_read_twice_keeps_first_time(spark):
    now = ts(AS_OF)
    low = _alert_world(spark, 1)
    snap = al.as_snapshot(low, now)
    empty = frame(spark, [], "notification_id string, user_id bigint, read_at timestamp_ntz")
    r1 = al.mark_read(snap, empty, 1, now)
    r2 = al.mark_read(snap, r1, 1, now + dt.timedelta(days=1))
    assert [r.read_at for r in r2.collect()] == [now]


def test_long_question_is_cut_to_100(spark):
    cu = frame(spark, [(1, "Neha", "b", "+910000000000", None, None, "RETAIL", "LEAD", None)], CUSTOMERS)
    q = frame(spark, [(9, 1, "subject", "x" * 150, "OPEN", "HIGH", 1)], QUERIES)
    r = al.alerts_open_query(q, cu).collect()[0]
    assert r.detail == "Neha / " + "x" * 100 and r.title == "Open query: subject" and r.priority == "HIGH"


def test_reply_transitions(spark):
    q = frame(spark, [(1, 1, "s", "m", "OPEN", "LOW", 1), (2, 1, "s", "m", "IN_PROGRESS", "LOW", 1),
                      (3, 1, "s", "m", "RESOLVED", "LOW", 1)], QUERIES)
    cmds = frame(spark, [(10, 1, "reply"), (11, 2, "reply"), (12, 3, "reply"), (13, 1, "resolve"),
                         (14, 1, "reply"), (15, 1, "resolve")], "command_id bigint, query_id bigint, action string")
    got = {r.command_id: (r.outcome, r.status_after) for r in cm.query_transitions(q, cmds, ts(AS_OF)).collect()}
    assert got == {10: ("applied", "IN_PROGRESS"), 11: ("applied", "IN_PROGRESS"), 12: ("conflict", "RESOLVED"),
                   13: ("applied", "RESOLVED"), 14: ("conflict", "RESOLVED"), 15: ("not_found", "RESOLVED")}


def test_reviewer_left_join_and_visibility(spark):
    users = _users(spark)
    p = frame(spark, [(1, "a", "A", "c", money(1), 0, "L")], PRODUCTS)
    ps = inv.products_with_stock(p, inv.stock_levels(frame(spark, [], MOVEMENTS)))
    rq = frame(spark, [(1, 1, 1, 5, "HIGH", "need", "PENDING", None, ts(AS_OF)),
                       (2, 1, 3, 5, "LOW", "need", "APPROVED", 2, ts(AS_OF))], REQUESTS)
    rows = requests.stock_requests_list(rq, ps, users).collect()
    assert [(r.id, r.reviewed_by_name) for r in rows] == [(1, None), (2, "Bala")]   # PENDING first
    assert [r.id for r in requests.stock_requests_list(rq, ps, users, role="SALES", user_id=1).collect()] == [1]
    for role in ("WAREHOUSE", "ADMIN"):
        assert requests.stock_requests_list(rq, ps, users, role=role, user_id=1).count() == 2
    with pytest.raises(ValueError):
        requests.stock_requests_list(rq, ps, users, status="LOST")


def test_review_once(spark):
    rq = frame(spark, [(1, 1, 1, 5, "HIGH", "m", "PENDING", None, ts(AS_OF)),
                       (2, 1, 1, 5, "HIGH", "m", "REJECTED", 2, ts(AS_OF))], REQUESTS)
    cmds = frame(spark, [(1, 1), (2, 1), (3, 2), (4, 9)], "command_id bigint, request_id bigint")
    got = {r.command_id: r.outcome for r in cm.review_requests(rq, cmds, 2, ts(AS_OF), "approve").collect()}
    assert got == {1: "applied", 2: "conflict", 3: "conflict", 4: "not_found"}
    mv = cm.approval_movements(cm.review_requests(rq, cmds, 2, ts(AS_OF), "approve"), 2, ts(AS_OF)).collect()
    assert [(m.product_id, m.quantity_changed, m.reference_type) for m in mv] == [(1, 5, "STOCK_REQUEST")]


def test_adjustments_refusal_does_not_count(spark):
    stock = frame(spark, [(1, 5)], "product_id bigint, available bigint")
    cmds = frame(spark, [(1, 1, "OUT", 4, ts(AS_OF, 1)), (2, 1, "OUT", 3, ts(AS_OF, 2)),
                         (3, 1, "IN", 10, ts(AS_OF, 3)), (4, 1, "OUT", 3, ts(AS_OF, 4)),
                         (5, 1, "OUT", 1, ts(AS_OF, 5))],
                 "command_id bigint, product_id bigint, movement_type string, quantity int, requested_at timestamp_ntz")
    got = {r.command_id: r.outcome for r in alloc.apply_adjustments(cmds, stock, stock.select(F.col("product_id").alias("id"))).collect()}
    assert got == {1: "applied", 2: "insufficient_stock", 3: "applied", 4: "applied", 5: "applied"}


def test_orphans_and_unique(spark):
    from ledgerloom.operators import quality as dq
    customers = frame(spark, [(1,), (2,)], "id bigint")
    users = frame(spark, [(7,)], "id bigint")
    follow = frame(spark, [(10, 1, 7), (11, 3, 7), (12, 3, 8), (13, None, 7)],
                   "id bigint, customer_id bigint, created_by bigint")
    reviews = frame(spark, [(20, 4)], "id bigint, customer_id bigint")
    got = sorted(tuple(r) for r in dq.dq_orphans([
        ("customer_follow_ups", "customer_id", follow, customers),
        ("customer_follow_ups", "created_by", follow, users),
        ("customer_reviews", "customer_id", reviews, customers)]).collect())
    assert got == [("customer_follow_ups", "created_by", 8, 1), ("customer_follow_ups", "customer_id", 3, 2),
                   ("customer_reviews", "customer_id", 4, 1)]
    skus = frame(spark, [("A",), ("A",), ("B",), (None,), (None,)], "sku string")
    assert [tuple(r) for r in dq.dq_unique([("products", skus, ["sku"])]).collect()] == [("products", "A", 2)]


def test_customer_rules(spark):
    from ledgerloom.operators import quality as dq
    cu = frame(spark, [(1, "A", "Biz", "12345", "bad-mail", "G" * 31, "RETAIL", "LEAD", None),
                       (2, "Asha", "Biz", "+910000000001", "a@b.co", None, "VIP", "LEAD", None)], CUSTOMERS)
    got = sorted((r.record_id, r.rule) for r in dq.dq_customers(cu).collect())
    assert got == [(1, "customer_name_length"), (1, "email_format"), (1, "gst_number_length"), (1, "mobile_length"),
                   (2, "customer_type_enum")]


def test_question_must_belong_to_customer_and_email_lookup(spark, scratch):
    q = frame(spark, [(1, 5, "s", "m", "OPEN", "LOW", 1)], QUERIES)
    cmds = frame(spark, [(10, 1, "reply", 5), (11, 1, "reply", 6)],
                 "command_id bigint, query_id bigint, action string, customer_id bigint")
    got = {r.command_id: r.outcome for r in cm.query_transitions(q, cmds, ts(AS_OF)).collect()}
    assert got == {10: "applied", 11: "not_found"}
    users = _users(spark)
    assert [r.id for r in listing.user_by_email(users, "B@X.TEST").collect()] == [2]
    from ledgerloom.sources.sinks import write_json_documents
    doc = spark.createDataFrame([(1, [(1, "x")])], "id bigint, items array<struct<pos:int, name:string>>")
    write_json_documents(doc, scratch + "/docs")
    assert spark.read.json(scratch + "/docs").collect()[0].items[0].name == "x"


def test_export_of_the_fixture_writes_quoted_part_files(spark, scratch):
    from ledgerloom.plans.keys_listing import challan_rows
    from ledgerloom.sources.fixtures import Fixture
    from .conftest import SF_SMALL
    export = listing.challan_export(challan_rows(Fixture(spark, SF_SMALL)))
    listing.write_export(export, scratch + "/export")
    back = spark.read.option("header", True).csv(scratch + "/export")
    assert back.columns == listing.EXPORT_HEADER
    assert back.count() == export.count() == 1500
    first = open(sorted(glob.glob(scratch + "/export/*.csv"))[0], encoding="utf-8").readline()
    assert first.strip() == ",".join(f'"{h}"' for h in listing.EXPORT_HEADER)


def test_invalid_quantities_are_rejected_before_allocation(spark):
    stock = frame(spark, [(1, 5)], "product_id bigint, available bigint")
    cmds = frame(spark, [(1, 1, "OUT", "2", ts(AS_OF, 1)), (2, 1, "OUT", "x", ts(AS_OF, 2)),
                         (3, 1, "OUT", "-1", ts(AS_OF, 3)), (4, 1, "MOVE", "1", ts(AS_OF, 4)),
                         (5, 1, "OUT", "3", ts(AS_OF, 5)), (6, None, "IN", "1", ts(AS_OF, 6))],
                 "command_id bigint, product_id bigint, movement_type string, quantity string, requested_at timestamp_ntz")
    got = {r.command_id: r.outcome for r in alloc.apply_adjustments(cmds, stock, stock.select(F.col("product_id").alias("id"))).collect()}
    assert got == {1: "applied", 2: "invalid", 3: "invalid", 4: "invalid", 5: "applied", 6: "invalid"}
    res = _confirm(spark, [(1, 10)], [_draft(1), _draft(2)], [(1, 1, 1, 0), (2, 1, 1, 3)], [1, 2])
    assert {r.challan_id: r.outcome for r in res["decisions"].collect()} == {1: "invalid", 2: "applied"}


def test_repeats_inside_one_batch(spark):
    res = _confirm(spark, [(1, 10)], [_draft(1)], [(1, 1, 1, 6)], [1, 1])      # same draft twice
    assert [(r.challan_id, r.outcome) for r in res["decisions"].collect()] == [(1, "applied")]
    assert [r.available for r in res["stock"].collect()] == [4]
    inc = frame(spark, [(1, "Asha", "Biz", "+910000000001", None, None, "RETAIL", "LEAD", None),
                        (2, "Asha", "Biz", "+910000000001", None, None, "RETAIL", None, None)], CUSTOMERS)
    got = {r.id: (r.outcome, r.status) for r in cm.ingest_customers(inc.limit(0), inc).collect()}
    assert got == {1: ("applied", "LEAD"), 2: ("duplicate", "LEAD")}


def test_last_product_update_wins(spark):
    p = frame(spark, [(1, "a", "A", "c", money(1), 5, "L")], PRODUCTS)
    upd = frame(spark, [(1, 10, "first"), (1, 11, "second"), (9, 12, "nowhere")],
                "id bigint, command_id bigint, warehouse_location string")
    got = {r.id: (r.warehouse_location, r.outcome) for r in cm.update_products(p, upd).collect()}
    assert got == {1: ("second", "applied"), 9: (None, "not_found")}


def test_foreign_customers_do_not_resolve_a_question(spark):
    q = frame(spark, [(1, 10, "OPEN")], "id bigint, customer_id bigint, status string")
    cmds = frame(spark, [(1, 1, 99, "resolve"), (2, 1, 10, "reply"), (3, 1, 10, "note"), (4, 1, 10, "resolve"), (5, 1, 10, "reply")],
                 "command_id bigint, query_id bigint, customer_id bigint, action string")
    got = {r.command_id: (r.outcome, r.status_after) for r in cm.query_transitions(q, cmds, ts(AS_OF)).collect()}
    assert got == {1: ("not_found", None), 2: ("applied", "IN_PROGRESS"), 3: ("invalid", "IN_PROGRESS"),
                   4: ("applied", "RESOLVED"), 5: ("conflict", "RESOLVED")}


def test_adjustments_of_unknown_products(spark):
    stock = frame(spark, [(1, 5)], "product_id bigint, available bigint")
    products = frame(spark, [(1,), (2,)], "id bigint")
    cmds = frame(spark, [(1, 777, "IN", 4, ts(AS_OF, 1)), (2, 777, "OUT", 3, ts(AS_OF, 2)), (3, 2, "IN", 3, ts(AS_OF, 3)),
                         (4, 1, "OUT", 2, ts(AS_OF, 4))],
                 "command_id bigint, product_id bigint, movement_type string, quantity int, requested_at timestamp_ntz")
    done = alloc.apply_adjustments(cmds, stock, products)
    assert {r.command_id: r.outcome for r in done.collect()} == {1: "not_found", 2: "not_found", 3: "applied", 4: "applied"}
    effects = alloc.adjustment_effects(done, stock, 3)
    assert sorted((r.product_id, r.movement_type, r.quantity_changed) for r in effects["movements"].collect()) == [(1, "OUT", 2), (2, "IN", 3)]
    assert sorted(map(tuple, effects["stock"].collect())) == [(1, 3), (2, 3)]


def test_an_invalid_first_request_takes_nothing_from_a_later_one(spark):
    schema = ("id bigint, customer_name string, business_name string, mobile string, email string, gst_number string, "
              "customer_type string, status string, follow_up_date date, address string")
    row = lambda i, kind: (i, "Anna", "Anna Ltd", "1234567", None, None, kind, None, None, "Street 1")
    inc = frame(spark, [row(1, "WRONG"), row(2, "RETAIL"), row(3, "RETAIL")], schema)
    got = {r.id: r.outcome for r in cm.ingest_customers(inc.limit(0), inc).collect()}
    assert got == {1: "invalid", 2: "applied", 3: "duplicate"}
    got = {r.id: r.outcome for r in cm.ingest_customers(inc.limit(0), inc, skip_duplicates=False).collect()}
    assert got == {1: "invalid", 2: "applied", 3: "applied"}


def test_every_draft_request_has_an_outcome(spark):
    requests = frame(spark, [(1, 1), (2, 1)], "challan_id bigint, customer_id bigint")
    lines = frame(spark, [(1, 1, 5, 2)], "challan_id bigint, line_no int, product_id bigint, quantity int")
    customers = frame(spark, [(1,)], "id bigint")
    products = frame(spark, [(5, "p", "s", 1.0)], "id bigint, product_name string, sku string, unit_price double")
    got = {r.challan_id: (r.outcome, r.line_no) for r in cm.draft_challans(requests, lines, customers, products).collect()}
    assert got == {1: ("applied", 1), 2: ("invalid", None)}


def test_commands_end_their_stages(spark):
    """No stage holds the sorts of many joins: deletes are one aggregate, drafts read written parts."""
    from ledgerloom.plans import registry

    def joins(name):
        return registry.queries()[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString().count("Join ")

    from .conftest import SF_SMALL
    assert joins("cascade_delete_customers") <= 1 and joins("challan_item_snapshot") == 1


def test_cascade_counts_per_stored_customer(spark):
    none = spark.createDataFrame([], "customer_id bigint")
    customers = spark.createDataFrame([(1,), (1,), (2,), (None,)], "id bigint")
    commands = spark.createDataFrame([(1,), (1,), (2,), (3,), (None,)], "customer_id bigint")
    challans = spark.createDataFrame([(2,), (None,)], "customer_id bigint")
    queries = spark.createDataFrame([(10, 1), (11, None)], "id bigint, customer_id bigint")
    replies = spark.createDataFrame([(10,), (10,), (11,), (None,)], "query_id bigint")
    got = cm.cascade_delete_customers(customers, commands, challans, challans, queries, replies, none).collect()
    assert sorted(map(tuple, got), key=str) == sorted([
        (1, "applied", 0, 1, 2, 0), (1, "applied", 0, 1, 2, 0), (2, "conflict", 0, 0, 0, 0),
        (3, "not_found", 0, 0, 0, 0), (None, "not_found", 0, 0, 0, 0)], key=str)
