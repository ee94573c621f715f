"""Registered CRM and stock-request keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.config import AS_OF, AS_OF_SQL
from ledgerloom.operators import crm
from ledgerloom.operators import inventory as inv
from ledgerloom.operators import requests as rq
from ledgerloom.plans.oracle import with_views
from ledgerloom.plans.registry import register
from ledgerloom.plans.render import nested_sql, render_array
from ledgerloom.sources.fixtures import Fixture

VISIBLE_USER = 5       # a SALES user (5 % 4 = 1): sees only their own requests
VISIBLE_ROLE = "SALES"

_FU_FIELDS = ["id", "note", "follow_up_date", "created_at", "created_by_name"]
_FU = "SELECT f.*, u.name AS created_by_name FROM follow_ups f JOIN users u ON u.id = f.created_by"
SQL_TIMELINE = with_views(f"""
SELECT c.id, c.customer_name, c.business_name, c.mobile, c.status, c.follow_up_date,
       COALESCE(n.chunk_no, 0) AS chunk_no, COALESCE(n.n_follow_ups, 0) AS n_follow_ups,
       COALESCE(n.follow_ups_text, '') AS follow_ups_text
FROM customers c LEFT JOIN nested n ON n.customer_id = c.id""", "customers", "follow_ups", "users",
    extra=[("fu", _FU), ("nested", nested_sql("fu", "customer_id", "created_at DESC, id DESC", _FU_FIELDS, "follow_ups"))])

_RP_FIELDS = ["turn", "message", "created_by_name"]
_RP = "SELECT r.*, u.name AS created_by_name FROM replies r JOIN users u ON u.id = r.created_by"
SQL_THREADS = with_views("""
SELECT q.id, q.customer_id, q.subject, q.status, q.priority, COALESCE(n.chunk_no, 0) AS chunk_no,
       COALESCE(n.n_replies, 0) AS n_replies, COALESCE(n.replies_text, '') AS replies_text
FROM queries q LEFT JOIN nested n ON n.query_id = q.id""", "queries", "replies", "users",
    extra=[("rp", _RP), ("nested", nested_sql("rp", "query_id", "turn", _RP_FIELDS, "replies"))])


@register("customer_timeline", SQL_TIMELINE)
def q_timeline(spark, d):
    fx = Fixture(spark, d)
    df = crm.customer_timeline(fx.customers(), fx.follow_ups(), fx.users())
    return render_array(df, ["id", "customer_name", "business_name", "mobile", "status", "follow_up_date",
                             "chunk_no"], "follow_ups", _FU_FIELDS)


@register("customer_query_threads", SQL_THREADS)
def q_threads(spark, d):
    fx = Fixture(spark, d)
    df = crm.customer_query_threads(fx.queries(), fx.replies(), fx.users())
    return render_array(df, ["id", "customer_id", "subject", "status", "priority", "chunk_no"],
                        "replies", _RP_FIELDS)


@register("query_replies", with_views("""
SELECT r.query_id, q.customer_id, r.turn, r.message, u.name AS created_by_name
FROM replies r JOIN queries q ON q.id = r.query_id JOIN users u ON u.id = r.created_by""",
                                     "replies", "queries", "users"))
def q_query_replies(spark, d):
    fx = Fixture(spark, d)
    return crm.query_replies(fx.queries(), fx.replies(), fx.users())


@register("customer_reviews", with_views("""
SELECT r.id, r.customer_id, r.rating, repeat('★', r.rating) AS stars, r.review, u.name AS created_by_name
FROM reviews r JOIN users u ON u.id = r.created_by""", "reviews", "users"))
def q_reviews(spark, d):
    fx = Fixture(spark, d)
    return crm.customer_reviews(fx.reviews(), fx.users())


# The given tables have no times for questions and reviews: these take a minute of some
# weeks from their id, every eleventh has none, and fifty customers share them.
_ASKERS = 50
_MINUTE = "id * 7919 % 50000"
_AT_SPARK = (f"CASE WHEN id % 11 <> 0 THEN timestamp_ntz '2001-01-01 00:00:00' + make_dt_interval(0, 0, CAST({_MINUTE} AS INT), 0) END")
_AT_SQL = f"CASE WHEN id % 11 <> 0 THEN TIMESTAMP '2001-01-01 00:00:00' + to_minutes(CAST({_MINUTE} AS BIGINT)) END"


def _timed(df):
    at = F.expr(_AT_SPARK)
    out = df.withColumn("created_at", at).withColumn("customer_id", F.col("customer_id") % _ASKERS)
    return out.withColumn("resolved_at", F.when(F.col("status") == "RESOLVED", F.col("created_at"))) if "status" in df.columns else out


@register("customer_question_list", with_views(f"""
SELECT customer_id % {_ASKERS} AS customer_id,
       ROW_NUMBER() OVER (PARTITION BY customer_id % {_ASKERS} ORDER BY created_at DESC NULLS LAST, id DESC) AS nth,
       id, subject, message, status, priority, created_at, CASE WHEN status = 'RESOLVED' THEN created_at END AS resolved_at,
       (SELECT COUNT(*) FROM replies r WHERE r.query_id = q.id) AS n_replies
FROM (SELECT *, {_AT_SQL} AS created_at FROM queries) q""", "queries", "replies"))
def q_question_list(spark, d):
    fx = Fixture(spark, d)
    return crm.customer_question_list(_timed(fx.queries()), fx.replies())


@register("customer_review_list", with_views(f"""
SELECT customer_id % {_ASKERS} AS customer_id,
       ROW_NUMBER() OVER (PARTITION BY customer_id % {_ASKERS} ORDER BY created_at DESC NULLS LAST, r.id DESC) AS nth,
       r.id, rating, review, created_at, u.name AS created_by_name
FROM (SELECT *, {_AT_SQL} AS created_at FROM reviews) r JOIN users u ON u.id = r.created_by""", "reviews", "users"))
def q_review_list(spark, d):
    fx = Fixture(spark, d)
    return crm.customer_review_list(_timed(fx.reviews()), fx.users())


@register("open_queries", with_views("SELECT * FROM queries WHERE status <> 'RESOLVED'", "queries"))
def q_open_queries(spark, d):
    return crm.open_queries(Fixture(spark, d).queries())


_CUST = ("id, customer_name, business_name, mobile, email, gst_number, customer_type, status, follow_up_date")


@register("followups_due", with_views(f"""
SELECT {_CUST} FROM customers WHERE follow_up_date IS NOT NULL
  AND follow_up_date BETWEEN {AS_OF_SQL} AND {AS_OF_SQL} + INTERVAL 7 DAY""", "customers"))
def q_followups_due(spark, d):
    return crm.followups_due(Fixture(spark, d).customers(), AS_OF).select(*[c.strip() for c in _CUST.split(",")])


@register("upcoming_followups", with_views(f"""
SELECT id, customer_name, business_name, follow_up_date, status FROM customers
WHERE follow_up_date IS NOT NULL AND follow_up_date >= {AS_OF_SQL}
ORDER BY follow_up_date ASC, id ASC LIMIT 5""", "customers"))
def q_upcoming(spark, d):
    return crm.upcoming_followups(Fixture(spark, d).customers(), AS_OF)


@register("dashboard_metrics", with_views("""
SELECT (SELECT COUNT(*) FROM customers) AS total_customers, (SELECT COUNT(*) FROM products_stock) AS total_products,
       (SELECT CAST(COUNT(*) AS BIGINT) FROM products_stock WHERE is_low_stock) AS low_stock_count""",
                                         "customers", "products_stock"))
def q_dashboard(spark, d):
    fx = Fixture(spark, d)
    ps = inv.products_with_stock(fx.products(), inv.stock_levels(fx.movements()))
    return crm.dashboard_metrics(fx.customers(), ps)


# Oracle of the request list: names and stock are looked up per request.
_ASKED = ("asked", """SELECT r.*, w.product_name, w.sku, w.current_stock,
    (SELECT s_name FROM supplier WHERE s_suppkey = r.requested_by) AS requested_by_name,
    (SELECT s_name FROM supplier WHERE s_suppkey = r.reviewed_by) AS reviewed_by_name
    FROM products_stock w INNER JOIN stock_requests r ON w.id = r.product_id""")
_REQ_COLUMNS = ("id, status, urgency, quantity, message, created_at, product_id, sku, product_name, current_stock, "
                "requested_by_name, reviewed_by_name")


def _requests(rest: str) -> str:
    return with_views(f"SELECT {_REQ_COLUMNS} FROM asked WHERE requested_by_name IS NOT NULL {rest}",
                      "stock_requests", "products_stock", extra=[_ASKED])


@register("stock_requests_list", _requests(""))
def q_requests_list(spark, d):
    fx = Fixture(spark, d)
    ps = inv.products_with_stock(fx.products(), inv.stock_levels(fx.movements()))
    return rq.stock_requests_list(fx.stock_requests(), ps, fx.users())


@register("stock_requests_visible", _requests(f"AND requested_by = {VISIBLE_USER}"))
def q_requests_visible(spark, d):
    fx = Fixture(spark, d)
    ps = inv.products_with_stock(fx.products(), inv.stock_levels(fx.movements()))
    return rq.stock_requests_list(fx.stock_requests(), ps, fx.users(), role=VISIBLE_ROLE, user_id=VISIBLE_USER)


@register("warehouse_queue", with_views("""
SELECT CAST(p AS BIGINT) AS pending_requests, CAST(l AS BIGINT) AS low_stock_items,
       CAST(p + l AS BIGINT) AS warehouse_tasks
FROM (SELECT (SELECT COUNT(*) FROM stock_requests WHERE status = 'PENDING') AS p,
             (SELECT COUNT(*) FROM products_stock WHERE is_low_stock) AS l)""", "stock_requests", "products_stock"))
def q_warehouse_queue(spark, d):
    fx = Fixture(spark, d)
    ps = inv.products_with_stock(fx.products(), inv.stock_levels(fx.movements()))
    return rq.warehouse_queue(fx.stock_requests(), ps)


@register("pending_requests_top5", _requests("""AND status = 'PENDING'
QUALIFY ROW_NUMBER() OVER (ORDER BY created_at DESC, id DESC) <= 5"""))
def q_pending_top5(spark, d):
    # The warehouse view's first five pending requests, newest first.
    fx = Fixture(spark, d)
    ps = inv.products_with_stock(fx.products(), inv.stock_levels(fx.movements()))
    return rq.pending_top(rq.stock_requests_list(fx.stock_requests(), ps, fx.users(), status="PENDING"), 5)
