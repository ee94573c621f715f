"""Registered appends (W1) and updates (W3) with requests that fail in every way.

The requests are the rows of a domain view; some, by their id, break a rule or
name a parent that does not exist.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.config import CRM_RULES, REQUEST_MESSAGE_RULE, REQUEST_QTY_MAX
from ledgerloom.operators import commands as cm
from ledgerloom.operators import quality as dq
from ledgerloom.plans.keys_defects import FAR, _break, _sql, _when
from ledgerloom.plans.keys_quality import _enum_sql, _len_sql
from ledgerloom.plans.oracle import with_views
from ledgerloom.plans.registry import register
from ledgerloom.sources.fixtures import Fixture

# view -> (parent link, defects, (rule, SQL condition)...)
_URGENCY = ["LOW", "MEDIUM", "HIGH"]
REQUESTS = {
    "follow_ups": ("customer_id", "customers", {"note": _when(7, "' '", "note")},
                   [("note_length", _len_sql("note", *CRM_RULES["note"]))]),
    "queries": ("customer_id", "customers", {"subject": _when(7, "''", "subject"), "priority": _when(11, "'SOON'", "priority")},
                [("subject_length", _len_sql("subject", *CRM_RULES["subject"])),
                 ("message_length", _len_sql("message", *CRM_RULES["message"])), ("priority_enum", _enum_sql("priority", _URGENCY))]),
    "reviews": ("customer_id", "customers", {"rating": _when(7, "6", "rating"), "review": _when(11, "'x'", "review")},
                [("rating_range", "rating IS NULL OR NOT (rating BETWEEN 1 AND 5)"),
                 ("review_length", _len_sql("review", *CRM_RULES["review"]))]),
    "stock_requests": ("product_id", "products", {"quantity": _when(7, "0", "quantity"), "message": _when(11, "'x'", "message")},
                       [("quantity_range", f"quantity IS NULL OR NOT (quantity BETWEEN 1 AND {REQUEST_QTY_MAX})"),
                        ("urgency_enum", _enum_sql("urgency", _URGENCY)),
                        ("message_length", _len_sql("message", *REQUEST_MESSAGE_RULE))]),
}


def _defects(view: str) -> dict[str, str]:
    link, _, defects, _ = REQUESTS[view]
    return defects | {link: _when(13, f"{link} + {FAR}", link)}


def _oracle(view: str) -> str:
    link, parent, _, rules = REQUESTS[view]
    broken = ", ".join(f"CASE WHEN {cond} THEN '{name}' END" for name, cond in sorted(rules))
    return with_views(f"""
SELECT id, {link}, CASE WHEN rules <> '' THEN 'invalid' WHEN {link} IN (SELECT id FROM {parent}) THEN 'applied'
       ELSE 'not_found' END AS outcome, rules AS broken_rules
FROM (SELECT *, concat_ws(',', {broken}) AS rules FROM asked)""", view, parent,
                      extra=[("asked", f"SELECT {_sql(_defects(view))} FROM {view}")])


def _append(spark, d, view: str, check):
    link, parent, _, _ = REQUESTS[view]
    fx = Fixture(spark, d)
    asked = _break(getattr(fx, view)(), _defects(view))
    return cm.append_rows(asked, check(asked), getattr(fx, parent)(), link).select("id", link, "outcome", "broken_rules")


def _crm_rules(table: str):
    """The rules of one CRM table, over that table alone."""
    def check(asked):
        none = {"follow_ups": "id bigint, note string", "queries": "id bigint, subject string, message string, priority string",
                "replies": "query_id bigint, turn bigint, message string", "reviews": "id bigint, rating int, review string"}
        frames = {n: asked if n == table else asked.sparkSession.createDataFrame([], s) for n, s in none.items()}
        return dq.dq_crm(**frames)
    return check


@register("append_follow_ups", _oracle("follow_ups"))
def q_follow_ups(spark, d):
    return _append(spark, d, "follow_ups", _crm_rules("follow_ups"))


@register("append_queries", _oracle("queries"))
def q_queries(spark, d):
    return _append(spark, d, "queries", _crm_rules("queries"))


@register("append_reviews", _oracle("reviews"))
def q_reviews(spark, d):
    return _append(spark, d, "reviews", _crm_rules("reviews"))


@register("append_stock_requests", _oracle("stock_requests"))
def q_stock_requests(spark, d):
    return _append(spark, d, "stock_requests", dq.dq_stock_requests)


_NEW_MOBILE = _when(4, "'+92' || id", "mobile")


@register("update_customers", with_views(f"""
SELECT c.id, c.customer_name, c.business_name, CASE WHEN c.id % 3 = 0 THEN {_NEW_MOBILE} ELSE c.mobile END AS mobile, c.email,
       c.gst_number, c.customer_type, CASE WHEN c.id % 3 = 0 THEN 'ACTIVE' ELSE c.status END AS status,
       CASE WHEN c.id % 3 = 0 THEN NULL ELSE c.follow_up_date END AS follow_up_date,
       CASE WHEN c.id % 3 = 0 THEN 'applied' ELSE 'unchanged' END AS outcome FROM customers c
UNION ALL SELECT id + {FAR}, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'not_found' FROM customers WHERE id % 50 = 0""",
                                         "customers"))
def q_update_customers(spark, d):
    """Every third customer becomes active and loses its follow-up date; some updates name nobody."""
    c = Fixture(spark, d).customers()
    new = c.where(F.col("id") % 3 == 0).select("id", F.expr(_NEW_MOBILE).alias("mobile"), F.lit("ACTIVE").alias("status"),
                                               F.lit(None).cast("date").alias("follow_up_date"))
    nobody = c.where(F.col("id") % 50 == 0).select(F.col("id") + FAR, "mobile", "status", "follow_up_date")
    return cm.update_customers(c, new.union(nobody))


@register("delete_products", with_views("""
SELECT challan_id, line_no, quantity, CASE WHEN product_id % 5 <> 0 THEN product_id END AS product_id, product_name_snapshot
FROM items""", "items"))
def q_delete_products(spark, d):
    """Items keep their snapshot when their product goes."""
    fx = Fixture(spark, d)
    out = cm.delete_products(fx.items(), fx.products().where(F.col("id") % 5 == 0))
    return out.select("challan_id", "line_no", "quantity", "product_id", "product_name_snapshot")


@register("approval_movements", with_views("""
SELECT product_id, quantity AS quantity_changed, 'IN' AS movement_type, 'Approved stock request ' || id AS reason,
       'STOCK_REQUEST' AS reference_type, id AS reference_id, CAST(2 AS BIGINT) AS created_by,
       TIMESTAMP '2001-08-01 00:00:00' AS created_at
FROM stock_requests WHERE urgency = 'HIGH' AND status = 'PENDING'""", "stock_requests"))
def q_approval_movements(spark, d):
    """The ledger rows of the approved requests."""
    from ledgerloom.plans.keys_commands import NOW, REVIEWER, _review
    return cm.approval_movements(_review(spark, d, "HIGH", "approve"), REVIEWER, NOW)
