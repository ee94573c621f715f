"""Registered data-quality keys."""

from __future__ import annotations

from ledgerloom.config import (CAPABILITY_MATRIX, CRM_RULES, CUSTOMER_RULES, PRICE_MAX, PRODUCT_RULES,
                               REASON_RULE, REQUEST_MESSAGE_RULE, REQUEST_QTY_MAX, ROLES)
from ledgerloom.operators import inventory as inv
from ledgerloom.operators import quality as dq
from ledgerloom.plans.oracle import with_views
from ledgerloom.plans.registry import register
from ledgerloom.sources.fixtures import Fixture


# -- SQL side: each rule is one SELECT, unioned -------------------------------------
def _len_sql(c: str, lo: int, hi: int, optional: bool = False) -> str:
    core = f"length(trim({c})) < {lo} OR length(trim({c})) > {hi}"
    return f"COALESCE({core}, FALSE)" if optional else f"({c} IS NULL OR {core})"


def _rules_sql(source: str, table: str, key: str, rules: list[tuple[str, str]]) -> str:
    return "\nUNION ALL\n".join(
        f"SELECT '{table}' AS table_name, CAST({key} AS BIGINT) AS record_id, '{name}' AS rule "
        f"FROM {source} WHERE COALESCE({cond}, FALSE)" for name, cond in rules)


def _enum_sql(c: str, values) -> str:
    vals = ", ".join(f"'{v}'" for v in values)
    return f"NOT COALESCE({c} IN ({vals}), FALSE)"


_CUST_SRC = ("(SELECT c.*, n.n_name AS address FROM customers c "
             "LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey)")
SQL_DQ_CUSTOMERS = with_views(_rules_sql(_CUST_SRC, "customers", "id", [
    *[(f"{c}_length", _len_sql(c, lo, hi, optional=(c == "gst_number"))) for c, (lo, hi) in CUSTOMER_RULES.items()],
    ("email_format", f"email IS NOT NULL AND NOT regexp_matches(email, '{dq.EMAIL_PATTERN}')"),
    ("customer_type_enum", _enum_sql("customer_type", ["RETAIL", "WHOLESALE", "DISTRIBUTOR"])),
    ("status_enum", _enum_sql("status", ["LEAD", "ACTIVE", "INACTIVE"])),
]), "customers")

SQL_DQ_PRODUCTS = with_views(_rules_sql("products_stock", "products", "id", [
    *[(f"{c}_length", _len_sql(c, lo, hi)) for c, (lo, hi) in PRODUCT_RULES.items()],
    ("unit_price_range", f"unit_price IS NULL OR unit_price < 0 OR unit_price > {PRICE_MAX}"),
    ("current_stock_negative", "current_stock < 0"),
    ("minimum_negative", "minimum_stock_alert_quantity IS NULL OR minimum_stock_alert_quantity < 0"),
]), "products_stock")

SQL_DQ_MOVEMENTS = with_views(_rules_sql("movements", "stock_movements", "product_id", [
    ("quantity_not_positive", "quantity_changed IS NULL OR quantity_changed <= 0"),
    ("movement_type_enum", _enum_sql("movement_type", ["IN", "OUT"])),
    ("reason_length", _len_sql("reason", *REASON_RULE)),
]), "movements")

_LINES = "SELECT l_orderkey AS challan_id, l_partkey AS product_id, CAST(l_quantity AS INTEGER) AS quantity FROM lineitem"
SQL_DQ_CHALLANS = with_views("""
SELECT 'challans' AS table_name, c.id AS record_id, 'no_items' AS rule FROM challans c
WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.challan_id = c.id)
UNION ALL
SELECT 'challans', challan_id, 'quantity_not_positive' FROM lines WHERE quantity IS NULL OR quantity <= 0
UNION ALL
SELECT 'challans', challan_id, 'duplicate_product' FROM lines GROUP BY challan_id, product_id HAVING COUNT(*) > 1""",
                             "challans", extra=[("lines", _LINES)])

_R = CRM_RULES
SQL_DQ_CRM = with_views("\nUNION ALL\n".join([
    _rules_sql("follow_ups", "customer_follow_ups", "id", [("note_length", _len_sql("note", *_R["note"]))]),
    _rules_sql("queries", "customer_queries", "id", [
        ("subject_length", _len_sql("subject", *_R["subject"])),
        ("message_length", _len_sql("message", *_R["message"])),
        ("priority_enum", _enum_sql("priority", ["LOW", "MEDIUM", "HIGH"]))]),
    _rules_sql("(SELECT *, query_id * 1000000 + turn AS reply_key FROM replies)", "customer_query_replies",
               "reply_key", [("reply_length", _len_sql("message", *_R["reply"]))]),
    _rules_sql("reviews", "customer_reviews", "id", [
        ("rating_range", "rating IS NULL OR NOT (rating BETWEEN 1 AND 5)"),
        ("review_length", _len_sql("review", *_R["review"]))]),
]), "follow_ups", "queries", "replies", "reviews")

SQL_DQ_REQUESTS = with_views(_rules_sql("stock_requests", "stock_requests", "id", [
    ("quantity_range", f"quantity IS NULL OR NOT (quantity BETWEEN 1 AND {REQUEST_QTY_MAX})"),
    ("urgency_enum", _enum_sql("urgency", ["LOW", "MEDIUM", "HIGH"])),
    ("message_length", _len_sql("message", *REQUEST_MESSAGE_RULE)),
]), "stock_requests")


def _uniq_sql(table: str, source: str, cols: list[str]) -> str:
    key = " || '|' || ".join(f"CAST({c} AS VARCHAR)" for c in cols)
    cs = ", ".join(cols)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in cols)
    return (f"SELECT '{table}' AS table_name, {key} AS key_value, COUNT(*) AS occurrences "
            f"FROM {source} WHERE {complete} GROUP BY {cs} HAVING COUNT(*) > 1")


SQL_DQ_UNIQUE = with_views("\nUNION ALL\n".join([
    _uniq_sql("users", "users", ["email"]),
    _uniq_sql("products", "products", ["sku"]),
    _uniq_sql("challans", "challans", ["challan_number"]),
    _uniq_sql("stock_movements", "movements", ["reference_type", "reference_id", "reason"]),
]), "users", "products", "challans", "movements")

_LINKS = [  # (table, column, child view, parent view)
    ("customer_follow_ups", "customer_id", "follow_ups", "customers"),
    ("customer_follow_ups", "created_by", "follow_ups", "users"),
    ("stock_movements", "product_id", "movements", "products"),
    ("stock_movements", "created_by", "movements", "users"),
    ("challans", "customer_id", "challans", "customers"),
    ("challans", "created_by", "challans", "users"),
    ("challan_items", "challan_id", "lines", "challans"),
    ("challan_items", "product_id", "lines", "products"),
    ("customer_queries", "customer_id", "queries", "customers"),
    ("customer_queries", "created_by", "queries", "users"),
    ("customer_reviews", "customer_id", "reviews", "customers"),
    ("customer_reviews", "created_by", "reviews", "users"),
    ("customer_query_replies", "created_by", "replies", "users"),
    ("customer_query_replies", "query_id", "replies", "queries"),
    ("stock_requests", "product_id", "stock_requests", "products"),
    ("stock_requests", "requested_by", "stock_requests", "users"),
    ("stock_requests", "reviewed_by", "stock_requests", "users"),
]
SQL_DQ_ORPHANS = with_views("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST({c} AS BIGINT) AS missing_id, COUNT(*) AS rows "
    f"FROM {child} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT id FROM {parent}) GROUP BY {c}"
    for t, c, child, parent in _LINKS),
    "follow_ups", "customers", "users", "movements", "products", "challans", "queries", "reviews", "replies",
    "stock_requests", extra=[("lines", _LINES)])


def _fixture_frames(fx: Fixture) -> dict:
    return {"follow_ups": fx.follow_ups(), "customers": fx.customers(), "users": fx.users(),
            "movements": fx.movements(), "products": fx.products(), "challans": fx.challans(),
            "lines": fx.raw_lines(), "queries": fx.queries(), "reviews": fx.reviews(),
            "replies": fx.replies(), "stock_requests": fx.stock_requests()}


@register("dq_customers", SQL_DQ_CUSTOMERS)
def q_dq_customers(spark, d):
    return dq.dq_customers(Fixture(spark, d).customers(with_address=True))


@register("dq_products", SQL_DQ_PRODUCTS)
def q_dq_products(spark, d):
    fx = Fixture(spark, d)
    return dq.dq_products(inv.products_with_stock(fx.products(), inv.stock_levels(fx.movements())))


@register("dq_movements", SQL_DQ_MOVEMENTS)
def q_dq_movements(spark, d):
    return dq.dq_movements(Fixture(spark, d).movements())


@register("dq_challans", SQL_DQ_CHALLANS)
def q_dq_challans(spark, d):
    fx = Fixture(spark, d)
    return dq.dq_challans(fx.challans(), fx.raw_lines())


@register("dq_crm", SQL_DQ_CRM)
def q_dq_crm(spark, d):
    fx = Fixture(spark, d)
    return dq.dq_crm(fx.follow_ups(), fx.queries(), fx.replies(), fx.reviews())


@register("dq_stock_requests", SQL_DQ_REQUESTS)
def q_dq_requests(spark, d):
    return dq.dq_stock_requests(Fixture(spark, d).stock_requests())


@register("dq_unique", SQL_DQ_UNIQUE)
def q_dq_unique(spark, d):
    fx = Fixture(spark, d)
    return dq.dq_unique([("users", fx.users(), ["email"]), ("products", fx.products(), ["sku"]),
                         ("challans", fx.challans(), ["challan_number"]),
                         ("stock_movements", fx.movements(), ["reference_type", "reference_id", "reason"])])


@register("dq_orphans", SQL_DQ_ORPHANS)
def q_dq_orphans(spark, d):
    f = _fixture_frames(Fixture(spark, d))
    return dq.dq_orphans([(t, c, f[child], f[parent]) for t, c, child, parent in _LINKS])


@register("duplicate_challan_products", with_views("""
SELECT challan_id, product_id, COUNT(*) AS occurrences FROM lines GROUP BY challan_id, product_id
HAVING COUNT(*) > 1""", extra=[("lines", _LINES)]))
def q_dup_products(spark, d):
    return dq.duplicate_challan_products(Fixture(spark, d).raw_lines())


@register("items_missing_product", with_views("""
SELECT challan_id, COUNT(*) AS missing_items FROM lines l
WHERE l.product_id IS NULL OR l.product_id NOT IN (SELECT id FROM products) GROUP BY challan_id""",
                                              "products", extra=[("lines", _LINES)]))
def q_missing_product(spark, d):
    fx = Fixture(spark, d)
    return dq.items_missing_product(fx.raw_lines(), fx.products())


CHALLAN_STATES = [
    ("confirmed_without_time", "status = 'CONFIRMED' AND confirmed_at IS NULL"),
    ("cancelled_without_time", "status = 'CANCELLED' AND cancelled_at IS NULL"),
    ("draft_with_decision_time", "status = 'DRAFT' AND (confirmed_at IS NOT NULL OR cancelled_at IS NOT NULL)"),
    ("status_enum", _enum_sql("status", ["DRAFT", "CONFIRMED", "CANCELLED"])),
]


@register("challan_totals_check", with_views(_rules_sql("challans", "challans", "id", CHALLAN_STATES), "challans"))
def q_totals_check(spark, d):
    fx = Fixture(spark, d)
    return dq.challan_totals_check(fx.challans(), fx.raw_lines())


_MATRIX_SQL = "SELECT * FROM (VALUES " + ", ".join(
    "('{}', '{}', {})".format(cap.replace("'", "''"), role, "TRUE" if ok else "FALSE")
    for cap, *flags in CAPABILITY_MATRIX for role, ok in zip(ROLES, flags)) + ") AS m(capability, role, allowed)"


@register("user_capabilities", with_views("""
SELECT u.id AS user_id, u.name AS user_name, u.role, m.capability FROM users u
JOIN matrix m ON m.role = u.role WHERE m.allowed""", "users", extra=[("matrix", _MATRIX_SQL)]))
def q_capabilities(spark, d):
    return dq.user_capabilities(Fixture(spark, d).users(), dq.capability_matrix(spark))
