"""Registered list / search / export keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import inventory as inv
from ledgerloom.operators import listing as ls
from ledgerloom.plans.oracle import with_views
from ledgerloom.plans.registry import register
from ledgerloom.sources.fixtures import Fixture

# Fixed request parameters of the registered list keys.
CHALLAN_TERM = "  building "      # trimmed, case-insensitive; hits the business name
PRODUCT_TERM = "Gear"
CUSTOMER_TERM = "Machinery"
PAGE_NO, PAGE_SIZE = 3, 20
LOOKUP_ID = 42

_LIST_SQL = """SELECT c.id, c.challan_number, CAST(COALESCE(t.total_quantity, 0) AS BIGINT) AS total_quantity,
       c.status, c.created_at, cu.customer_name, cu.business_name, u.name AS created_by_name
FROM challans c JOIN customers cu ON cu.id = c.customer_id JOIN users u ON u.id = c.created_by
LEFT JOIN (SELECT l_orderkey AS challan_id, SUM(CAST(l_quantity AS INTEGER)) AS total_quantity
           FROM lineitem GROUP BY l_orderkey) t ON t.challan_id = c.id"""


def _ci(col: str, term: str) -> str:
    return f"contains(lower(strip_accents({col})), lower(strip_accents('{term.strip()}')))"


def _challan_match(term: str) -> str:
    return "(" + " OR ".join(_ci(c, term) for c in ls.CHALLAN_SEARCH) + ")"


def challan_rows(fx: Fixture):
    return ls.challan_list(fx.challans(), fx.customers(), fx.users(), fx.raw_lines())


def challan_heads(fx: Fixture):
    return ls.challan_heads(fx.challans(), fx.customers(), fx.users())


@register("challan_list", with_views(_LIST_SQL, "challans", "customers", "users"))
def q_challan_list(spark, d):
    return challan_rows(Fixture(spark, d))


@register("challan_search", with_views(f"SELECT * FROM ({_LIST_SQL}) WHERE {_challan_match(CHALLAN_TERM)}",
                                       "challans", "customers", "users"))
def q_challan_search(spark, d):
    fx = Fixture(spark, d)
    return ls.with_units(ls.search_heads(fx.challans(), fx.customers(), fx.users(), CHALLAN_TERM), fx.raw_lines())


@register("challan_search_count", with_views(f"""
SELECT COUNT(*) AS total FROM challans c JOIN customers cu ON cu.id = c.customer_id
WHERE {_challan_match(CHALLAN_TERM).replace('challan_number', 'c.challan_number')}""", "challans", "customers"))
def q_challan_search_count(spark, d):
    fx = Fixture(spark, d)
    cu = fx.customers().select("id", "customer_name", "business_name").withColumnRenamed("id", "customer_id")
    rows = fx.challans().join(cu, "customer_id", "inner")
    return ls.count_rows(ls.filter_challans(rows, CHALLAN_TERM))


@register("challans_by_status", with_views(f"SELECT * FROM ({_LIST_SQL}) WHERE status = 'DRAFT'",
                                           "challans", "customers", "users"))
def q_challans_by_status(spark, d):
    fx = Fixture(spark, d)
    return ls.with_units(ls.filter_challans(challan_heads(fx), None, "DRAFT"), fx.raw_lines())


@register("challan_page", with_views(f"""
SELECT * FROM ({_LIST_SQL}) ORDER BY created_at DESC NULLS LAST, id DESC
LIMIT {PAGE_SIZE} OFFSET {(PAGE_NO - 1) * PAGE_SIZE}""", "challans", "customers", "users"))
def q_challan_page(spark, d):
    fx = Fixture(spark, d)
    return ls.page_with_units(ls.page(challan_heads(fx), PAGE_NO, PAGE_SIZE), fx.raw_lines())


_PRODUCT_COLS = ("id, product_name, sku, category, unit_price, minimum_stock_alert_quantity, warehouse_location, "
                 "current_stock, is_low_stock, CASE WHEN is_low_stock THEN 'Low stock' ELSE 'Healthy' END AS stock_status")


@register("product_search", with_views(f"""
SELECT {_PRODUCT_COLS} FROM products_stock
WHERE {' OR '.join(_ci(c, PRODUCT_TERM) for c in ls.PRODUCT_SEARCH)}""", "products_stock"))
def q_product_search(spark, d):
    fx = Fixture(spark, d)
    ps = inv.products_with_stock(fx.products(), inv.stock_levels(fx.movements()))
    return ls.search_products(ps, PRODUCT_TERM)


_CUSTOMER_COLS = ("id, customer_name, business_name, mobile, email, gst_number, customer_type, status, "
                  "follow_up_date")


@register("customer_search", with_views(f"""
SELECT {_CUSTOMER_COLS}, COALESCE(strftime(follow_up_date, '%Y-%m-%d'), 'Not set') AS follow_up_label
FROM customers
WHERE {' OR '.join(_ci(c, CUSTOMER_TERM) for c in ls.CUSTOMER_SEARCH)}""", "customers"))
def q_customer_search(spark, d):
    return ls.search_customers(Fixture(spark, d).customers(), CUSTOMER_TERM)


@register("customer_by_id", with_views(f"SELECT {_CUSTOMER_COLS} FROM customers WHERE id = {LOOKUP_ID}",
                                       "customers"))
def q_customer_by_id(spark, d):
    return ls.by_id(Fixture(spark, d).customers(), LOOKUP_ID)


@register("recent_challans", with_views("""
SELECT c.id, c.challan_number, c.status, c.created_at, cu.customer_name
FROM challans c JOIN customers cu ON cu.id = c.customer_id
ORDER BY c.created_at DESC NULLS LAST, c.id DESC LIMIT 5""", "challans", "customers"))
def q_recent_challans(spark, d):
    fx = Fixture(spark, d)
    return ls.recent_challans(fx.challans(), fx.customers(), 5)


# Sign-in by an address written in another case; the given names are one word, so every
# third user is called by their role as well.
SIGN_IN = "USER7@Example.TEST"
_CALLED = "CASE WHEN id % 3 = 0 THEN lower(role) || ' ' || name WHEN id % 11 = 1 THEN '' ELSE name END"


@register("user_by_email", with_views(f"SELECT * FROM users WHERE lower(email) = lower('{SIGN_IN}')", "users"))
def q_user_by_email(spark, d):
    return ls.user_by_email(Fixture(spark, d).users(), SIGN_IN)


@register("user_badges", with_views("""
SELECT id, name, role, string_split(name, ' ')[1] AS first_name, left(name, 1) AS initial FROM called""", "users",
                                    extra=[("called", f"SELECT id, {_CALLED} AS name, role FROM users")]))
def q_user_badges(spark, d):
    return ls.user_badges(Fixture(spark, d).users().withColumn("name", F.expr(_CALLED)))


def _safe(expr: str) -> str:
    return (f"CASE WHEN regexp_matches(COALESCE(CAST({expr} AS VARCHAR), ''), '^[=+\\-@\\t\\r]') "
            f"THEN '''' || COALESCE(CAST({expr} AS VARCHAR), '') ELSE COALESCE(CAST({expr} AS VARCHAR), '') END")


@register("challan_export", with_views(f"""
SELECT {_safe('challan_number')} AS challan, {_safe('customer_name')} AS customer,
       {_safe('business_name')} AS business, {_safe('status')} AS status, {_safe('total_quantity')} AS units,
       {_safe("strftime(created_at, '%Y-%m-%d %H:%M:%S')")} AS created, {_safe('created_by_name')} AS created_by
FROM ({_LIST_SQL}) ORDER BY created_at DESC NULLS LAST, id DESC""", "challans", "customers", "users"))
def q_challan_export(spark, d):
    return ls.challan_export(challan_rows(Fixture(spark, d)))


@register("challan_page_keyset", with_views(f"""
SELECT * FROM ({_LIST_SQL}) l
WHERE (l.created_at, l.id) < (SELECT (created_at, id) FROM ({_LIST_SQL}) ORDER BY created_at DESC NULLS LAST, id DESC
                              LIMIT 1 OFFSET {(PAGE_NO - 1) * PAGE_SIZE - 1})
ORDER BY created_at DESC NULLS LAST, id DESC LIMIT {PAGE_SIZE}""", "challans", "customers", "users"))
def q_challan_page_keyset(spark, d):
    # The same page as ``challan_page``, reached by seeking past the last row of the
    # previous page, which the caller of that page holds.
    fx = Fixture(spark, d)
    heads = challan_heads(fx)
    last = ls.page(heads, PAGE_NO - 1, PAGE_SIZE).orderBy("created_at", "id").first()
    found = ls.keyset_page(heads, (last.created_at, last.id) if last else None, PAGE_SIZE)
    return ls.page_with_units(found, fx.raw_lines())
