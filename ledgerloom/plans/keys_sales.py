"""Registered sales keys."""

from __future__ import annotations

from ledgerloom.config import AS_OF, DAY_BAR_FLOOR_BP, SELLER_BAR_FLOOR_BP
from ledgerloom.operators import sales
from ledgerloom.plans.oracle import WINDOW_30, with_views
from ledgerloom.plans.registry import register
from ledgerloom.plans.render import nested_sql, render_array
from ledgerloom.sources.fixtures import Fixture

DAYS = 30

# The oracles start from the given tables and build up: one row per order in the
# window with its worth (only orders with lines of known parts), then a report of
# it. The window starts 30 days before the reporting date.
_LINE_WORTH = """SELECT l_orderkey AS order_no, l_linenumber AS line, p_name AS product, l_partkey AS part,
    CAST(l_quantity AS INTEGER) AS pieces, CAST(p_retailprice AS DECIMAL(12,2)) AS price
    FROM part INNER JOIN lineitem ON p_partkey = l_partkey"""
_SOLD = f"""SELECT o_orderkey AS order_no, o_custkey AS buyer, o_orderkey % (SELECT COUNT(*) FROM supplier) AS seller,
    o_orderdate AS sold_at, CAST(o_orderdate AS DATE) AS sold_on
    FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= {WINDOW_30}"""
_WORTH = """SELECT sold.order_no, any_value(seller) AS seller, any_value(sold_on) AS sold_on,
    SUM(pieces * price) AS worth, SUM(pieces) AS pieces FROM sold INNER JOIN line_worth USING (order_no) GROUP BY sold.order_no"""
_CTES = [("line_worth", _LINE_WORTH), ("sold", _SOLD), ("worth", _WORTH)]
_FIGURES = ("CAST(COUNT(*) AS BIGINT) AS challans, CAST(COALESCE(SUM(worth), 0) AS DECIMAL(18,2)) AS revenue, "
            "CAST(COALESCE(SUM(pieces), 0) AS BIGINT) AS units")
_DAILY = ("daily", f"SELECT sold_on AS sale_date, {_FIGURES} FROM worth GROUP BY ALL")
_SELLERS = ("sellers", f"""SELECT per.seller AS user_id, s_name AS user_name, per.* EXCLUDE (seller)
    FROM (SELECT seller, {_FIGURES} FROM worth GROUP BY ALL) per INNER JOIN supplier ON s_suppkey = per.seller""")

SQL_DAILY = with_views("FROM daily", extra=[*_CTES, _DAILY])
SQL_BY_SELLER = with_views("FROM sellers", extra=[*_CTES, _SELLERS])
SQL_PERIOD_TOTAL = with_views(f"SELECT {DAYS} AS days, {_FIGURES} FROM worth", extra=_CTES)

_NAMED = ("named", """SELECT sold_on AS sale_date, sold_at AS confirmed_at, printf('CH-%d-%05d', year(sold_at), order_no) AS challan_number,
    seller AS user_id, s_name AS seller_name, c_name AS customer_name, c_name || ' ' || c_mktsegment AS business_name,
    product AS product_name, 'SKU-' || part AS sku, pieces AS quantity, price AS unit_price,
    CAST(pieces * price AS DECIMAL(18,2)) AS revenue
    FROM line_worth INNER JOIN sold USING (order_no) INNER JOIN supplier ON s_suppkey = seller
    INNER JOIN customer ON c_custkey = buyer""")
SQL_DETAIL = with_views("SELECT * EXCLUDE (confirmed_at, user_id) FROM named", extra=[*_CTES, _NAMED])


def _share(report: tuple[str, str], floor_bp: int) -> str:
    """Revenue in basis points of the largest (of one unit of money at least), not under the floor."""
    cents = "CAST(revenue * 100 AS BIGINT)"
    top = ("top", f"SELECT GREATEST(100, COALESCE(MAX({cents}), 0)) AS most FROM {report[0]}")
    return with_views(f"SELECT r.*, GREATEST({floor_bp}, {cents} * 10000 // most) AS bar_bp FROM {report[0]} r, top",
                      extra=[*_CTES, report, top])


SQL_SELLER_SHARE = _share(_SELLERS, SELLER_BAR_FLOOR_BP)
SQL_DAY_SHARE = _share(_DAILY, DAY_BAR_FLOOR_BP)

_DAY_ORDER = "confirmed_at, challan_number, product_name, sku, quantity, revenue"
_DAY_FIELDS = ["challan_number", "seller_name", "customer_name", "product_name", "sku", "quantity", "revenue"]
SQL_DAY_LINES = with_views(nested_sql("named", "sale_date", _DAY_ORDER, _DAY_FIELDS, "lines"),
                           extra=[*_CTES, _NAMED])

_SELLER_ORDER = "sale_date, confirmed_at, challan_number, product_name, sku, quantity, revenue"
_SELLER_FIELDS = ["sale_date", "challan_number", "customer_name", "product_name", "sku", "quantity", "revenue"]
SQL_SELLER_LINES = with_views(nested_sql("named", "user_id", _SELLER_ORDER, _SELLER_FIELDS, "lines"),
                              extra=[*_CTES, _NAMED])

SQL_DOC_TOTALS = with_views("""
SELECT o_orderkey AS challan_id, CAST(COUNT(line) AS BIGINT) AS lines, CAST(COALESCE(SUM(pieces), 0) AS BIGINT) AS total_units,
       CAST(COALESCE(SUM(pieces * price), 0) AS DECIMAL(18,2)) AS total_value
FROM orders LEFT JOIN line_worth ON order_no = o_orderkey GROUP BY o_orderkey""", extra=[("line_worth", _LINE_WORTH)])

_DOC_FIELDS = ["product_id", "product_name_snapshot", "sku_snapshot", "unit_price_snapshot", "quantity", "line_total"]
_it = "SELECT *, CAST(quantity * unit_price_snapshot AS DECIMAL(18,2)) AS line_total FROM items"
SQL_DOCUMENT = with_views("""
SELECT c.id AS challan_id, c.challan_number, c.status, c.created_at, c.confirmed_at, c.customer_id,
       cu.customer_name, cu.business_name, u.name AS created_by_name, COALESCE(n.chunk_no, 0) AS chunk_no,
       COALESCE(n.n_items, 0) AS n_items, COALESCE(n.items_text, '') AS items_text
FROM challans c JOIN customers cu ON cu.id = c.customer_id JOIN users u ON u.id = c.created_by
LEFT JOIN nested n ON n.challan_id = c.id""", "challans", "customers", "users", "items",
    extra=[("it", _it), ("nested", nested_sql("it", "challan_id", "product_name_snapshot, sku_snapshot, quantity, line_no",
                                              _DOC_FIELDS, "items"))])


@register("sales_daily", SQL_DAILY)
def q_sales_daily(spark, d):
    fx = Fixture(spark, d)
    return sales.sales_daily(fx.challans(), fx.items(), AS_OF, DAYS)


@register("sales_by_seller", SQL_BY_SELLER)
def q_sales_by_seller(spark, d):
    fx = Fixture(spark, d)
    return sales.sales_by_seller(fx.challans(), fx.items(), fx.users(), AS_OF, DAYS)


@register("sales_detail", SQL_DETAIL)
def q_sales_detail(spark, d):
    fx = Fixture(spark, d)
    return sales.sales_detail(fx.challans(), fx.items(), fx.users(), fx.customers(), AS_OF, DAYS)


@register("sales_period_total", SQL_PERIOD_TOTAL)
def q_sales_period_total(spark, d):
    fx = Fixture(spark, d)
    return sales.sales_period_total(fx.challans(), fx.items(), AS_OF, DAYS)


@register("sales_overview", with_views(f"""
SELECT 'day' AS report, sold_on AS sale_date, CAST(NULL AS BIGINT) AS user_id, {_FIGURES} FROM worth GROUP BY sold_on
UNION ALL SELECT 'seller', NULL, seller, {_FIGURES} FROM worth GROUP BY seller
UNION ALL SELECT 'total', NULL, NULL, {_FIGURES} FROM worth""", extra=_CTES))
def q_sales_overview(spark, d):
    fx = Fixture(spark, d)
    return sales.sales_overview(fx.challans(), fx.items(), AS_OF, DAYS)


@register("seller_share_of_max", SQL_SELLER_SHARE)
def q_seller_share(spark, d):
    fx = Fixture(spark, d)
    return sales.seller_share_of_max(fx.challans(), fx.items(), fx.users(), AS_OF, DAYS)


@register("day_share_of_max", SQL_DAY_SHARE)
def q_day_share(spark, d):
    fx = Fixture(spark, d)
    return sales.day_share_of_max(fx.challans(), fx.items(), AS_OF, DAYS)


@register("sales_day_lines", SQL_DAY_LINES)
def q_day_lines(spark, d):
    fx = Fixture(spark, d)
    df = sales.sales_day_lines(fx.challans(), fx.items(), fx.users(), fx.customers(), AS_OF, DAYS)
    return render_array(df, ["sale_date", "chunk_no"], "lines", _DAY_FIELDS)


@register("sales_seller_lines", SQL_SELLER_LINES)
def q_seller_lines(spark, d):
    fx = Fixture(spark, d)
    df = sales.sales_seller_lines(fx.challans(), fx.items(), fx.users(), fx.customers(), AS_OF, DAYS)
    return render_array(df, ["user_id", "chunk_no"], "lines", _SELLER_FIELDS)


@register("challan_document_totals", SQL_DOC_TOTALS)
def q_doc_totals(spark, d):
    fx = Fixture(spark, d)
    return sales.challan_document_totals(fx.challans(), fx.items())


@register("challan_document", SQL_DOCUMENT)
def q_document(spark, d):
    fx = Fixture(spark, d)
    df = sales.challan_document(fx.challans(), fx.items(), fx.customers(), fx.users())
    keep = ["challan_id", "challan_number", "status", "created_at", "confirmed_at", "customer_id",
            "customer_name", "business_name", "created_by_name", "chunk_no"]
    return render_array(df, keep, "items", _DOC_FIELDS)

