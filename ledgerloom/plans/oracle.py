"""DuckDB oracle SQL, one statement per registered key.

The domain views are the FIXTURES.md §2 mapping written in plain SQL (the
same expressions as ``sources/fixtures.py``). Each statement is the
straightforward relational form of the report — e.g. ``COUNT(DISTINCT …)``
over the line-level join — so it checks the Spark plan's reformulations
(per-challan pre-aggregation, split windows) rather than mirroring them.
"""

from __future__ import annotations

from ledgerloom.config import AS_OF_SQL, OPENING_STOCK_REASON

N_SUP = "(SELECT COUNT(*) FROM supplier)"
N_CUST = "(SELECT COUNT(*) FROM customer)"
N_PART = "(SELECT COUNT(*) FROM part)"

VIEWS: dict[str, str] = {
    "users": f"""SELECT s_suppkey AS id, s_name AS name, 'user' || s_suppkey || '@example.test' AS email,
        CASE s_suppkey % 4 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'SALES' WHEN 2 THEN 'WAREHOUSE' ELSE 'ACCOUNTS' END AS role
        FROM supplier""",
    "customers": f"""SELECT c_custkey AS id, c_name AS customer_name, c_name || ' ' || c_mktsegment AS business_name,
        '+91' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS mobile, CAST(NULL AS VARCHAR) AS email, CAST(NULL AS VARCHAR) AS gst_number,
        CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'WHOLESALE'
             WHEN c_mktsegment = 'HOUSEHOLD' THEN 'RETAIL' ELSE 'DISTRIBUTOR' END AS customer_type,
        CASE WHEN c_acctbal < 0 THEN 'INACTIVE' WHEN c_acctbal < 1000 THEN 'LEAD' ELSE 'ACTIVE' END AS status,
        CASE WHEN c_custkey % 7 = 0 THEN NULL
             ELSE {AS_OF_SQL} + CAST(c_custkey % 30 - 10 AS INTEGER) END AS follow_up_date,
        c_nationkey
        FROM customer""",
    "products": """SELECT p_partkey AS id, p_name AS product_name, 'SKU-' || p_partkey AS sku, p_type AS category,
        CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price, p_size * 10 AS minimum_stock_alert_quantity,
        p_brand AS warehouse_location
        FROM part""",
    "movements": f"""SELECT p_partkey AS product_id, 400 AS quantity_changed, 'IN' AS movement_type,
            '{OPENING_STOCK_REASON}' AS reason, 'OPENING_STOCK' AS reference_type,
            CAST(NULL AS BIGINT) AS reference_id, CAST(0 AS BIGINT) AS created_by,
            TIMESTAMP '1995-01-01 00:00:00' AS created_at
        FROM part
        UNION ALL
        SELECT l_partkey, CAST(l_quantity AS INTEGER), CASE WHEN l_returnflag = 'N' THEN 'OUT' ELSE 'IN' END,
            'Order ' || l_orderkey || ' line ' || l_linenumber,
            CASE WHEN l_returnflag = 'N' THEN 'CHALLAN' ELSE 'MANUAL_ADJUSTMENT' END,
            l_orderkey, l_suppkey, l_shipdate
        FROM lineitem""",
    "challans": f"""SELECT o_orderkey AS id, printf('CH-%d-%05d', year(o_orderdate), o_orderkey) AS challan_number,
        o_custkey AS customer_id, o_orderkey % {N_SUP} AS created_by,
        CASE o_orderstatus WHEN 'F' THEN 'CONFIRMED' WHEN 'O' THEN 'DRAFT' WHEN 'P' THEN 'CANCELLED' END AS status,
        o_orderdate AS created_at,
        CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS confirmed_at,
        CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS cancelled_at
        FROM orders""",
    "items": """SELECT l_orderkey AS challan_id, l_linenumber AS line_no, l_partkey AS product_id,
        p_name AS product_name_snapshot, 'SKU-' || l_partkey AS sku_snapshot,
        CAST(p_retailprice AS DECIMAL(12,2)) AS unit_price_snapshot, CAST(l_quantity AS INTEGER) AS quantity
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "queries": f"""SELECT conv_id AS id, conv_id AS customer_id, string_split(message, chr(10))[1] AS subject, message,
        CASE WHEN conv_id % 5 = 0 THEN 'RESOLVED' WHEN last_role = 'user' THEN 'OPEN' ELSE 'IN_PROGRESS' END AS status,
        CASE conv_id % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS priority,
        conv_id % {N_SUP} AS created_by
        FROM (SELECT conv_id, arg_min(text, turn) FILTER (WHERE role = 'user') AS message,
                     arg_max(role, turn) AS last_role
              FROM conversations GROUP BY conv_id)""",
    "replies": f"""SELECT conv_id AS query_id, turn, text AS message, (conv_id + turn) % {N_SUP} AS created_by
        FROM conversations WHERE role = 'assistant'""",
    "reviews": f"""SELECT d.doc_id AS id, d.doc_id % {N_CUST} AS customer_id, CAST(1 + d.doc_id % 5 AS INTEGER) AS rating,
        d.text AS review, d.doc_id % {N_SUP} AS created_by
        FROM documents d""",
    "follow_ups": f"""SELECT event_id AS id, user_id % {N_CUST} AS customer_id, event_type AS note,
        CAST(NULL AS DATE) AS follow_up_date, user_id % {N_SUP} AS created_by, ts AS created_at
        FROM events WHERE event_type IN ('view', 'click')""",
    "stock_requests": f"""SELECT event_id AS id, event_id % {N_PART} AS product_id, user_id % {N_SUP} AS requested_by,
        CAST(1 + event_id % 50 AS INTEGER) AS quantity,
        CASE user_id % 3 WHEN 0 THEN 'LOW' WHEN 1 THEN 'MEDIUM' ELSE 'HIGH' END AS urgency,
        props AS message,
        CASE event_id % 3 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'APPROVED' ELSE 'REJECTED' END AS status,
        CASE WHEN event_id % 3 = 0 THEN NULL ELSE (user_id + 1) % {N_SUP} END AS reviewed_by,
        ts AS created_at
        FROM events WHERE event_type IN ('error', 'signup')""",
}

# Derived views used by several statements.
VIEWS["stock"] = """SELECT product_id, CAST(SUM(CASE WHEN movement_type = 'IN' THEN quantity_changed
                                                ELSE -quantity_changed END) AS BIGINT) AS current_stock
        FROM movements GROUP BY product_id"""
VIEWS["products_stock"] = """SELECT p.*, COALESCE(s.current_stock, 0) AS current_stock,
        COALESCE(s.current_stock, 0) <= p.minimum_stock_alert_quantity AS is_low_stock
        FROM products p LEFT JOIN stock s ON s.product_id = p.id"""

_DEPS = {
    "stock": ["movements"],
    "products_stock": ["products", "stock"],
}


def with_views(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the CTEs it names (dependencies first), then ``extra`` CTEs."""
    ordered: list[str] = []

    def add(n: str) -> None:
        for dep in _DEPS.get(n, []):
            add(dep)
        if n not in ordered:
            ordered.append(n)

    for n in names:
        add(n)
    parts = [(n, VIEWS[n]) for n in ordered] + list(extra or [])
    ctes = ",\n".join(f"{n} AS ({q})" for n, q in parts)
    return f"WITH {ctes}\n{body}"


WINDOW_30 = f"{AS_OF_SQL} - INTERVAL 30 DAY"
