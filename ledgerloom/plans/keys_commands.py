"""Registered command-job keys.

Command batches are derived from the given tables (for example: cancel every
challan of an inactive customer; replay conversation turns as reply/resolve
commands), so their size grows with the data.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.config import AS_OF
from ledgerloom.functions.ordered import positions
from ledgerloom.operators import allocation as alloc
from ledgerloom.operators import commands as cm
from ledgerloom.operators import inventory as inv
from ledgerloom.plans.oracle import with_views
from ledgerloom.plans.registry import register
from ledgerloom.sources.fixtures import Fixture
from ledgerloom.functions.text import wall_time

NOW = dt.datetime.combine(AS_OF, dt.time())
NOW_SQL = "TIMESTAMP '2001-08-01 00:00:00'"
REVIEWER = 2                     # a WAREHOUSE user
ADJUST_FROM = NOW + dt.timedelta(days=1)

_LINES = ("SELECT l_orderkey AS challan_id, l_linenumber AS line_no, l_partkey AS product_id, "
          "CAST(l_quantity AS INTEGER) AS quantity FROM lineitem")


# -- W4 / J17 ---------------------------------------------------------------------
@register("challan_item_snapshot", with_views("""
SELECT h.challan_id, h.customer_id, li.line_no, li.product_id, li.quantity, h.outcome,
       CASE WHEN h.outcome = 'applied' THEN per.total_quantity END AS total_quantity,
       CASE WHEN h.outcome = 'applied' THEN li.product_name END AS product_name_snapshot,
       CASE WHEN h.outcome = 'applied' THEN li.sku END AS sku_snapshot,
       CASE WHEN h.outcome = 'applied' THEN li.unit_price END AS unit_price_snapshot
FROM head h LEFT JOIN li ON h.challan_id = li.challan_id LEFT JOIN per ON per.challan_id = h.challan_id""",
    "challans", "customers", "products", extra=[
        ("lines", _LINES),
        ("req", "SELECT id AS challan_id, customer_id FROM challans WHERE status = 'DRAFT'"),
        ("li", """SELECT l.*, p.product_name, p.sku, p.unit_price FROM lines l
                  JOIN req r ON r.challan_id = l.challan_id LEFT JOIN products p ON p.id = l.product_id"""),
        ("per", """SELECT challan_id, COUNT(*) AS n_items, COUNT(DISTINCT product_id) AS n_products,
                  MAX(CASE WHEN product_name IS NULL THEN 1 ELSE 0 END) AS missing, MIN(quantity) AS min_qty,
                  CAST(SUM(quantity) AS BIGINT) AS total_quantity FROM li GROUP BY challan_id"""),
        ("head", """SELECT r.challan_id, r.customer_id,
                  CASE WHEN c.id IS NULL OR per.missing = 1 THEN 'not_found'
                       WHEN COALESCE(per.n_items, 0) = 0 THEN 'invalid'
                       WHEN per.min_qty <= 0 OR per.n_products < per.n_items THEN 'invalid'
                       ELSE 'applied' END AS outcome
                  FROM req r LEFT JOIN customers c ON c.id = r.customer_id
                  LEFT JOIN per ON per.challan_id = r.challan_id""")]))
def q_item_snapshot(spark, d):
    fx = Fixture(spark, d)
    req = fx.challans().where(F.col("status") == "DRAFT").select(F.col("id").alias("challan_id"), "customer_id")
    return cm.draft_challans(req, fx.raw_lines(), fx.customers(), fx.products())


# -- W6 --------------------------------------------------------------------------------
@register("challan_numbers", with_views("""
SELECT id, created_at, sequence, printf('CH-%d-%05d', year(created_at), sequence) AS challan_number
FROM (SELECT id, created_at, CAST((SELECT MAX(id) FROM challans WHERE status <> 'DRAFT')
                                  + ROW_NUMBER() OVER (ORDER BY created_at, id) AS BIGINT) AS sequence
      FROM challans WHERE status = 'DRAFT')""", "challans"))
def q_numbers(spark, d):
    ch = Fixture(spark, d).challans()
    last = ch.where(F.col("status") != "DRAFT").select(F.max("id")).scalar()
    return cm.challan_numbers(ch.where(F.col("status") == "DRAFT").select("id", "created_at"), last)


# -- W7 ----------------------------------------------------------------------------------
@register("challan_transitions", with_views(f"""
SELECT c.id AS command_id, c.id AS challan_id,
       CASE WHEN c.status = 'DRAFT' THEN 'applied' ELSE 'conflict' END AS outcome,
       CASE WHEN c.status = 'DRAFT' THEN 'CANCELLED' ELSE c.status END AS new_status,
       CASE WHEN c.status = 'DRAFT' THEN {NOW_SQL} END AS cancelled_at
FROM challans c JOIN customers cu ON cu.id = c.customer_id WHERE cu.status = 'INACTIVE'""",
                                              "challans", "customers"))
def q_transitions(spark, d):
    fx = Fixture(spark, d)
    inactive = fx.customers().where(F.col("status") == "INACTIVE").select(F.col("id").alias("customer_id"))
    cmds = fx.challans().join(inactive, "customer_id", "left_semi").select(
        F.col("id").alias("command_id"), F.col("id").alias("challan_id"))
    return cm.challan_transitions(fx.challans(), cmds, NOW)


# -- W11 ---------------------------------------------------------------------------------
# Oracle: a question is closed from its first effective resolve on, and in progress from its first effective reply on.
@register("query_transitions", with_views(f"""
SELECT f.command_id, f.query_id, f.action,
       CASE WHEN f.initial IS NULL THEN 'not_found'
            WHEN f.closed THEN CASE f.action WHEN 'reply' THEN 'conflict' ELSE 'not_found' END
            WHEN f.action IN ('reply', 'resolve') THEN 'applied' ELSE 'invalid' END AS outcome,
       CASE WHEN f.initial IS NULL THEN NULL WHEN f.closed OR f.action = 'resolve' THEN 'RESOLVED'
            WHEN p.at <= f.command_id THEN 'IN_PROGRESS' ELSE f.initial END AS status_after,
       CASE WHEN NOT f.closed AND f.action = 'resolve' THEN {NOW_SQL} END AS resolved_at
FROM (SELECT n.*, n.initial = 'RESOLVED' OR COALESCE(x.at < n.command_id, FALSE) AS closed
      FROM named n LEFT JOIN firsts x ON x.query_id = n.query_id AND x.action = 'resolve') f
LEFT JOIN firsts p ON p.query_id = f.query_id AND p.action = 'reply'""", "queries", extra=[
    ("cmds", """SELECT conv_id * 1000 + turn AS command_id, conv_id AS query_id,
                conv_id + CASE WHEN (conv_id + turn) % 4 = 0 THEN 1 ELSE 0 END AS customer_id,
                CASE role WHEN 'assistant' THEN 'reply' WHEN 'system' THEN 'resolve' ELSE
                     CASE WHEN turn % 3 = 0 THEN 'resolve' ELSE 'note' END END AS action FROM conversations"""),
    ("named", """SELECT c.command_id, c.query_id, c.action, q.status AS initial FROM cmds c
                 LEFT JOIN queries q ON q.id = c.query_id AND q.customer_id = c.customer_id"""),
    ("firsts", """SELECT query_id, action, MIN(command_id) AS at FROM named WHERE initial IS NOT NULL
                  GROUP BY query_id, action""")]))
def q_query_transitions(spark, d):
    """Every turn is a command; some name another customer, some an unknown action."""
    cv = Fixture(spark, d).table("conversations")
    foreign = F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, 1).otherwise(0)
    action = (F.when(F.col("role") == "assistant", "reply").when(F.col("role") == "system", "resolve")
              .when(F.col("turn") % 3 == 0, "resolve").otherwise("note"))
    cmds = cv.select((F.col("conv_id") * 1000 + F.col("turn")).alias("command_id"), F.col("conv_id").alias("query_id"),
                     (F.col("conv_id") + foreign).alias("customer_id"), action.alias("action"))
    return cm.query_transitions(Fixture(spark, d).queries(), cmds, NOW)


# -- W9 / W10 ------------------------------------------------------------------------------
def _review_sql(urgency: str, target: str) -> str:
    return with_views(f"""
SELECT id AS command_id, id AS request_id, product_id, quantity,
       CASE WHEN status = 'PENDING' THEN 'applied' ELSE 'conflict' END AS outcome,
       CASE WHEN status = 'PENDING' THEN '{target}' ELSE status END AS new_status,
       CASE WHEN status = 'PENDING' THEN CAST({REVIEWER} AS BIGINT) END AS reviewed_by,
       CASE WHEN status = 'PENDING' THEN {NOW_SQL} END AS reviewed_at,
       CASE WHEN status = 'PENDING' THEN '' END AS review_note
FROM stock_requests WHERE urgency = '{urgency}'""", "stock_requests")


def _review(spark, d, urgency: str, decision: str):
    rq = Fixture(spark, d).stock_requests()
    cmds = rq.where(F.col("urgency") == urgency).select(F.col("id").alias("command_id"),
                                                        F.col("id").alias("request_id"))
    return cm.review_requests(rq, cmds, REVIEWER, NOW, decision)


@register("approve_requests", _review_sql("HIGH", "APPROVED"))
def q_approve(spark, d):
    return _review(spark, d, "HIGH", "approve")


@register("reject_requests", _review_sql("LOW", "REJECTED"))
def q_reject(spark, d):
    return _review(spark, d, "LOW", "reject")


# -- W3 ------------------------------------------------------------------------------------
@register("update_products", with_views("""
SELECT COALESCE(p.id, u.id) AS id, COALESCE(u.product_name, p.product_name) AS product_name,
       COALESCE(u.sku, p.sku) AS sku, COALESCE(u.category, p.category) AS category,
       COALESCE(u.unit_price, p.unit_price) AS unit_price,
       COALESCE(u.minimum_stock_alert_quantity, p.minimum_stock_alert_quantity) AS minimum_stock_alert_quantity,
       COALESCE(u.warehouse_location, p.warehouse_location) AS warehouse_location,
       CASE WHEN p.id IS NULL THEN 'not_found' WHEN u.id IS NOT NULL THEN 'applied' ELSE 'unchanged' END AS outcome
FROM products p FULL OUTER JOIN upd u ON u.id = p.id""", "products", extra=[
    ("upd", """SELECT id, CAST(ROUND(unit_price * 1.10, 2) AS DECIMAL(12,2)) AS unit_price,
               'W-' || warehouse_location AS warehouse_location, NULL AS product_name, NULL AS sku,
               NULL AS category, NULL AS minimum_stock_alert_quantity
               FROM products WHERE warehouse_location = 'Brand#1'""")]))
def q_update_products(spark, d):
    p = Fixture(spark, d).products()
    upd = p.where(F.col("warehouse_location") == "Brand#1").select(
        "id", F.round(F.col("unit_price") * F.lit(1.10).cast("decimal(3,2)"), 2).cast("decimal(12,2)").alias("unit_price"),
        F.concat(F.lit("W-"), F.col("warehouse_location")).alias("warehouse_location"))
    return cm.update_products(p, upd)


# -- W1 ------------------------------------------------------------------------------------
_CUST_RULES = """
SELECT id, 'customer_name_length' AS rule FROM inc WHERE customer_name IS NULL OR length(trim(customer_name)) < 2 OR length(trim(customer_name)) > 160
UNION ALL SELECT id, 'mobile_length' FROM inc WHERE mobile IS NULL OR length(trim(mobile)) < 6 OR length(trim(mobile)) > 30
UNION ALL SELECT id, 'business_name_length' FROM inc WHERE business_name IS NULL OR length(trim(business_name)) < 2 OR length(trim(business_name)) > 180
UNION ALL SELECT id, 'gst_number_length' FROM inc WHERE COALESCE(length(trim(gst_number)) > 30, FALSE)
UNION ALL SELECT id, 'address_length' FROM inc WHERE address IS NULL OR length(trim(address)) < 5 OR length(trim(address)) > 1000
UNION ALL SELECT id, 'email_format' FROM inc WHERE email IS NOT NULL AND NOT regexp_matches(email, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$')
UNION ALL SELECT id, 'customer_type_enum' FROM inc WHERE NOT COALESCE(customer_type IN ('RETAIL', 'WHOLESALE', 'DISTRIBUTOR'), FALSE)
UNION ALL SELECT id, 'status_enum' FROM inc WHERE NOT COALESCE(status IN ('LEAD', 'ACTIVE', 'INACTIVE'), FALSE)"""


@register("ingest_customers", with_views("""
SELECT i.id, i.customer_name, i.business_name, i.mobile, i.email, i.gst_number, i.customer_type,
       i.follow_up_date, i.address, COALESCE(i.status, 'LEAD') AS status,
       CASE WHEN b.rules IS NOT NULL THEN 'invalid'
            WHEN s.customer_name IS NOT NULL OR EXISTS (SELECT 1 FROM inc e WHERE e.id < i.id AND e.customer_name = i.customer_name
                 AND e.mobile = i.mobile AND e.id NOT IN (SELECT id FROM bad)) THEN 'duplicate'
            ELSE 'applied' END AS outcome,
       COALESCE(b.rules, '') AS broken_rules
FROM inc i LEFT JOIN (SELECT id, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM bad GROUP BY id) b
  ON b.id = i.id
LEFT JOIN (SELECT DISTINCT customer_name, mobile FROM existing) s
  ON s.customer_name = i.customer_name AND s.mobile = i.mobile""", "customers", extra=[
    ("inc", """SELECT c.id, c.customer_name, c.business_name, c.mobile, c.email, c.gst_number, c.customer_type,
               CASE WHEN c.id % 5 = 0 AND again = 0 THEN 'GONE' ELSE COALESCE(c.status, 'LEAD') END AS status,
               c.follow_up_date, n.n_name AS address
               FROM (SELECT *, 0 AS again FROM customers UNION ALL
                     SELECT c.* REPLACE (id + 1000000000 AS id), 1 FROM customers c WHERE id % 5 < 2) c
               LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey"""),
    ("bad", _CUST_RULES),
    ("existing", "SELECT * FROM customers WHERE id IN (SELECT o_custkey FROM orders)")]))
def q_ingest(spark, d):
    fx = Fixture(spark, d)
    buyers = fx.table("orders").select(F.col("o_custkey").alias("id")).distinct()
    existing = fx.customers().join(buyers, "id", "left_semi")
    # Some first requests are invalid, and some requests come a second time.
    asked = fx.customers(with_address=True)
    again = asked.where(F.col("id") % 5 < 2).withColumn("id", F.col("id") + 1_000_000_000)
    incoming = asked.withColumn("status", F.when(F.col("id") % 5 == 0, "GONE").otherwise(F.col("status"))).unionByName(again)
    return cm.ingest_customers(existing, incoming)


# -- W16 -----------------------------------------------------------------------------------
@register("cascade_delete_customers", with_views("""
SELECT g.customer_id, g.outcome,
       CAST(COALESCE(f.n, 0) AS BIGINT) AS follow_ups_removed, CAST(COALESCE(q.n, 0) AS BIGINT) AS queries_removed,
       CAST(COALESCE(r.n, 0) AS BIGINT) AS replies_removed, CAST(COALESCE(v.n, 0) AS BIGINT) AS reviews_removed
FROM dec g
LEFT JOIN (SELECT customer_id, COUNT(*) AS n FROM follow_ups GROUP BY customer_id) f
  ON f.customer_id = g.customer_id AND g.outcome = 'applied'
LEFT JOIN (SELECT customer_id, COUNT(*) AS n FROM queries GROUP BY customer_id) q
  ON q.customer_id = g.customer_id AND g.outcome = 'applied'
LEFT JOIN (SELECT q.customer_id, COUNT(*) AS n FROM replies r JOIN queries q ON q.id = r.query_id
           GROUP BY q.customer_id) r ON r.customer_id = g.customer_id AND g.outcome = 'applied'
LEFT JOIN (SELECT customer_id, COUNT(*) AS n FROM reviews GROUP BY customer_id) v
  ON v.customer_id = g.customer_id AND g.outcome = 'applied'""",
    "customers", "challans", "follow_ups", "queries", "replies", "reviews", extra=[
        ("dec", """SELECT id AS customer_id,
                   CASE WHEN id IN (SELECT customer_id FROM challans) THEN 'conflict' ELSE 'applied' END AS outcome
                   FROM customers WHERE status = 'INACTIVE'""")]))
def q_cascade(spark, d):
    fx = Fixture(spark, d)
    cmds = fx.customers().where(F.col("status") == "INACTIVE").select(F.col("id").alias("customer_id"))
    return cm.cascade_delete_customers(fx.customers(), cmds, fx.challans(), fx.follow_ups(), fx.queries(),
                                       fx.replies(), fx.reviews())


# One-at-a-time oracles (recursive SQL: one step per draft / command, in arrival order).
# The stock is carried as a list indexed by product key, which relies on the
# fixture's dense part keys 0..n-1 (an oracle-only shortcut for O(1) lookups).
SQL_CONFIRM_DRAFTS = """
WITH RECURSIVE
stock0 AS (
  SELECT l_partkey AS product_id,
         GREATEST(SUM(CASE WHEN l_returnflag = 'N' THEN -CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) END), 0) AS available
  FROM lineitem GROUP BY l_partkey),
batch AS (SELECT o_orderkey AS challan_id, o_orderdate AS requested_at FROM orders WHERE o_orderstatus = 'O'),
items AS (
  SELECT l_orderkey AS challan_id, l_partkey AS product_id, CAST(SUM(CAST(l_quantity AS INTEGER)) AS BIGINT) AS qty,
         MIN(l_linenumber) AS line_no
  FROM lineitem WHERE l_orderkey IN (SELECT challan_id FROM batch) GROUP BY l_orderkey, l_partkey),
flags AS (
  SELECT i.challan_id, COUNT(*) AS n_items, MAX(CASE WHEN p.p_partkey IS NULL THEN 1 ELSE 0 END) AS missing,
         MAX(CASE WHEN i.qty IS NULL OR i.qty <= 0 THEN 1 ELSE 0 END) AS bad_qty
  FROM items i LEFT JOIN part p ON p.p_partkey = i.product_id GROUP BY i.challan_id),
pre AS (
  SELECT b.challan_id, b.requested_at,
         CASE WHEN COALESCE(f.n_items, 0) = 0 OR f.bad_qty = 1 THEN 'invalid'
              WHEN f.missing = 1 THEN 'product_missing' END AS pre_outcome
  FROM batch b LEFT JOIN flags f ON f.challan_id = b.challan_id),
elig AS (
  SELECT p.challan_id, ROW_NUMBER() OVER (ORDER BY p.requested_at, p.challan_id) AS rn,
         (SELECT list(struct_pack(product_id := i.product_id, qty := i.qty) ORDER BY i.line_no, i.product_id)
          FROM items i WHERE i.challan_id = p.challan_id) AS its
  FROM pre p WHERE p.pre_outcome IS NULL),
stock_list AS (
  SELECT list(COALESCE(s.available, 0) ORDER BY p.p_partkey) AS stock
  FROM part p LEFT JOIN stock0 s ON s.product_id = p.p_partkey),
r(rn, stock, challan_id, ok, short_product_id, short_available) AS (
  SELECT 0, (SELECT stock FROM stock_list), CAST(NULL AS BIGINT), CAST(NULL AS BOOLEAN), CAST(NULL AS BIGINT),
         CAST(NULL AS BIGINT)
  UNION ALL
  SELECT e.rn,
         CASE WHEN list_bool_and(list_transform(e.its, lambda x: r.stock[x.product_id + 1] >= x.qty))
              THEN list_transform(r.stock, lambda v, i: v - COALESCE(list_sum(list_transform(
                       list_filter(e.its, lambda x: x.product_id + 1 = i), lambda x: x.qty)), 0))
              ELSE r.stock END,
         e.challan_id,
         list_bool_and(list_transform(e.its, lambda x: r.stock[x.product_id + 1] >= x.qty)),
         list_filter(e.its, lambda x: r.stock[x.product_id + 1] < x.qty)[1].product_id,
         r.stock[list_filter(e.its, lambda x: r.stock[x.product_id + 1] < x.qty)[1].product_id + 1]
  FROM r JOIN elig e ON e.rn = r.rn + 1)
SELECT p.challan_id,
       COALESCE(p.pre_outcome, CASE WHEN r.ok THEN 'applied' ELSE 'insufficient_stock' END) AS outcome,
       CASE WHEN r.ok THEN NULL ELSE r.short_product_id END AS short_product_id,
       CASE WHEN r.ok THEN NULL ELSE r.short_available END AS short_available
FROM pre p LEFT JOIN r ON r.challan_id = p.challan_id
"""

_ADJ_CTES = [
    ("lines", "SELECT * FROM movements WHERE reference_type <> 'OPENING_STOCK'"),
    ("stock0", """SELECT product_id, GREATEST(SUM(CASE WHEN movement_type = 'IN' THEN quantity_changed
                                                    ELSE -quantity_changed END), 0) AS available
                  FROM lines WHERE created_at < TIMESTAMP '2001-08-02 00:00:00' GROUP BY product_id"""),
    ("cmds", """SELECT ROW_NUMBER() OVER (ORDER BY created_at, reason, movement_type, quantity_changed, created_by)
                       AS command_id, product_id AS named, movement_type, quantity_changed AS quantity,
                       created_at AS requested_at
                FROM lines WHERE created_at >= TIMESTAMP '2001-08-02 00:00:00'"""),
    ("known", """SELECT *, ROW_NUMBER() OVER (ORDER BY command_id) AS step, named AS product_id FROM cmds
                 WHERE command_id % 13 <> 0"""),
    ("stock_list", """SELECT list(CAST(COALESCE(s.available, 0) AS BIGINT) ORDER BY p.p_partkey) AS stock
                      FROM part p LEFT JOIN stock0 s ON s.product_id = p.p_partkey"""),
    ("r(command_id, stock, ok)", """
  SELECT CAST(0 AS BIGINT), (SELECT stock FROM stock_list), CAST(NULL AS BOOLEAN)
  UNION ALL
  SELECT c.step,
         CASE WHEN c.movement_type = 'IN' OR r.stock[c.product_id + 1] >= c.quantity
              THEN list_transform(r.stock, lambda v, i: CASE WHEN i = c.product_id + 1 THEN
                       v + CASE WHEN c.movement_type = 'IN' THEN c.quantity ELSE -c.quantity END ELSE v END)
              ELSE r.stock END,
         c.movement_type = 'IN' OR r.stock[c.product_id + 1] >= c.quantity
  FROM r JOIN known c ON c.step = r.command_id + 1"""),
]
SQL_APPLY_ADJUSTMENTS = with_views("""
SELECT c.command_id, CASE WHEN k.step IS NULL THEN c.named + 1000000000 ELSE c.named END AS product_id, c.movement_type,
       c.quantity, c.requested_at,
       CASE WHEN k.step IS NULL THEN 'not_found' WHEN r.ok THEN 'applied' ELSE 'insufficient_stock' END AS outcome
FROM cmds c LEFT JOIN known k ON k.command_id = c.command_id LEFT JOIN r ON r.command_id = k.step""", "movements", extra=_ADJ_CTES).replace("WITH ", "WITH RECURSIVE ", 1)


# -- W5 and W8 (sequential semantics: checked against one-at-a-time processing) ---------------
def confirm_drafts_fixture(spark, d):
    fx = Fixture(spark, d)
    lv = inv.stock_levels(fx.movements(opening=False)).select(
        "product_id", F.greatest(F.col("current_stock"), F.lit(0)).alias("available"))
    ch = fx.challans()
    batch = ch.where(F.col("status") == "DRAFT").select(F.col("id").alias("challan_id"),
                                                        F.col("created_at").alias("requested_at"))
    return alloc.confirm_drafts(ch, fx.raw_lines(), lv, fx.products(), batch, NOW)


@register("confirm_drafts", SQL_CONFIRM_DRAFTS)
def q_confirm(spark, d):
    return confirm_drafts_fixture(spark, d)["decisions"]


_DECIDED_HEAD, _, _DECIDED_TAIL = SQL_CONFIRM_DRAFTS.rpartition("SELECT p.challan_id,")


# The ledger rows of the confirmed drafts.
@register("confirm_movements", f"""{_DECIDED_HEAD.rstrip()},
decided AS (SELECT p.challan_id,{_DECIDED_TAIL})
SELECT i.product_id, CAST(i.qty AS INTEGER) AS quantity_changed, 'OUT' AS movement_type,
       'Confirmed sales challan ' || printf('CH-%d-%05d', year(o_orderdate), o_orderkey) AS reason,
       'CHALLAN' AS reference_type, i.challan_id AS reference_id, {NOW_SQL} AS created_at
FROM decided SEMI JOIN batch USING (challan_id) INNER JOIN items i USING (challan_id)
INNER JOIN orders ON o_orderkey = challan_id WHERE outcome = 'applied'""")
def q_confirm_movements(spark, d):
    return confirm_drafts_fixture(spark, d)["movements"]


def adjustments_fixture(spark, d):
    """Stock = ledger lines before ADJUST_FROM (no opening rows, floored at 0); commands = later
    lines, every thirteenth of them for a product that does not exist."""
    fx = Fixture(spark, d)
    lines = fx.movements(opening=False)
    until = wall_time(ADJUST_FROM)
    stock = inv.stock_levels(lines.where(F.col("created_at") < until)).select(
        "product_id", F.greatest(F.col("current_stock"), F.lit(0)).alias("available"))
    later = lines.where(F.col("created_at") >= until)
    cmds = positions(later, [], ["created_at", "reason", "movement_type", "quantity_changed", "created_by"],
                     "command_id").select(
        F.col("command_id").cast("bigint").alias("command_id"),
        F.when(F.col("command_id") % 13 == 0, F.col("product_id") + 1_000_000_000).otherwise(F.col("product_id")).alias("product_id"),
        "movement_type", F.col("quantity_changed").alias("quantity"), F.col("created_at").alias("requested_at"))
    return cmds, stock


@register("apply_adjustments", SQL_APPLY_ADJUSTMENTS)
def q_adjust(spark, d):
    cmds, stock = adjustments_fixture(spark, d)
    return alloc.apply_adjustments(cmds, stock, Fixture(spark, d).products())
