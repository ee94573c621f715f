"""Registered inventory keys."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ledgerloom.config import AS_OF, OPENING_STOCK_REASON
from ledgerloom.operators import inventory as inv
from ledgerloom.plans.oracle import with_views
from ledgerloom.plans.registry import register
from ledgerloom.sources.fixtures import Fixture

# The stored product stock of the fixture is the ledger as it stood at the
# end of AS_OF; later-dated ledger rows make the reconciliation non-empty.
STORED_UNTIL = dt.datetime.combine(AS_OF + dt.timedelta(days=1), dt.time())
STORED_UNTIL_SQL = "TIMESTAMP '2001-08-02 00:00:00'"
TOP_N = 20

_SIGNED = "CASE WHEN movement_type = 'IN' THEN quantity_changed ELSE -quantity_changed END"
_PRODUCT_COLS = ("id, product_name, sku, category, unit_price, minimum_stock_alert_quantity, warehouse_location, "
                 "current_stock, is_low_stock, CASE WHEN is_low_stock THEN 'Low stock' ELSE 'Healthy' END AS stock_status")


def products_stock(fx: Fixture):
    return inv.products_with_stock(fx.products(), inv.stock_levels(fx.movements()))


@register("stock_levels", with_views("SELECT * FROM stock", "stock"))
def q_stock_levels(spark, d):
    return inv.stock_levels(Fixture(spark, d).movements())


@register("product_stock_status", with_views(f"SELECT {_PRODUCT_COLS} FROM products_stock", "products_stock"))
def q_product_stock_status(spark, d):
    return products_stock(Fixture(spark, d))


@register("low_stock_products",
          with_views(f"SELECT {_PRODUCT_COLS} FROM products_stock WHERE is_low_stock", "products_stock"))
def q_low_stock_products(spark, d):
    return inv.low_stock_products(products_stock(Fixture(spark, d)))


@register("low_stock_top5", with_views("""
SELECT id, product_name, sku, current_stock, minimum_stock_alert_quantity FROM products_stock
WHERE is_low_stock ORDER BY current_stock ASC, id ASC LIMIT 5""", "products_stock"))
def q_low_stock_top5(spark, d):
    return inv.low_stock_top(products_stock(Fixture(spark, d)), 5)


@register("stock_running_balance", with_views(f"""
SELECT product_id, created_at, movement_type, quantity_changed, reference_type, reference_id,
       CAST(SUM({_SIGNED}) OVER (PARTITION BY product_id ORDER BY created_at
                                RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS balance
FROM movements""", "movements"))
def q_running_balance(spark, d):
    return inv.stock_running_balance(Fixture(spark, d).movements())


@register("stock_first_negative", with_views(f"""
SELECT product_id, MIN(created_at) AS first_negative_at, MIN(balance) AS lowest_balance FROM (
  SELECT product_id, created_at, CAST(SUM({_SIGNED}) OVER (PARTITION BY product_id ORDER BY created_at
                                RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS balance
  FROM movements WHERE reference_type <> 'OPENING_STOCK')
WHERE balance < 0 GROUP BY product_id""", "movements"))
def q_first_negative(spark, d):
    # Without the opening rows many products dip below zero: a non-trivial check.
    m = Fixture(spark, d).movements().where(F.col("reference_type") != "OPENING_STOCK")
    return inv.first_negative_balance(inv.stock_running_balance(m))


@register("latest_movements_per_product", with_views(f"""
SELECT product_id, rank, created_at, movement_type, quantity_changed, reason, reference_type, reference_id,
       u.name AS created_by_name
FROM (SELECT m.*, CAST(ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY created_at DESC, reason ASC,
              movement_type ASC, quantity_changed ASC, created_by ASC, reference_type ASC,
              reference_id ASC NULLS FIRST) AS INTEGER) AS rank FROM movements m) t
JOIN users u ON u.id = t.created_by WHERE rank <= {TOP_N}""", "movements", "users"))
def q_latest_movements(spark, d):
    fx = Fixture(spark, d)
    return inv.latest_movements_per_product(fx.movements(), fx.users(), TOP_N)


@register("stock_movement_history", with_views("""
SELECT m.product_id, m.created_at, m.movement_type, m.quantity_changed, m.reason, m.reference_type,
       m.reference_id, u.name AS created_by_name, t.total
FROM movements m JOIN users u ON u.id = m.created_by
JOIN (SELECT product_id, COUNT(*) AS total FROM movements GROUP BY product_id) t ON t.product_id = m.product_id""",
                                              "movements", "users"))
def q_movement_history(spark, d):
    fx = Fixture(spark, d)
    return inv.stock_movement_history(fx.movements(), fx.users())


@register("stock_reconciliation", with_views(f"""
SELECT COALESCE(s.product_id, l.product_id) AS product_id, COALESCE(s.stored_stock, 0) AS stored_stock,
       COALESCE(l.current_stock, 0) AS ledger_stock,
       COALESCE(l.current_stock, 0) - COALESCE(s.stored_stock, 0) AS difference
FROM (SELECT p.id AS product_id, CAST(COALESCE(SUM({_SIGNED}), 0) AS BIGINT) AS stored_stock
      FROM products p LEFT JOIN movements m ON m.product_id = p.id AND m.created_at < {STORED_UNTIL_SQL}
      GROUP BY p.id) s
FULL OUTER JOIN stock l ON l.product_id = s.product_id
WHERE COALESCE(l.current_stock, 0) - COALESCE(s.stored_stock, 0) <> 0""", "products", "movements", "stock"))
def q_reconciliation(spark, d):
    fx = Fixture(spark, d)
    stored = inv.products_with_stock(fx.products(), inv.stock_levels(fx.movements(), until=STORED_UNTIL))
    return inv.stock_reconciliation(stored.select("id", "current_stock"), fx.movements())


@register("opening_movements", with_views(f"""
SELECT id AS product_id, CAST(current_stock AS INTEGER) AS quantity_changed, 'IN' AS movement_type,
       '{OPENING_STOCK_REASON}' AS reason, 'OPENING_STOCK' AS reference_type,
       CAST(NULL AS BIGINT) AS reference_id, CAST(0 AS BIGINT) AS created_by,
       TIMESTAMP '2001-08-01 00:00:00' AS created_at
FROM products_stock WHERE current_stock > 0""", "products_stock"))
def q_opening(spark, d):
    # Re-creating every catalogue product with its current ledger stock as the opening amount.
    fx = Fixture(spark, d)
    return inv.opening_movements(products_stock(fx), 0, dt.datetime.combine(AS_OF, dt.time()))


HISTORY_PRODUCT, HISTORY_OFFSET, HISTORY_LIMIT = 7, 10, 10


# The second page of one product's history, newest first, with its total.
@register("product_history_page", with_views(f"""
SELECT numbered.* EXCLUDE (place) REPLACE ((SELECT s_name FROM supplier WHERE s_suppkey = created_by_name) AS created_by_name)
FROM (SELECT product_id, created_at, movement_type, quantity_changed, reason, reference_type, reference_id,
             created_by AS created_by_name, CAST(COUNT(*) OVER () AS BIGINT) AS total,
             ROW_NUMBER() OVER (ORDER BY created_at DESC, reason, movement_type, quantity_changed, created_by) AS place
      FROM movements WHERE product_id = {HISTORY_PRODUCT}) numbered
WHERE place BETWEEN {HISTORY_OFFSET + 1} AND {HISTORY_OFFSET + HISTORY_LIMIT}""", "movements"))
def q_history_page(spark, d):
    fx = Fixture(spark, d)
    return inv.stock_movement_history(fx.movements(), fx.users(), HISTORY_PRODUCT, HISTORY_OFFSET, HISTORY_LIMIT)


# WN1 over the whole ledger, opening rows included: the lowest balance of every product.
@register("stock_lowest_balance", with_views(f"""
SELECT product_id, MIN(balance) AS lowest_balance, CAST(MIN(balance) < 0 AS BOOLEAN) AS was_negative
FROM (SELECT a.product_id, a.created_at, CAST(SUM({_SIGNED.replace('quantity_changed', 'b.quantity_changed').replace('movement_type', 'b.movement_type')}) AS BIGINT) AS balance
      FROM (SELECT DISTINCT product_id, created_at FROM movements) a
      JOIN movements b ON b.product_id = a.product_id AND b.created_at <= a.created_at GROUP BY a.product_id, a.created_at)
GROUP BY product_id""", "movements"))
def q_lowest_balance(spark, d):
    from pyspark.sql import functions as F
    balances = inv.stock_running_balance(Fixture(spark, d).movements())
    return balances.groupBy("product_id").agg(F.min("balance").alias("lowest_balance"), (F.min("balance") < 0).alias("was_negative"))
