"""Registered history load (S8, P12, J18) over names that are unknown or shared."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans.oracle import with_views
from ledgerloom.plans.registry import register
from ledgerloom.sources import history as hs
from ledgerloom.sources.fixtures import Fixture
from ledgerloom.sources.scratch import scratch_path

_NAMED = [
    ("named", "SELECT id, CASE WHEN id % 40 = 0 THEN 'Twin' ELSE customer_name END AS customer_name FROM customers"),
    ("asked", """SELECT 'DEMO-' || l_orderkey || '-' || l_linenumber AS challan_number,
        CASE WHEN l_partkey % 17 = 0 THEN 'nobody@example.test' ELSE 'user' || l_suppkey || '@example.test' END AS "user", n.customer_name AS customer,
        CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE 'SKU-' || l_partkey END AS product, CAST(l_quantity AS INTEGER) AS quantity, confirmed_at
        FROM lineitem JOIN challans c ON c.id = l_orderkey JOIN named n ON n.id = c.customer_id WHERE c.status = 'CONFIRMED'"""),
    ("resolved", """SELECT challan_number, n.id AS customer_id, u.id AS created_by, p.id AS product_id, product_name AS product_name_snapshot,
        a.product AS sku_snapshot, unit_price AS unit_price_snapshot, quantity, confirmed_at,
        CASE WHEN u.id IS NULL THEN 'unknown_user' WHEN n.id IS NULL THEN 'unknown_customer' WHEN n.n > 1 THEN 'ambiguous_customer'
             WHEN p.id IS NULL THEN 'unknown_product' ELSE 'loaded' END AS outcome
        FROM asked a LEFT JOIN users u ON u.email = a."user" LEFT JOIN products p ON p.sku = a.product
        LEFT JOIN (SELECT customer_name, min(id) AS id, count(*) AS n FROM named GROUP BY customer_name) n ON n.customer_name = a.customer""")]


def _resolved(spark, d):
    fx = Fixture(spark, d)
    named = fx.customers().withColumn("customer_name", F.when(F.col("id") % 40 == 0, "Twin").otherwise(F.col("customer_name")))
    sold = fx.challans().where("status = 'CONFIRMED'").select(F.col("id").alias("l_orderkey"), F.col("customer_id"), "confirmed_at")
    who = named.select(F.col("id").alias("customer_id"), F.col("customer_name").alias("customer"))
    part = F.col("l_partkey")
    asked = fx.table("lineitem").join(sold, "l_orderkey").join(who, "customer_id").select(
        F.concat(F.lit("DEMO-"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("challan_number"),
        F.when(part % 17 == 0, "nobody@example.test").otherwise(F.concat(F.lit("user"), F.col("l_suppkey").cast("string"), F.lit("@example.test"))).alias("user"),
        "customer", F.when(part % 13 != 0, F.concat(F.lit("SKU-"), part.cast("string"))).alias("product"),
        F.col("l_quantity").cast("int").alias("quantity"), "confirmed_at")
    return hs.resolve(asked, fx.users(), named, fx.products())


@register("history_outcomes", with_views("SELECT challan_number, outcome FROM resolved", "users", "customers", "products", "challans", extra=_NAMED))
def q_history_outcomes(spark, d):
    return _resolved(spark, d).select("challan_number", "outcome")


@register("history_load", with_views("""
SELECT * EXCLUDE (outcome), 'DEMO' AS load, strftime(confirmed_at, '%Y-%m') AS month FROM resolved
WHERE outcome = 'loaded' AND starts_with(challan_number, 'DEMO-')""", "users", "customers", "products", "challans", extra=_NAMED))
def q_history_load(spark, d):
    """The load runs twice, the second time for the months of one year only."""
    path, rows = scratch_path(spark, "history"), _resolved(spark, d)
    hs.load(rows, path, "DEMO")
    hs.load(rows.where(F.year("confirmed_at") == 1999), path, "DEMO")
    return hs.numbered_like(hs.history(spark, path), "DEMO-")
