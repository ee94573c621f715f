"""Registered upserts by unique key (W15) and alerts changed in place.

Each job stores the table it changes in the checkpoint folder, runs the batch of
commands against it, and returns the stored table, or the outcome per command.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.config import OPENING_STOCK_REASON
from ledgerloom.operators import alerts as al
from ledgerloom.operators import inventory as inv
from ledgerloom.plans import keys_alerts
from ledgerloom.plans.oracle import N_PART, N_SUP, with_views
from ledgerloom.plans.registry import register
from ledgerloom.sources.counter import Counter, number_batch
from ledgerloom.sources.domain import DOMAIN_SCHEMAS
from ledgerloom.sources.fixtures import Fixture
from ledgerloom.sources.keyed import KeyedTable, upsert
from ledgerloom.sources.scratch import scratch_path

BUCKETS = 16
ROLES = ["ADMIN", "SALES", "WAREHOUSE", "ACCOUNTS"]

# -- users by email: later commands set name and role ------------------------------------
_USER_COMMANDS = f"""SELECT c_custkey AS command_id, 1000000 + c_custkey AS id, c_name AS name,
    CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'user1@example.test'
         ELSE 'user' || (c_custkey % (2 * {N_SUP})) || '@example.test' END AS email,
    CASE c_custkey % 4 WHEN 0 THEN 'ADMIN' WHEN 1 THEN 'SALES' WHEN 2 THEN 'WAREHOUSE' ELSE 'ACCOUNTS' END AS role
    FROM customer"""


def user_commands(fx: Fixture):
    """One registration per customer; a third of all name one address, some name none."""
    key = F.col("c_custkey")
    email = (F.when(key % 97 == 0, F.lit(None).cast("string")).when(key % 3 == 0, "user1@example.test")
             .otherwise(F.concat(F.lit("user"), (key % (2 * fx.n_suppliers)).cast("string"), F.lit("@example.test"))))
    role = F.element_at(F.array(*(F.lit(r) for r in ROLES)), (key % 4 + 1).cast("int"))
    return fx.table("customer").select(key.alias("command_id"), (1000000 + key).alias("id"), F.col("c_name").alias("name"),
                                       email.alias("email"), role.alias("role"))


def _upsert_users(spark, d):
    fx = Fixture(spark, d)
    table = KeyedTable(scratch_path(spark, "users"), DOMAIN_SCHEMAS["users"], ("email",), BUCKETS)
    table.create(fx.users())
    return table, upsert(table, user_commands(fx), "command_id", ["name", "role"])


@register("upsert_users", with_views("""
SELECT u.id, coalesce(f.name, u.name) AS name, u.email, coalesce(f.role, u.role) AS role FROM users u LEFT JOIN folded f ON f.email = u.email
UNION ALL SELECT id, name, email, role FROM folded WHERE email NOT IN (SELECT email FROM users)""", "users", extra=[
    ("commands", _USER_COMMANDS),
    ("folded", """SELECT email, arg_min(id, command_id) AS id, arg_max(name, command_id) AS name, arg_max(role, command_id) AS role
        FROM commands WHERE email IS NOT NULL GROUP BY email""")]))
def q_upsert_users(spark, d):
    return _upsert_users(spark, d)[0].read(spark)


@register("upsert_users_outcomes", with_views("""
SELECT command_id, email, CASE WHEN email IS NULL THEN 'invalid'
       WHEN email NOT IN (SELECT email FROM users) AND row_number() OVER (PARTITION BY email ORDER BY command_id) = 1 THEN 'inserted'
       ELSE 'updated' END AS outcome FROM commands""", "users", extra=[("commands", _USER_COMMANDS)]))
def q_upsert_users_outcomes(spark, d):
    return _upsert_users(spark, d)[1]


# -- products by sku: what is stored stays ------------------------------------------------
_PRODUCT_COMMANDS = f"""SELECT o_orderkey AS command_id, 1000000 + o_orderkey AS id, 'Import ' || o_orderkey AS product_name,
    'SKU-' || (o_orderkey % (2 * {N_PART})) AS sku, o_orderpriority AS category, CAST(o_totalprice AS DECIMAL(12,2)) AS unit_price,
    CAST(o_custkey % 100 AS INTEGER) AS minimum_stock_alert_quantity, 'Main Warehouse' AS warehouse_location FROM orders"""


def product_commands(fx: Fixture):
    """One catalogue entry per order, about half of them on a sku that is stored."""
    key = F.col("o_orderkey")
    return fx.table("orders").select(
        key.alias("command_id"), (1000000 + key).alias("id"), F.concat(F.lit("Import "), key.cast("string")).alias("product_name"),
        F.concat(F.lit("SKU-"), (key % (2 * fx.n_parts)).cast("string")).alias("sku"), F.col("o_orderpriority").alias("category"),
        F.col("o_totalprice").cast("decimal(12,2)").alias("unit_price"), (F.col("o_custkey") % 100).cast("int").alias("minimum_stock_alert_quantity"),
        F.lit("Main Warehouse").alias("warehouse_location"))


def _upsert_products(spark, d):
    fx = Fixture(spark, d)
    table = KeyedTable(scratch_path(spark, "products"), DOMAIN_SCHEMAS["products"], ("sku",), BUCKETS)
    table.create(fx.products())
    return fx, table, upsert(table, product_commands(fx), "command_id", [])


_PRODUCTS_AFTER = [
    ("commands", _PRODUCT_COMMANDS),
    ("catalogue", """SELECT * FROM products UNION ALL SELECT * EXCLUDE (command_id) FROM commands
        WHERE sku NOT IN (SELECT sku FROM products) QUALIFY row_number() OVER (PARTITION BY sku ORDER BY command_id) = 1""")]


@register("upsert_products", with_views("SELECT * FROM catalogue", "products", extra=_PRODUCTS_AFTER))
def q_upsert_products(spark, d):
    _, table, _ = _upsert_products(spark, d)
    return table.read(spark)


@register("upsert_products_outcomes", with_views("""
SELECT command_id, sku, CASE WHEN sku NOT IN (SELECT sku FROM products) AND row_number() OVER (PARTITION BY sku ORDER BY command_id) = 1
       THEN 'inserted' ELSE 'unchanged' END AS outcome FROM commands""", "products", extra=_PRODUCTS_AFTER))
def q_upsert_products_outcomes(spark, d):
    return _upsert_products(spark, d)[2]


@register("seed_movements", with_views(f"""
SELECT c.id AS product_id, CAST(c.minimum_stock_alert_quantity + 1 AS INTEGER) AS quantity_changed, 'IN' AS movement_type,
       '{OPENING_STOCK_REASON}' AS reason, 'OPENING_STOCK' AS reference_type, CAST(NULL AS BIGINT) AS reference_id, CAST(0 AS BIGINT) AS created_by,
       {keys_alerts._ts(keys_alerts.NOW)} AS created_at
FROM catalogue c WHERE c.id NOT IN (SELECT product_id FROM movements WHERE reference_type = 'OPENING_STOCK')""", "products", "movements", extra=_PRODUCTS_AFTER))
def q_seed_movements(spark, d):
    fx, table, _ = _upsert_products(spark, d)
    stocked = table.read(spark).withColumn("current_stock", F.col("minimum_stock_alert_quantity") + 1)
    return inv.seed_movements(stocked, fx.movements(), created_at=keys_alerts.NOW)


# -- alerts changed in place --------------------------------------------------------------
@register("alerts_by_changes", keys_alerts.ORACLE_MERGED)
def q_alerts_by_changes(spark, d):
    """The stored alerts after three batches of touched keys: products, customers, questions."""
    state = keys_alerts._State(spark, d)
    table = al.alert_table(scratch_path(spark, "alerts"), BUCKETS)
    table.create(state.stored)
    for kind in ("LOW_STOCK", "FOLLOW_UP", "CUSTOMER_QUERY"):
        live = state.live.where(F.col("type") == kind)
        touched = live.select(*al.KEY).unionByName(state.stored.where(F.col("type") == kind).select(*al.KEY))
        al.reconcile_touched(table, touched, live, keys_alerts.NOW)
    return table.read(spark)


# -- numbers across batches ---------------------------------------------------------------
@register("challan_numbers_batches", with_views("""
SELECT id, created_at, sequence, printf('CH-%d-%05d', year(created_at), sequence) AS challan_number
FROM (SELECT id, created_at, CAST((SELECT MAX(id) FROM challans WHERE status <> 'DRAFT')
                                  + ROW_NUMBER() OVER (ORDER BY id % 3, created_at, id) AS BIGINT) AS sequence
      FROM challans WHERE status = 'DRAFT')""", "challans"))
def q_numbers_batches(spark, d):
    """The drafts in three batches, of which the first runs again at the end."""
    challans = Fixture(spark, d).challans()
    counter = Counter(scratch_path(spark, "counter"))
    counter.start(spark, challans.where(F.col("status") != "DRAFT").agg(F.max("id")).first()[0] or 0)
    drafts = challans.where(F.col("status") == "DRAFT").select("id", "created_at")
    numbered = [number_batch(counter, b, drafts.where(F.col("id") % 3 == b)) for b in (0, 1, 2, 0)]
    return numbered[3].unionByName(numbered[1]).unionByName(numbered[2])
