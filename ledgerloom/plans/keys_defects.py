"""Data-quality keys over inputs with planted defects.

The given tables break few rules, so an empty result would prove little. Here
each input is a domain view in which some rows, chosen by their id, are broken
in each way a rule looks for. The same expressions break them on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import REVIEW_NOTE_MAX
from ledgerloom.operators import inventory as inv
from ledgerloom.operators import quality as dq
from ledgerloom.plans import keys_quality as kq
from ledgerloom.plans.oracle import with_views
from ledgerloom.plans.registry import register
from ledgerloom.sources.fixtures import Fixture

FAR = 1_000_000_000   # an id that no row has


def _when(every: int, value: str, column: str, key: str = "id") -> str:
    return f"CASE WHEN {key} % {every} = 0 THEN {value} ELSE {column} END"


CUSTOMERS = {
    "customer_name": _when(11, "'x'", "customer_name"), "mobile": _when(13, "' 12 '", "mobile"),
    "business_name": _when(17, "repeat('b', 181)", "business_name"), "email": _when(19, "'no at sign'", "email"),
    "gst_number": _when(23, "repeat('g', 31)", "gst_number"), "customer_type": _when(29, "'OTHER'", "customer_type"),
    "status": _when(31, "'GONE'", "status"), "address": _when(37, "NULL", "address"),
}
PRODUCTS = {
    "product_name": _when(11, "' '", "product_name"), "sku": _when(13, "NULL", "sku"), "category": _when(17, "''", "category"),
    "unit_price": _when(19, "-unit_price - 1", "unit_price"), "current_stock": _when(23, "-1", "current_stock"),
    "minimum_stock_alert_quantity": _when(29, "-5", "minimum_stock_alert_quantity"),
    "warehouse_location": _when(31, "repeat('w', 500)", "warehouse_location"),
}
MOVEMENTS = {
    "quantity_changed": _when(11, "0", "quantity_changed", "product_id"),
    "movement_type": _when(13, "'MOVE'", "movement_type", "product_id"), "reason": _when(17, "' '", "reason", "product_id"),
}
REQUESTS = {
    "quantity": _when(11, "0", _when(13, "2000000000", "quantity")), "urgency": _when(17, "'NOW'", "urgency"),
    "message": _when(19, "'x'", "message"),
}
NOTE = _when(23, f"repeat('n', {REVIEW_NOTE_MAX + 1})", "NULL")
CHALLANS = {
    "status": _when(41, "'LOST'", "status"),
    "confirmed_at": _when(43, "CASE WHEN status = 'CONFIRMED' THEN NULL ELSE created_at END", "confirmed_at"),
    "cancelled_at": _when(47, "CASE WHEN status = 'CANCELLED' THEN NULL ELSE created_at END", "cancelled_at"),
}


def _break(df: DataFrame, defects: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(defects[c]).cast(df.schema[c].dataType).alias(c) if c in defects else F.col(c) for c in df.columns])


def _sql(defects: dict[str, str]) -> str:
    return "* REPLACE (" + ", ".join(f"{e} AS {c}" for c, e in defects.items()) + ")"


def _broken_oracle(sql: str, source: str, defects: dict[str, str], name: str = "broken") -> str:
    """An oracle of ``keys_quality`` that reads the broken view instead of ``source``."""
    views, _, rules = sql.partition(")\nSELECT '")  # the views end where the first rule begins
    rules = rules.replace(f"FROM {source} ", f"FROM {name} ")
    return f"{views}),\n{name} AS (SELECT {_sql(defects)} FROM {source})\nSELECT '{rules}"


@register("dq_customers_defects", _broken_oracle(kq.SQL_DQ_CUSTOMERS, kq._CUST_SRC, CUSTOMERS))
def q_customers(spark, d):
    return dq.dq_customers(_break(Fixture(spark, d).customers(with_address=True), CUSTOMERS))


@register("dq_products_defects", _broken_oracle(kq.SQL_DQ_PRODUCTS, "products_stock", PRODUCTS))
def q_products(spark, d):
    fx = Fixture(spark, d)
    return dq.dq_products(_break(inv.products_with_stock(fx.products(), inv.stock_levels(fx.movements())), PRODUCTS))


@register("dq_movements_defects", _broken_oracle(kq.SQL_DQ_MOVEMENTS, "movements", MOVEMENTS))
def q_movements(spark, d):
    return dq.dq_movements(_break(Fixture(spark, d).movements(), MOVEMENTS))


_SQL_REQUESTS = _broken_oracle(kq.SQL_DQ_REQUESTS, "stock_requests", REQUESTS) + f"""
UNION ALL SELECT 'stock_requests', id, 'review_note_length' FROM (SELECT id, {NOTE} AS review_note FROM stock_requests)
WHERE length(review_note) > {REVIEW_NOTE_MAX}"""


@register("dq_stock_requests_defects", _SQL_REQUESTS)
def q_requests(spark, d):
    return dq.dq_stock_requests(_break(Fixture(spark, d).stock_requests(), REQUESTS).withColumn("review_note", F.expr(NOTE)))


def _far(column: str) -> dict[str, str]:
    return {column: _when(97, f"{column} + {FAR}", column, column)}


@register("dq_orphans_defects", with_views("\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(missing AS BIGINT) AS missing_id, COUNT(*) AS rows "
    f"FROM (SELECT {_far(c)[c]} AS missing FROM {child}) ANTI JOIN {parent} ON id = missing "
    f"WHERE missing IS NOT NULL GROUP BY missing" for t, c, child, parent in kq._LINKS),
    "follow_ups", "customers", "users", "movements", "products", "challans", "queries", "reviews", "replies",
    "stock_requests", extra=[("lines", kq._LINES)]))
def q_orphans(spark, d):
    f = kq._fixture_frames(Fixture(spark, d))
    return dq.dq_orphans([(t, c, _break(f[child], _far(c)), f[parent]) for t, c, child, parent in kq._LINKS])


@register("items_missing_product_defects", with_views(f"""
SELECT challan_id, CAST(COUNT(*) FILTER (WHERE p.id IS NULL) AS BIGINT) AS missing_items
FROM (SELECT challan_id, {_far('product_id')['product_id']} AS named FROM lines) LEFT JOIN products p ON p.id = named
GROUP BY challan_id HAVING COUNT(*) > COUNT(p.id)""", "products", extra=[("lines", kq._LINES)]))
def q_missing(spark, d):
    fx = Fixture(spark, d)
    return dq.items_missing_product(_break(fx.raw_lines(), _far("product_id")), fx.products())


# V10 with stored header totals: every fifty-third header is off by one.
@register("challan_totals_check_defects", _broken_oracle(with_views(kq._rules_sql("challans", "challans", "id", kq.CHALLAN_STATES),
                                                                   "challans"), "challans", CHALLANS) + """
UNION ALL SELECT 'challans', id, 'total_mismatch' FROM challans WHERE id % 53 = 0""")
def q_totals(spark, d):
    fx = Fixture(spark, d)
    sums = fx.raw_lines().groupBy("challan_id").agg(F.sum("quantity").alias("n"))
    off = F.when(F.col("id") % 53 == 0, 1).otherwise(0)
    headers = fx.challans().join(sums, F.col("id") == F.col("challan_id"), "left").select(
        "id", (F.coalesce("n", F.lit(0)) + off).alias("total_quantity"))
    return dq.challan_totals_check(_break(fx.challans(), CHALLANS), fx.raw_lines(), headers)
