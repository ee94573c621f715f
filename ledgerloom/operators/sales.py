"""Sales reporting: A5-A14, J3-J5, N3, T7-T9.

Plan shape shared by every report: confirmed challans in the window are
joined to their lines on ``challan_id`` and folded to **one row per challan**
right after the join. Because the join already hash-partitions on
``challan_id``, grouping by ``(challan_id, …)`` adds no shuffle; every later
grouping (per day, per seller) moves one row per challan, never one per line,
and ``COUNT(DISTINCT challan)`` becomes a plain ``count(*)``. Dimension tables
(users, customers) are joined *after* aggregation where the output allows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import DAY_BAR_FLOOR_BP, SELLER_BAR_FLOOR_BP
from ledgerloom.functions.ordered import nest_ordered, nest_short
from ledgerloom.functions.text import check_days

MONEY = "decimal(18,2)"


def window_start(as_of: dt.date, days: int) -> Column:
    """``confirmed_at >= as_of - days`` (start day included, no upper bound)."""
    return F.date_sub(F.lit(as_of), check_days(days)).cast("timestamp_ntz")


def confirmed_in_window(challans: DataFrame, as_of: dt.date, days: int) -> DataFrame:
    pred = (F.col("status") == "CONFIRMED") & (F.col("confirmed_at") >= window_start(as_of, days))
    if "confirmed_month" in challans.columns:
        # Stored layout (sources/domain.py): the month partition column prunes whole folders.
        first_month = F.date_format(F.date_sub(F.lit(as_of), days), "yyyy-MM")
        pred = pred & (F.col("confirmed_month") >= first_month)
    return challans.where(pred)


def sales_lines(challans: DataFrame, items: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Confirmed challans in the window ⋈ their lines, with the line revenue."""
    c = confirmed_in_window(challans, as_of, days).select(
        F.col("id").alias("challan_id"), "challan_number", "customer_id", "created_by", "confirmed_at",
        F.to_date("confirmed_at").alias("sale_date"))
    return c.join(items, "challan_id", "inner").withColumn(
        "revenue", F.col("quantity") * F.col("unit_price_snapshot"))


def per_challan(lines: DataFrame, *extra: str) -> DataFrame:
    """One row per challan: revenue and units (partial + final aggregate, no new shuffle)."""
    return lines.groupBy("challan_id", *extra).agg(
        F.sum("revenue").alias("revenue"), F.sum("quantity").alias("units"))


def _measures() -> list[Column]:
    return [F.count(F.lit(1)).alias("challans"),
            F.coalesce(F.sum("revenue"), F.lit(0)).cast(MONEY).alias("revenue"),
            F.coalesce(F.sum("units"), F.lit(0)).cast("bigint").alias("units")]


def sales_daily(challans: DataFrame, items: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """A5: per sale date — challans, revenue, units; days without sales give no row."""
    pc = per_challan(sales_lines(challans, items, as_of, days), "sale_date")
    return pc.groupBy("sale_date").agg(*_measures()).orderBy("sale_date")


def sales_by_seller(challans: DataFrame, items: DataFrame, users: DataFrame,
                    as_of: dt.date, days: int = 30) -> DataFrame:
    """Per seller (the challan's creator) — grouped by id, sorted revenue desc, name asc."""
    pc = per_challan(sales_lines(challans, items, as_of, days), "created_by")
    by = pc.groupBy("created_by").agg(*_measures())
    u = users.select(F.col("id").alias("created_by"), F.col("name").alias("user_name"))
    return (by.join(u, "created_by", "inner")
              .select(F.col("created_by").alias("user_id"), "user_name", "challans", "revenue", "units")
              .orderBy(F.desc("revenue"), F.asc("user_name"), F.asc("user_id")))


def sales_detail(challans: DataFrame, items: DataFrame, users: DataFrame, customers: DataFrame,
                 as_of: dt.date, days: int = 30) -> DataFrame:
    """J5 + T7: one row per sold line with seller and customer names."""
    lines = sales_lines(challans, items, as_of, days)
    u = users.select(F.col("id").alias("created_by"), F.col("name").alias("seller_name"))
    cu = customers.select(F.col("id").alias("customer_id"), "customer_name", "business_name")
    return (lines.join(u, "created_by", "inner").join(cu, "customer_id", "inner")
                 .orderBy("sale_date", "confirmed_at", "challan_number", "product_name_snapshot", "sku_snapshot")
                 .select("sale_date", "challan_number", "seller_name", "customer_name", "business_name",
                         F.col("product_name_snapshot").alias("product_name"), F.col("sku_snapshot").alias("sku"),
                         "quantity", F.col("unit_price_snapshot").alias("unit_price"),
                         F.col("revenue").cast(MONEY).alias("revenue")))


def sales_period_total(challans: DataFrame, items: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """The window's total (sum of the daily rows) as one row."""
    pc = per_challan(sales_lines(challans, items, as_of, days))
    return pc.agg(F.lit(days).alias("days"), *_measures())


def sales_overview(challans: DataFrame, items: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """A5, A6 and A11 in one pass: ``report`` day, seller or total, with the day or the
    seller that the row is about. The lines are read and folded to one row per challan
    once; the grouping sets expand those rows, never lines."""
    pc = per_challan(sales_lines(challans, items, as_of, days), "sale_date", "created_by")
    sets = pc.groupingSets([[F.col("sale_date")], [F.col("created_by")], []], "sale_date", "created_by")
    out = sets.agg(F.grouping("sale_date").alias("all_days"), F.grouping("created_by").alias("all_sellers"), *_measures())
    report = F.when(F.col("all_days") == 0, "day").when(F.col("all_sellers") == 0, "seller").otherwise("total")
    return out.select(report.alias("report"), "sale_date", F.col("created_by").alias("user_id"), "challans", "revenue", "units")


def _share_bp(frame: DataFrame, floor_bp: int) -> DataFrame:
    """Bar length in basis points of the largest value, floored; max at least 1.

    The maximum is a scalar subquery over the (small) aggregate, not a
    one-partition window.
    """
    max_cents = frame.select(F.max((F.col("revenue") * 100).cast("bigint"))).scalar()
    with_cents = frame.withColumn("_cents", (F.col("revenue") * 100).cast("bigint")) \
                      .withColumn("_denom", F.greatest(F.coalesce(max_cents, F.lit(0)), F.lit(100)))
    share = F.expr("(_cents * 10000) div _denom")  # integral division: exact
    return with_cents.withColumn("bar_bp", F.greatest(F.lit(floor_bp).cast("bigint"), share)) \
                     .drop("_cents", "_denom")


def seller_share_of_max(challans: DataFrame, items: DataFrame, users: DataFrame,
                        as_of: dt.date, days: int = 30) -> DataFrame:
    return _share_bp(sales_by_seller(challans, items, users, as_of, days), SELLER_BAR_FLOOR_BP)


def day_share_of_max(challans: DataFrame, items: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    return _share_bp(sales_daily(challans, items, as_of, days), DAY_BAR_FLOOR_BP)


def _named_lines(challans, items, users, customers, as_of, days):
    lines = sales_lines(challans, items, as_of, days)
    u = users.select(F.col("id").alias("created_by"), F.col("name").alias("seller_name"))
    cu = customers.select(F.col("id").alias("customer_id"), "customer_name")
    return lines.join(u, "created_by", "inner").join(cu, "customer_id", "inner").select(
        F.col("created_by").alias("user_id"), "sale_date", "confirmed_at", "challan_number", "seller_name",
        "customer_name", F.col("product_name_snapshot").alias("product_name"), F.col("sku_snapshot").alias("sku"),
        "quantity", F.col("revenue").cast(MONEY).alias("revenue"))


def sales_day_lines(challans: DataFrame, items: DataFrame, users: DataFrame, customers: DataFrame,
                    as_of: dt.date, days: int = 30, chunk_size: int = 1000) -> DataFrame:
    """Each sale date with its line details in report order (bounded chunks).

    Positions inside a day are split by the hour of confirmation, so a very
    busy day is numbered by many tasks.
    """
    d = _named_lines(challans, items, users, customers, as_of, days)
    return nest_ordered(d, ["sale_date"],
                        ["confirmed_at", "challan_number", "product_name", "sku", "quantity", "revenue"],
                        ["challan_number", "seller_name", "customer_name", "product_name", "sku", "quantity", "revenue"],
                        "lines", chunk_size)


def sales_seller_lines(challans: DataFrame, items: DataFrame, users: DataFrame, customers: DataFrame,
                       as_of: dt.date, days: int = 30, chunk_size: int = 1000) -> DataFrame:
    """Each seller (grouped by id, Q9) with the lines they sold, in report order."""
    d = _named_lines(challans, items, users, customers, as_of, days)
    return nest_ordered(d, ["user_id"],
                        ["sale_date", "confirmed_at", "challan_number", "product_name", "sku", "quantity", "revenue"],
                        ["sale_date", "challan_number", "customer_name", "product_name", "sku", "quantity", "revenue"],
                        "lines", chunk_size)


# -- challan documents (re-aimed from the PDF) -----------------------------------

def challan_header(challans: DataFrame, customers: DataFrame, users: DataFrame) -> DataFrame:
    """Challans ⋈ customers ⋈ users (inner, 3-way)."""
    cu = customers.select(F.col("id").alias("customer_id"), "customer_name", "business_name")
    u = users.select(F.col("id").alias("created_by"), F.col("name").alias("created_by_name"))
    return challans.join(cu, "customer_id", "inner").join(u, "created_by", "inner")


def challan_document_totals(challans: DataFrame, items: DataFrame) -> DataFrame:
    """A10: per challan — lines, total units, total value (decimal, Q11); zeros without items."""
    per = items.groupBy("challan_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("quantity").cast("bigint").alias("total_units"),
        F.sum(F.col("quantity") * F.col("unit_price_snapshot")).cast(MONEY).alias("total_value"))
    return challans.select(F.col("id").alias("challan_id")).join(per, "challan_id", "left").select(
        "challan_id", *(F.coalesce(c, F.lit(0)).cast(per.schema[c].dataType).alias(c)
                        for c in ("lines", "total_units", "total_value")))


def challan_document(challans: DataFrame, items: DataFrame, customers: DataFrame, users: DataFrame,
                     chunk_size: int = 1000) -> DataFrame:
    """Challan header with its items ordered by product name (bounded chunks);
    a challan without items has one chunk with an empty array.

    Each item carries both the unit price and the line total (Q10).
    """
    line_total = (F.col("quantity") * F.col("unit_price_snapshot")).cast(MONEY).alias("line_total")
    nested = nest_short(items, ["challan_id"], ["product_name_snapshot", "sku_snapshot", "quantity", "line_no"],
                        ["product_id", "product_name_snapshot", "sku_snapshot", "unit_price_snapshot",
                         "quantity", line_total],
                        "items", chunk_size)
    head = challan_header(challans, customers, users).select(
        F.col("id").alias("challan_id"), "challan_number", "status", "created_at", "confirmed_at",
        "customer_id", "customer_name", "business_name", "created_by_name")
    return head.join(nested, "challan_id", "left").withColumns({
        "chunk_no": F.coalesce("chunk_no", F.lit(0)),
        "items": F.coalesce("items", F.array().cast(nested.schema["items"].dataType))})
