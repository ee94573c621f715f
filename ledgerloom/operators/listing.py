"""Lists, search, paging and CSV export: P3-P7, T1, T3, A1, S3, S5, J1, J2.

A list request is one filtered DataFrame; the page and the total count are
two actions on it. Paging sorts by (created_at desc, id desc) so ties are
deterministic (Q12). ``keyset_page`` offers the seek form for deep pages.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import DASHBOARD_LIST, PAGE_MAX
from ledgerloom.functions.text import (check_challan_status, check_page, csv_safe, date_or_not_set, first_name, initial,
                                       search_predicate, wall_time)

CHALLAN_SEARCH = ["challan_number", "customer_name", "business_name"]
PRODUCT_SEARCH = ["product_name", "sku", "category"]
CUSTOMER_SEARCH = ["customer_name", "business_name", "mobile"]


def challan_totals(lines: DataFrame) -> DataFrame:
    """Total units per challan from its lines."""
    return lines.groupBy("challan_id").agg(F.sum("quantity").cast("bigint").alias("total_quantity"))


def challan_heads(challans: DataFrame, customers: DataFrame, users: DataFrame) -> DataFrame:
    """J1 without units: challans with customer, business and author; a stored
    ``total_quantity`` passes through."""
    cu = customers.select(F.col("id").alias("customer_id"), "customer_name", "business_name")
    u = users.select(F.col("id").alias("created_by"), F.col("name").alias("created_by_name"))
    return challans.join(cu, "customer_id", "inner").join(u, "created_by", "inner").select(*_head_columns(challans))


def search_heads(challans: DataFrame, customers: DataFrame, users: DataFrame, term: str | None) -> DataFrame:
    """P3 on the heads: names are matched once per customer, not once per challan."""
    named = search_predicate(CHALLAN_SEARCH[1:], term)
    if named is None:
        return challan_heads(challans, customers, users)
    cu = customers.select(F.col("id").alias("customer_id"), "customer_name", "business_name", named.alias("_named"))
    found = challans.join(cu, "customer_id", "inner").where(F.col("_named") | search_predicate(CHALLAN_SEARCH[:1], term))
    u = users.select(F.col("id").alias("created_by"), F.col("name").alias("created_by_name"))
    return found.join(u, "created_by", "inner").select(*_head_columns(challans))


def _head_columns(challans: DataFrame) -> list[str]:
    stored = ["total_quantity"] if "total_quantity" in challans.columns else []
    return ["id", "challan_number", *stored, "status", "created_at", "customer_name", "business_name", "created_by_name"]


def with_units(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """Total units (0 without lines) of a list of challans. A stored total is used as
    it is, and ``lines`` is not read; else both sides are read once."""
    if "total_quantity" in heads.columns:
        return heads
    tot = challan_totals(lines).withColumnRenamed("challan_id", "id")
    return heads.join(tot, "id", "left").select(*_listed())


def _listed() -> list[Column | str]:
    return ["id", "challan_number", F.coalesce("total_quantity", F.lit(0)).cast("bigint").alias("total_quantity"),
            "status", "created_at", "customer_name", "business_name", "created_by_name"]


def page_with_units(heads: DataFrame, lines: DataFrame) -> DataFrame:
    """The same for one page: its rows (at most ``PAGE_MAX``) are fetched once, and their
    ids go into the scan of the lines as a pushed-down list."""
    if "total_quantity" in heads.columns:
        return heads
    rows = heads.limit(PAGE_MAX).collect()
    few = heads.sparkSession.createDataFrame(rows, heads.schema)
    tot = challan_totals(lines.where(F.col("challan_id").isin([r.id for r in rows]))).withColumnRenamed("challan_id", "id")
    return few.join(tot, "id", "left").select(*_listed())


def challan_list(challans: DataFrame, customers: DataFrame, users: DataFrame, lines: DataFrame) -> DataFrame:
    """Challans with customer, business, author and total units (0 without lines)."""
    return with_units(challan_heads(challans, customers, users), lines)


def filter_challans(rows: DataFrame, term: str | None = None, status: str | None = None) -> DataFrame:
    """P3 + P6 on a challan list."""
    pred = search_predicate(CHALLAN_SEARCH, term)
    if pred is not None:
        rows = rows.where(pred)
    st = check_challan_status(status)
    if st is not None:
        rows = rows.where(F.col("status") == st)
    return rows


def newest_first(rows: DataFrame, time_col: str = "created_at", key: str = "id") -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(time_col), F.desc(key))


def page(rows: DataFrame, page_no: int = 1, limit: int = 20, time_col: str = "created_at",
         key: str = "id") -> DataFrame:
    """One page, newest first; offset = (page - 1) * limit."""
    offset, limit = check_page(page_no, limit)
    ordered = newest_first(rows, time_col, key)
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


def keyset_page(rows: DataFrame, after: tuple | None, limit: int = 20,
                time_col: str = "created_at", key: str = "id") -> DataFrame:
    """Seek paging: the rows strictly after (time, key) of the previous page's last row.

    ``after`` holds Python values or Columns (e.g. scalar subqueries). Unlike
    ``offset``, the cost does not grow with the page number: the predicate
    filters before the top-k.
    """
    if after is not None:
        t, k = after
        tl = t if isinstance(t, Column) else wall_time(t)
        kl = k if isinstance(k, Column) else F.lit(k)
        rows = rows.where((F.col(time_col) < tl) | ((F.col(time_col) == tl) & (F.col(key) < kl)))
    return newest_first(rows, time_col, key).limit(check_page(1, limit)[1])


def count_rows(rows: DataFrame, name: str = "total") -> DataFrame:
    """A1: the total under the list filter, as a one-row DataFrame."""
    return rows.agg(F.count(F.lit(1)).alias(name))


def recent_challans(challans: DataFrame, customers: DataFrame, n: int = DASHBOARD_LIST) -> DataFrame:
    """J2 + T3: the n newest challans with the customer name."""
    cu = customers.select(F.col("id").alias("customer_id"), "customer_name")
    return (newest_first(challans.join(cu, "customer_id", "inner")).limit(n)
            .select("id", "challan_number", "status", "created_at", "customer_name"))


def search_products(products_stock: DataFrame, term: str | None = None, low_only: bool = False) -> DataFrame:
    """P4 + P7."""
    pred = search_predicate(PRODUCT_SEARCH, term)
    rows = products_stock if pred is None else products_stock.where(pred)
    return rows.where(F.col("is_low_stock")) if low_only else rows


def search_customers(customers: DataFrame, term: str | None = None) -> DataFrame:
    """P5 (+ F21: the follow-up date as text, or "Not set")."""
    pred = search_predicate(CUSTOMER_SEARCH, term)
    rows = customers if pred is None else customers.where(pred)
    return rows.withColumn("follow_up_label", date_or_not_set(F.col("follow_up_date")))


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    """Case-insensitive e-mail equality (the sign-in lookup)."""
    return users.where(F.lower(F.col("email")) == F.lower(F.lit(email)))


def user_badges(users: DataFrame) -> DataFrame:
    """what the page head shows of a user: first word and first letter of the name."""
    return users.select("id", "name", "role", first_name(F.col("name")).alias("first_name"), initial(F.col("name")).alias("initial"))


def by_id(rows: DataFrame, key_value, key: str = "id") -> DataFrame:
    """S3: point lookup (a pushed-down equality filter)."""
    return rows.where(F.col(key) == F.lit(key_value))


EXPORT_HEADER = ["Challan", "Customer", "Business", "Status", "Units", "Created", "Created by"]


def challan_export(challan_rows: DataFrame, term: str | None = None, status: str | None = None) -> DataFrame:
    """S5 + T11: the export projection — text cells, formula prefixes neutralised, newest first."""
    rows = newest_first(filter_challans(challan_rows, term, status))
    return rows.select(
        csv_safe(F.col("challan_number")).alias("challan"),
        csv_safe(F.col("customer_name")).alias("customer"),
        csv_safe(F.col("business_name")).alias("business"),
        csv_safe(F.col("status")).alias("status"),
        csv_safe(F.col("total_quantity")).alias("units"),
        csv_safe(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).alias("created"),
        csv_safe(F.col("created_by_name")).alias("created_by"))


def write_export(export: DataFrame, path: str) -> None:
    """S5 sink: quoted CSV, ``"`` doubled, header per part file (no single-file funnel)."""
    renamed = export.toDF(*EXPORT_HEADER)
    (renamed.write.mode("overwrite").option("header", True).option("quoteAll", True)
     .option("escape", '"').option("emptyValue", "").csv(path))
