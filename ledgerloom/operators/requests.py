"""Stock requests: J10, P10, T6, A15, T12."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import DASHBOARD_LIST
from ledgerloom.functions.text import check_request_status

SEE_ALL_ROLES = ("WAREHOUSE", "ADMIN")


def stock_requests_list(requests: DataFrame, products_stock: DataFrame, users: DataFrame,
                        status: str | None = None, role: str | None = None, user_id=None) -> DataFrame:
    """J10 + T6: requests with product, stock, requester and (left-joined) reviewer.

    ``role``/``user_id`` apply the visibility rule P10: WAREHOUSE and ADMIN see
    every request, anyone else only their own. PENDING first, then newest.
    """
    st = check_request_status(status)
    r = requests if st is None else requests.where(F.col("status") == st)
    if role is not None and role not in SEE_ALL_ROLES:
        r = r.where(F.col("requested_by") == F.lit(user_id))
    p = products_stock.select(F.col("id").alias("product_id"), "product_name", "sku", "current_stock")
    requester = users.select(F.col("id").alias("requested_by"), F.col("name").alias("requested_by_name"))
    reviewer = users.select(F.col("id").alias("reviewed_by"), F.col("name").alias("reviewed_by_name"))
    return (r.join(p, "product_id", "inner").join(requester, "requested_by", "inner")
             .join(reviewer, "reviewed_by", "left")
             .orderBy(F.when(F.col("status") == "PENDING", 0).otherwise(1), F.desc("created_at"), F.desc("id"))
             .select("id", "product_id", "product_name", "sku", "current_stock", "quantity", "urgency",
                     "message", "status", "created_at", "requested_by_name", "reviewed_by_name"))


def warehouse_queue(requests: DataFrame, products_stock: DataFrame) -> DataFrame:
    """Pending requests, low-stock items and their sum — exact counts (not list lengths)."""
    n_low = products_stock.select(F.sum(F.when(F.col("is_low_stock"), 1).otherwise(0))).scalar()
    pending = requests.agg(F.sum(F.when(F.col("status") == "PENDING", 1).otherwise(0)).alias("p"))
    p = F.coalesce(F.col("p"), F.lit(0)).cast("bigint")
    low = F.coalesce(n_low, F.lit(0)).cast("bigint")
    return pending.select(p.alias("pending_requests"), low.alias("low_stock_items"),
                          (p + low).alias("warehouse_tasks"))


def pending_top(request_rows: DataFrame, n: int = DASHBOARD_LIST) -> DataFrame:
    """The first n pending requests of the ordered list."""
    return (request_rows.where(F.col("status") == "PENDING")
            .orderBy(F.desc("created_at"), F.desc("id")).limit(n))
