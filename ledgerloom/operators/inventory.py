"""Stock ledger: A18-A19, P2, P7, P17, T2, WN1, WN3, J6, W2.

Stock is never stored: it is derived from the append-only movement ledger as
``Σ IN − Σ OUT`` per product. The aggregate is partial/final, so a product
with a huge share of movements costs one map-side row per partition.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import DASHBOARD_LIST, OPENING_STOCK_REASON, PAGE_DEFAULT
from ledgerloom.functions.ordered import running_sum
from ledgerloom.functions.text import wall_time


def signed_quantity() -> Column:
    return F.when(F.col("movement_type") == "IN", F.col("quantity_changed")).otherwise(-F.col("quantity_changed"))


def stock_levels(movements: DataFrame, until: dt.datetime | None = None) -> DataFrame:
    """Current stock per product from the ledger (optionally up to ``until``, exclusive)."""
    m = movements
    if until is not None:
        m = m.where(F.col("created_at") < wall_time(until))
        if "created_month" in m.columns:   # stored layout: prune later month folders
            m = m.where(F.col("created_month") <= F.lit(until.strftime("%Y-%m")))
    return m.groupBy("product_id").agg(F.sum(signed_quantity()).cast("bigint").alias("current_stock"))


def stock_levels_at(movements: DataFrame, cuts: dict[str, dt.datetime | None]) -> DataFrame:
    """Stock per product at several cut-offs in one pass over the ledger.

    ``cuts`` maps an output column to an exclusive upper bound on
    ``created_at`` (None = everything). One scan and one shuffle, however many
    cut-offs are asked for.
    """
    signed = signed_quantity()
    return movements.groupBy("product_id").agg(*[
        F.coalesce(F.sum(signed if until is None else
                         F.when(F.col("created_at") < wall_time(until), signed)), F.lit(0))
        .cast("bigint").alias(name) for name, until in cuts.items()])


def products_with_stock(products: DataFrame, levels: DataFrame) -> DataFrame:
    """P2 + P17: products with ledger stock, the inclusive low-stock flag and its label."""
    lv = levels.select(F.col("product_id").alias("id"), "current_stock")
    stock = F.coalesce(F.col("current_stock"), F.lit(0)).cast("bigint")
    low = stock <= F.col("minimum_stock_alert_quantity")
    return (products.join(lv, "id", "left")
            .withColumn("current_stock", stock)
            .withColumn("is_low_stock", low)
            .withColumn("stock_status", F.when(low, "Low stock").otherwise("Healthy")))


def low_stock_products(products_stock: DataFrame) -> DataFrame:
    """The low-stock filter of the product list (no paging: the whole filtered set)."""
    return products_stock.where(F.col("is_low_stock"))


def low_stock_top(products_stock: DataFrame, n: int = DASHBOARD_LIST) -> DataFrame:
    """The n lowest-stock low-stock products (ties by id); a top-k, not a global sort."""
    return (low_stock_products(products_stock)
            .orderBy(F.asc("current_stock"), F.asc("id")).limit(n)
            .select("id", "product_name", "sku", "current_stock", "minimum_stock_alert_quantity"))


def stock_running_balance(movements: DataFrame) -> DataFrame:
    """WN1: balance after each movement, per product in time order.

    Movements at the same instant are peers (RANGE frame), so the result does
    not depend on an arbitrary tie order. They are summed first, and the
    sums are cut into ranges (``functions.ordered``), so a hot product or a hot
    instant is spread over many tasks.
    """
    m = movements.withColumn("signed", signed_quantity())
    out = running_sum(m, ["product_id"], ["created_at"], "signed", "balance", frame="range")
    return out.select("product_id", "created_at", "movement_type", "quantity_changed", "reference_type",
                      "reference_id", F.col("balance").cast("bigint").alias("balance"))


def first_negative_balance(balances: DataFrame) -> DataFrame:
    """WN1: the first moment each product's balance went below zero."""
    return (balances.where(F.col("balance") < 0).groupBy("product_id")
            .agg(F.min("created_at").alias("first_negative_at"), F.min("balance").alias("lowest_balance")))


def _move_order() -> list[Column]:
    return [F.desc("created_at"), F.asc("reason"), F.asc("movement_type"), F.asc("quantity_changed"),
            F.asc("created_by"), F.asc("reference_type"), F.asc_nulls_first("reference_id")]


def latest_movements_per_product(movements: DataFrame, users: DataFrame, n: int = PAGE_DEFAULT) -> DataFrame:
    """WN3 + J6: the newest n movements of every product with the author's name.

    ``row_number() <= n`` is planned as a partial per-partition limit before
    the shuffle (WindowGroupLimit), so a hot product ships at most n rows per
    map task. Users are joined after the limit.
    """
    w = Window.partitionBy("product_id").orderBy(*_move_order())
    top = movements.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    u = users.select(F.col("id").alias("created_by"), F.col("name").alias("created_by_name"))
    return top.join(u, "created_by", "inner").select(
        "product_id", "rank", "created_at", "movement_type", "quantity_changed", "reason",
        "reference_type", "reference_id", "created_by_name")


def stock_movement_history(movements: DataFrame, users: DataFrame, product_id: int | None = None,
                           offset: int = 0, limit: int | None = None) -> DataFrame:
    """J6 + T1 + A1: a product's movements newest first with authors, and its total count.

    Without ``product_id`` every product's full history is returned.
    """
    m = movements if product_id is None else movements.where(F.col("product_id") == F.lit(product_id))
    counts = m.groupBy("product_id").agg(F.count(F.lit(1)).alias("total"))
    u = users.select(F.col("id").alias("created_by"), F.col("name").alias("created_by_name"))
    out = m.join(u, "created_by", "inner").join(counts, "product_id", "inner").select(
        "product_id", "created_at", "movement_type", "quantity_changed", "reason", "reference_type",
        "reference_id", "created_by_name", "total")
    if limit is not None:
        out = out.orderBy(*_move_order()).offset(offset).limit(limit)
    return out


def stock_reconciliation(stored: DataFrame, movements: DataFrame) -> DataFrame:
    """Products whose stored stock differs from the ledger sum."""
    ledger = stock_levels(movements).withColumnRenamed("current_stock", "ledger_stock")
    st = stored.select(F.col("id").alias("product_id"), F.col("current_stock").cast("bigint").alias("stored_stock"))
    j = st.join(ledger, "product_id", "full_outer")
    stored_v = F.coalesce(F.col("stored_stock"), F.lit(0))
    ledger_v = F.coalesce(F.col("ledger_stock"), F.lit(0))
    return (j.select("product_id", stored_v.alias("stored_stock"), ledger_v.alias("ledger_stock"),
                     (ledger_v - stored_v).alias("difference"))
             .where(F.col("difference") != 0))


def opening_movements(new_products: DataFrame, created_by: Column | int = 0,
                      created_at: Column | dt.datetime | None = None) -> DataFrame:
    """A product created with stock > 0 also yields one OPENING_STOCK IN movement."""
    by = created_by if isinstance(created_by, Column) else F.lit(created_by).cast("bigint")
    at = (created_at if isinstance(created_at, Column)
          else wall_time(created_at) if created_at is not None else F.col("created_at"))
    return new_products.where(F.col("current_stock") > 0).select(
        F.col("id").alias("product_id"),
        F.col("current_stock").cast("int").alias("quantity_changed"),
        F.lit("IN").alias("movement_type"),
        F.lit(OPENING_STOCK_REASON).alias("reason"),
        F.lit("OPENING_STOCK").alias("reference_type"),
        F.lit(None).cast("bigint").alias("reference_id"),
        by.alias("created_by"),
        at.alias("created_at"))


def seed_movements(products: DataFrame, movements: DataFrame, created_by: Column | int = 0, created_at: dt.datetime | None = None) -> DataFrame:
    """The opening movement of every product that has none yet, so that loading a
    catalogue twice opens its stock once."""
    opened = movements.where(F.col("reference_type") == "OPENING_STOCK").select(F.col("product_id").alias("id"))
    return opening_movements(products.join(opened, "id", "left_anti"), created_by, created_at)
