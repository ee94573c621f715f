"""S8 with P12 and J18: sales history loaded by name, month by month.

History names its author by e-mail, its customer by name and its product by sku. The
names are resolved by joins with one row per name, so a name that is not known or
that several records share gets an outcome instead of a guess. Loaded sales are
stored by load and month; loading again replaces the months that the load has and
no others, so a load that runs twice, or after a crash, counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("challan_number string, customer_id bigint, created_by bigint, product_id bigint, product_name_snapshot string, "
           "sku_snapshot string, unit_price_snapshot decimal(12,2), quantity int, confirmed_at timestamp_ntz")


def _by_name(rows: DataFrame, name: str, key: str, *more: str) -> DataFrame:
    """One row per name: the record's id, how many records have the name, and columns
    of the record with the smallest id."""
    return rows.where(F.col(name).isNotNull()).groupBy(F.col(name).alias(key)).agg(
        F.min("id").alias(f"_{key}_id"), F.count(F.lit(1)).alias(f"_{key}_n"), *(F.min_by(c, "id").alias(f"_{c}") for c in more))


def _found(key: str) -> Column:
    n = F.col(f"_{key}_n")
    return F.when(n.isNull(), f"unknown_{key}").when(n > 1, f"ambiguous_{key}")


def resolve(sales: DataFrame, users: DataFrame, customers: DataFrame, products: DataFrame) -> DataFrame:
    """``sales`` (challan_number, user, customer, product, quantity, confirmed_at,
    by names) with the records' ids, the product's snapshot, and an ``outcome``:
    ``loaded``, or the first name that does not stand for one record. A name that is
    null is unknown."""
    out = (sales.join(_by_name(users, "email", "user"), "user", "left")
           .join(_by_name(customers, "customer_name", "customer"), "customer", "left")
           .join(_by_name(products, "sku", "product", "product_name", "unit_price"), "product", "left"))
    outcome = F.coalesce(_found("user"), _found("customer"), _found("product"), F.lit("loaded"))
    return out.select(
        "challan_number", F.col("_customer_id").alias("customer_id"), F.col("_user_id").alias("created_by"), F.col("_product_id").alias("product_id"),
        F.col("_product_name").alias("product_name_snapshot"), F.col("product").alias("sku_snapshot"),
        F.col("_unit_price").cast("decimal(12,2)").alias("unit_price_snapshot"), F.col("quantity").cast("int").alias("quantity"), "confirmed_at",
        outcome.alias("outcome"))


def load(resolved: DataFrame, path: str, name: str) -> None:
    """Store the resolved sales of one load; its months that are stored already are
    replaced, other months and other loads stay as they are."""
    rows = resolved.where("outcome = 'loaded'").drop("outcome").select(
        "*", F.lit(name).alias("load"), F.date_format("confirmed_at", "yyyy-MM").alias("month"))
    (rows.repartitionByRange("month", "confirmed_at", "challan_number").sortWithinPartitions("load", "month", "confirmed_at")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load", "month").parquet(path))


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{COLUMNS}, load string, month string").parquet(path)


def numbered_like(rows: DataFrame, prefix: str, column: str = "challan_number") -> DataFrame:
    """Rows whose number begins with the prefix, ``%`` and ``_`` as they are; the
    filter reaches the scan."""
    return rows.where(F.col(column).startswith(F.lit(prefix)))
