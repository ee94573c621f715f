"""CRM views: N1, N2, A16, J7-J9, P9, P11, T4, A2-A3.

Nested results (customer -> follow-ups, question -> replies) are built from
pre-aggregated, bounded chunks (``nest_ordered``) and attached to their
parents; a parent without children keeps one row with an empty array.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import DASHBOARD_LIST, FOLLOW_UP_HORIZON_DAYS
from ledgerloom.functions.ordered import nest_ordered, positions
from ledgerloom.functions.text import stars


def _authors(users: DataFrame, key: str = "created_by", name: str = "created_by_name") -> DataFrame:
    return users.select(F.col("id").alias(key), F.col("name").alias(name))


def _attach(parents: DataFrame, parent_key: str, nested: DataFrame, children: DataFrame, child_key: str, arr: str) -> DataFrame:
    """Parents with their bounded child chunks; parents without children get chunk 0 and [].

    Written as an inner join (AQE can split a skewed side of an inner join,
    not the outer side of a left join) plus the childless parents found by an
    anti join against the keys of the ungrouped ``children``.
    """
    n = nested.withColumnRenamed(child_key, parent_key)
    with_children = parents.join(n, parent_key, "inner")
    empty = F.array().cast(nested.schema[arr].dataType)
    childless = (parents.join(children.select(F.col(child_key).alias(parent_key)).distinct(), parent_key, "left_anti")
                 .withColumn("chunk_no", F.lit(0)).withColumn(arr, empty))
    return with_children.unionByName(childless)


def customer_timeline(customers: DataFrame, follow_ups: DataFrame, users: DataFrame,
                      chunk_size: int = 1000) -> DataFrame:
    """N1 + J7 + T10: each customer with its follow-ups, newest first."""
    fu = follow_ups.join(_authors(users), "created_by", "inner")
    nested = nest_ordered(fu, ["customer_id"], [F.desc("created_at"), F.desc("id")],
                          ["id", "note", "follow_up_date", "created_at", "created_by_name"],
                          "follow_ups", chunk_size)
    head = customers.select("id", "customer_name", "business_name", "mobile", "status", "follow_up_date")
    return _attach(head, "id", nested, fu, "customer_id", "follow_ups")


def customer_query_threads(queries: DataFrame, replies: DataFrame, users: DataFrame,
                           chunk_size: int = 1000) -> DataFrame:
    """N2 + A16 + J8: each customer question with its replies, oldest first."""
    rp = replies.join(_authors(users), "created_by", "inner")
    nested = nest_ordered(rp, ["query_id"], ["turn"], ["turn", "message", "created_by_name"],
                          "replies", chunk_size)
    head = queries.select("id", "customer_id", "subject", "status", "priority")
    return _attach(head, "id", nested, rp, "query_id", "replies")


def query_replies(queries: DataFrame, replies: DataFrame, users: DataFrame) -> DataFrame:
    """Replies ⋈ questions ⋈ users (flat)."""
    q = queries.select(F.col("id").alias("query_id"), "customer_id")
    return (replies.join(q, "query_id", "inner").join(_authors(users), "created_by", "inner")
            .select("query_id", "customer_id", "turn", "message", "created_by_name"))


def customer_reviews(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """J9 + F20: reviews with author and a star string."""
    return reviews.join(_authors(users), "created_by", "inner").select(
        "id", "customer_id", "rating", stars(F.col("rating")).alias("stars"), "review", "created_by_name")


def customer_question_list(queries: DataFrame, replies: DataFrame) -> DataFrame:
    """Each customer's questions, newest first (``nth`` from 1; those without a
    time come last, ties by the larger id), with the number of replies."""
    n = replies.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n_replies"))
    listed = positions(queries, ["customer_id"], [F.desc_nulls_last("created_at"), F.desc("id")], "nth")
    return listed.join(n, "id", "left").select(
        "customer_id", "nth", "id", "subject", "message", "status", "priority", "created_at", "resolved_at",
        F.coalesce("n_replies", F.lit(0)).cast("bigint").alias("n_replies"))


def customer_review_list(reviews: DataFrame, users: DataFrame) -> DataFrame:
    """T10 + J9: each customer's reviews, newest first (as the questions are)."""
    shown = reviews.join(_authors(users), "created_by", "inner")
    listed = positions(shown, ["customer_id"], [F.desc_nulls_last("created_at"), F.desc("id")], "nth")
    return listed.select("customer_id", "nth", "id", "rating", "review", "created_at", "created_by_name")


def open_queries(queries: DataFrame) -> DataFrame:
    """Questions not yet resolved (OPEN and IN_PROGRESS)."""
    return queries.where(F.col("status") != "RESOLVED")


def followups_due(customers: DataFrame, as_of: dt.date, horizon: int = FOLLOW_UP_HORIZON_DAYS) -> DataFrame:
    """Customers whose follow-up date is in [as_of, as_of + horizon] (both ends)."""
    d = F.col("follow_up_date")
    return customers.where(d.isNotNull() & d.between(F.lit(as_of), F.date_add(F.lit(as_of), horizon)))


def upcoming_followups(customers: DataFrame, as_of: dt.date, n: int = DASHBOARD_LIST) -> DataFrame:
    """T4: the n soonest follow-ups from as_of on (ties by id)."""
    d = F.col("follow_up_date")
    return (customers.where(d.isNotNull() & (d >= F.lit(as_of)))
            .orderBy(F.asc("follow_up_date"), F.asc("id")).limit(n)
            .select("id", "customer_name", "business_name", "follow_up_date", "status"))


def dashboard_metrics(customers: DataFrame, products_stock: DataFrame) -> DataFrame:
    """A2 + A3: customer and product totals and the exact low-stock count (Q1, Q2)."""
    n_products = products_stock.select(F.count(F.lit(1))).scalar()
    n_low = products_stock.select(F.sum(F.when(F.col("is_low_stock"), 1).otherwise(0))).scalar()
    return customers.agg(F.count(F.lit(1)).alias("total_customers")).select(
        "total_customers", n_products.alias("total_products"),
        F.coalesce(n_low, F.lit(0)).cast("bigint").alias("low_stock_count"))
