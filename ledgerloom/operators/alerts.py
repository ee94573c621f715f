"""Alert reconciliation and per-user inbox: AL1-AL3, U1, W12-W14, J12-J14, A4, T5.

The application reconciles alerts with three upserts and one delete. Here
the whole reconciliation is one plan: the live alerts (a union of three
derived sources) are full-outer-joined with the stored snapshot on the
natural key (type, related_type, related_id). Matched rows keep their id and
creation time and take the new texts; unmatched live rows are new; unmatched
stored rows are stale and disappear together with their read marks (so an
alert that comes back is unread again). Ids derive from the natural key
(F10), so a retried job produces the same ids.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import ALERT_DETAIL_CHARS, FOLLOW_UP_HORIZON_DAYS, INBOX_SIZE
from ledgerloom.functions.text import month_day, type_label, wall_time
from ledgerloom.sources.domain import DOMAIN_SCHEMAS
from ledgerloom.sources.keyed import KeyedTable
from ledgerloom.sources.scratch import written

KEY = ["type", "related_type", "related_id"]
COLUMNS = ["id", "type", "title", "detail", "priority", "related_type", "related_id", "created_at"]


def alert_id(type_col: Column, related_type: Column, related_id: Column) -> Column:
    """a deterministic id from the natural key (retries give the same id)."""
    return F.sha2(F.concat_ws("|", type_col, related_type, related_id.cast("string")), 256)


def alerts_low_stock(products_stock: DataFrame) -> DataFrame:
    """AL1: one HIGH alert per product at or below its minimum."""
    return products_stock.where(F.col("current_stock") <= F.col("minimum_stock_alert_quantity")).select(
        F.lit("LOW_STOCK").alias("type"), F.lit("Low stock:").alias("title"),
        F.concat(F.col("product_name"), F.lit(" has "), F.col("current_stock").cast("string"),
                 F.lit(" units left")).alias("detail"),
        F.lit("HIGH").alias("priority"), F.lit("PRODUCT").alias("related_type"),
        F.col("id").alias("related_id"))


def alerts_follow_up(customers: DataFrame, as_of: dt.date, horizon: int = FOLLOW_UP_HORIZON_DAYS) -> DataFrame:
    """AL2: MEDIUM alert per customer whose follow-up is due within [as_of, as_of + 7]."""
    d = F.col("follow_up_date")
    due = customers.where(d.isNotNull() & d.between(F.lit(as_of), F.date_add(F.lit(as_of), horizon)))
    return due.select(
        F.lit("FOLLOW_UP").alias("type"), F.lit("Follow-up due:").alias("title"),
        F.concat(F.col("customer_name"), F.lit(" / "), F.col("business_name"), F.lit(" / "),
                 month_day(d)).alias("detail"),
        F.lit("MEDIUM").alias("priority"), F.lit("CUSTOMER").alias("related_type"),
        F.col("id").alias("related_id"))


def alerts_open_query(queries: DataFrame, customers: DataFrame) -> DataFrame:
    """AL3 + J11: alert per unresolved customer question, with its own priority."""
    cu = customers.select(F.col("id").alias("customer_id"), "customer_name")
    q = queries.where(F.col("status") != "RESOLVED").join(cu, "customer_id", "inner")
    return q.select(
        F.lit("CUSTOMER_QUERY").alias("type"),
        F.concat(F.lit("Open query: "), F.col("subject")).alias("title"),
        F.concat(F.col("customer_name"), F.lit(" / "),
                 F.substring("message", 1, ALERT_DETAIL_CHARS)).alias("detail"),
        F.col("priority"), F.lit("QUERY").alias("related_type"), F.col("id").alias("related_id"))


def alerts_live(products_stock: DataFrame, customers: DataFrame, queries: DataFrame, as_of: dt.date) -> DataFrame:
    """The three sources in one shape (UNION ALL)."""
    return (alerts_low_stock(products_stock)
            .unionByName(alerts_follow_up(customers, as_of))
            .unionByName(alerts_open_query(queries, customers)))


def as_snapshot(live: DataFrame, created_at: dt.datetime) -> DataFrame:
    """Live alerts as stored rows (id from the key, creation time given)."""
    return live.select(alert_id(F.col("type"), F.col("related_type"), F.col("related_id")).alias("id"),
                       "type", "title", "detail", "priority", "related_type", "related_id",
                       wall_time(created_at).alias("created_at"))


def alerts_merge(stored: DataFrame, live: DataFrame, now: dt.datetime) -> DataFrame:
    """W13 + W14: the reconciled snapshot.

    Matched: keep id and created_at, update title/detail/priority. New: id
    from the key, created_at = ``now``. Stale (stored only): dropped.
    """
    s = stored.select(*KEY, F.col("id").alias("s_id"), F.col("created_at").alias("s_created_at"))
    lv = live.select(*KEY, "title", "detail", "priority")
    j = lv.join(s, KEY, "left")  # the full outer join's stale side is the delete: not kept
    return j.select(
        F.coalesce(F.col("s_id"), alert_id(F.col("type"), F.col("related_type"), F.col("related_id"))).alias("id"),
        "type", "title", "detail", "priority", "related_type", "related_id",
        F.coalesce(F.col("s_created_at"), wall_time(now)).alias("created_at"))


def stale_alerts(stored: DataFrame, live: DataFrame) -> DataFrame:
    """Stored alerts with no live source (to delete)."""
    return stored.join(live.select(*KEY), KEY, "left_anti")


ALERT_BUCKETS = 64


def alert_table(path: str, buckets: int = ALERT_BUCKETS) -> KeyedTable:
    """The stored alerts, keyed by (type, related_type, related_id)."""
    return KeyedTable(path, DOMAIN_SCHEMAS["notifications"], tuple(KEY), buckets)


def low_stock_keys(levels: DataFrame) -> DataFrame:
    """The natural keys that a change of these products' stock can concern."""
    return levels.select(F.lit("LOW_STOCK").alias("type"), F.lit("PRODUCT").alias("related_type"), F.col("product_id").alias("related_id"))


def alert_changes(stored: DataFrame, live: DataFrame, now: dt.datetime) -> tuple[DataFrame, DataFrame]:
    """W13 and W14 as changes: rows to put (new ones, and those whose texts or priority
    differ) and stored rows to delete."""
    merged = alerts_merge(stored, live, now)
    told = ["title", "detail", "priority"]
    was = stored.select(*KEY, F.struct(*told).alias("was"))
    puts = merged.join(was, KEY, "left").where(F.col("was").isNull() | (F.struct(*told) != F.col("was"))).drop("was")
    return puts.select(*COLUMNS), stale_alerts(stored, live)


def reconcile_touched(table: KeyedTable, touched: DataFrame, live: DataFrame, now: dt.datetime) -> list[int]:
    """Bring the stored alerts of the ``touched`` natural keys in line with ``live`` (the
    live alerts of just these keys). Only the buckets that hold them are read, and
    only those in which a row changes are rewritten; returns their numbers."""
    spark = touched.sparkSession
    touched = written(touched.select(*KEY).distinct(), "alerts-touched")
    stored = table.near(spark, table.touched(touched)).join(touched, KEY, "left_semi")
    puts, deletes = alert_changes(stored, live, now)
    changes = written(puts.withColumn("_put", F.lit(True)).unionByName(deletes.select(*COLUMNS).withColumn("_put", F.lit(False))), "alerts-changes")
    return table.apply(changes.where("_put").drop("_put"), changes.where("NOT _put").drop("_put"))


def surviving_reads(reads: DataFrame, snapshot: DataFrame) -> DataFrame:
    """W14 cascade: read marks of deleted alerts go away with them."""
    return reads.join(snapshot.select(F.col("id").alias("notification_id")), "notification_id", "left_semi")


def inbox(snapshot: DataFrame, reads: DataFrame, user_id, n: int = INBOX_SIZE) -> DataFrame:
    """J12 + T5: the user's latest alerts, unread first, newest first, n rows."""
    mine = reads.where(F.col("user_id") == F.lit(user_id)).select(
        F.col("notification_id").alias("id"), "read_at")
    j = snapshot.join(mine, "id", "left")
    return (j.orderBy(F.col("read_at").isNull().desc(), F.desc("created_at"), F.asc("id")).limit(n)
             .select("id", "type", type_label(F.col("type")).alias("type_label"), "title", "detail", "priority",
                     "read_at", "created_at"))


def unread_count(snapshot: DataFrame, reads: DataFrame, user_id) -> DataFrame:
    """J13 + A4: alerts the user has not read (all of them, not just the inbox page)."""
    mine = reads.where(F.col("user_id") == F.lit(user_id)).select(F.col("notification_id").alias("id"))
    return snapshot.join(mine, "id", "left_anti").agg(F.count(F.lit(1)).alias("unread_count"))


def mark_read(snapshot: DataFrame, reads: DataFrame, user_id, at: dt.datetime,
              notification_ids: DataFrame | None = None) -> DataFrame:
    """Mark all (or the given) alerts read; an existing mark keeps its first time.

    Returns the complete read table afterwards.
    """
    targets = snapshot.select(F.col("id").alias("notification_id"))
    if notification_ids is not None:
        targets = targets.join(notification_ids.select("notification_id"), "notification_id", "left_semi")
    mine = reads.where(F.col("user_id") == F.lit(user_id)).select("notification_id")
    new = targets.join(mine, "notification_id", "left_anti").select(
        "notification_id", F.lit(user_id).cast("bigint").alias("user_id"),
        wall_time(at).alias("read_at"))
    return reads.select("notification_id", "user_id", "read_at").unionByName(new)
