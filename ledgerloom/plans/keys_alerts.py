"""Registered alert keys.

Fixture state: the stored snapshot is the reconciliation as it ran a week
before AS_OF (ledger up to then, the follow-up window of then); user 1 read
every stored alert whose related id is divisible by 3 the day after. The
keys then reconcile at AS_OF.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import functions as F

from ledgerloom.config import AS_OF
from ledgerloom.operators import alerts as al
from ledgerloom.operators import inventory as inv
from ledgerloom.operators import quality as dq
from ledgerloom.plans.oracle import with_views
from ledgerloom.plans.registry import register
from ledgerloom.sources.fixtures import Fixture
from ledgerloom.sources.scratch import written
from ledgerloom.functions.text import wall_time

PREV = AS_OF - dt.timedelta(days=7)
PREV_AT = dt.datetime.combine(PREV, dt.time())
PREV_UNTIL = PREV_AT + dt.timedelta(days=1)
NOW = dt.datetime.combine(AS_OF, dt.time())
READER = 1


def _ts(x: dt.datetime) -> str:
    return f"TIMESTAMP '{x:%Y-%m-%d %H:%M:%S}'"


def _live_sql(stock_view: str, day: dt.date) -> str:
    d = f"DATE '{day:%Y-%m-%d}'"
    return f"""
SELECT 'LOW_STOCK' AS type, 'Low stock:' AS title, product_name || ' has ' || current_stock || ' units left' AS detail,
       'HIGH' AS priority, 'PRODUCT' AS related_type, id AS related_id
FROM {stock_view} WHERE current_stock <= minimum_stock_alert_quantity
UNION ALL
SELECT 'FOLLOW_UP', 'Follow-up due:', customer_name || ' / ' || business_name || ' / ' || strftime(follow_up_date, '%b %-d'),
       'MEDIUM', 'CUSTOMER', id
FROM customers WHERE follow_up_date IS NOT NULL AND follow_up_date BETWEEN {d} AND {d} + INTERVAL 7 DAY
UNION ALL
SELECT 'CUSTOMER_QUERY', 'Open query: ' || q.subject, c.customer_name || ' / ' || LEFT(q.message, 100),
       q.priority, 'QUERY', q.id
FROM queries q JOIN customers c ON c.id = q.customer_id WHERE q.status <> 'RESOLVED'"""


_KEY_SQL = "sha256(type || '|' || related_type || '|' || related_id)"
_PREV_STOCK = f"""SELECT p.*, COALESCE(s.current_stock, 0) AS current_stock FROM products p LEFT JOIN
  (SELECT product_id, CAST(SUM(CASE WHEN movement_type = 'IN' THEN quantity_changed ELSE -quantity_changed END)
          AS BIGINT) AS current_stock FROM movements WHERE created_at < {_ts(PREV_UNTIL)} GROUP BY product_id) s
  ON s.product_id = p.id"""
_STORED = f"""SELECT {_KEY_SQL} AS id, type, title, detail, priority, related_type, related_id,
       {_ts(PREV_AT)} AS created_at FROM live_prev"""
_MERGED = f"""SELECT COALESCE(s.id, sha256(l.type || '|' || l.related_type || '|' || l.related_id)) AS id,
       l.type, l.title, l.detail, l.priority, l.related_type, l.related_id,
       COALESCE(s.created_at, {_ts(NOW)}) AS created_at
FROM live l LEFT JOIN stored s ON s.type = l.type AND s.related_type = l.related_type AND s.related_id = l.related_id"""
_READS = f"""SELECT id AS notification_id, CAST({READER} AS BIGINT) AS user_id, {_ts(PREV_UNTIL)} AS read_at
FROM stored WHERE related_id % 3 = 0"""
_SURVIVING = "SELECT * FROM reads WHERE notification_id IN (SELECT id FROM merged)"

_BASE = ("customers", "queries", "products_stock", "movements", "products")
_EXTRA = [("live", _live_sql("products_stock", AS_OF)), ("prev_stock", _PREV_STOCK),
          ("live_prev", _live_sql("prev_stock", PREV)), ("stored", _STORED), ("merged", _MERGED),
          ("reads", _READS), ("surviving", _SURVIVING)]


def _sql(body: str) -> str:
    return with_views(body, *_BASE, extra=_EXTRA)


class _State:
    """The fixture's alert state, built from the given tables.

    The stored and the reconciled snapshots are tables in production; here
    they are checkpointed once when first needed (into the cluster's
    checkpoint folder), so plans that use them in several branches do not
    re-derive them from the ledger in each branch.
    """

    def __init__(self, spark, d):
        fx = Fixture(spark, d)
        self.fx = fx
        products = fx.products()
        both = inv.stock_levels_at(fx.movements(), {"now": None, "prev": PREV_UNTIL})   # one ledger pass
        self.products_now = inv.products_with_stock(
            products, both.select("product_id", F.col("now").alias("current_stock")))
        self.products_prev = inv.products_with_stock(
            products, both.select("product_id", F.col("prev").alias("current_stock")))
        self.customers, self.queries = fx.customers(), fx.queries()
        self.live = al.alerts_live(self.products_now, self.customers, self.queries, AS_OF)

    @cached_property
    def stored(self):
        prev = al.alerts_live(self.products_prev, self.customers, self.queries, PREV)
        return written(al.as_snapshot(prev, PREV_AT), "alerts-stored")

    @cached_property
    def reads(self):
        return self.stored.where(F.col("related_id") % 3 == 0).select(
            F.col("id").alias("notification_id"), F.lit(READER).cast("bigint").alias("user_id"),
            wall_time(PREV_UNTIL).alias("read_at"))

    @cached_property
    def merged(self):
        return written(al.alerts_merge(self.stored, self.live, NOW), "alerts-merged")

    @cached_property
    def reads_after(self):
        return al.surviving_reads(self.reads, self.merged)


@register("alerts_low_stock", with_views(
    "SELECT * FROM live WHERE type = 'LOW_STOCK'", "customers", "queries", "products_stock",
    extra=[("live", _live_sql("products_stock", AS_OF))]))
def q_low(spark, d):
    fx = Fixture(spark, d)
    return al.alerts_low_stock(inv.products_with_stock(fx.products(), inv.stock_levels(fx.movements())))


@register("alerts_follow_up", with_views(
    "SELECT * FROM live WHERE type = 'FOLLOW_UP'", "customers", "queries", "products_stock",
    extra=[("live", _live_sql("products_stock", AS_OF))]))
def q_follow(spark, d):
    return al.alerts_follow_up(Fixture(spark, d).customers(), AS_OF)


@register("alerts_open_query", with_views(
    "SELECT * FROM live WHERE type = 'CUSTOMER_QUERY'", "customers", "queries", "products_stock",
    extra=[("live", _live_sql("products_stock", AS_OF))]))
def q_open(spark, d):
    fx = Fixture(spark, d)
    return al.alerts_open_query(fx.queries(), fx.customers())


@register("alerts_live", with_views("SELECT * FROM live", "customers", "queries", "products_stock",
                                    extra=[("live", _live_sql("products_stock", AS_OF))]))
def q_live(spark, d):
    return _State(spark, d).live


ORACLE_MERGED = _sql("SELECT * FROM merged")


@register("alerts_merge", ORACLE_MERGED)
def q_merge(spark, d):
    return _State(spark, d).merged


@register("stale_alerts", _sql("""
SELECT s.* FROM stored s WHERE NOT EXISTS (
  SELECT 1 FROM live l WHERE l.type = s.type AND l.related_type = s.related_type AND l.related_id = s.related_id)"""))
def q_stale(spark, d):
    st = _State(spark, d)
    return al.stale_alerts(st.stored, st.live)


@register("inbox", _sql(f"""
SELECT m.id, m.type, lower(regexp_replace(m.type, '_', ' ')) AS type_label, m.title, m.detail, m.priority,
       r.read_at, m.created_at
FROM merged m LEFT JOIN (SELECT * FROM surviving WHERE user_id = {READER}) r ON r.notification_id = m.id
ORDER BY (r.read_at IS NULL) DESC, m.created_at DESC, m.id ASC LIMIT 30"""))
def q_inbox(spark, d):
    st = _State(spark, d)
    return al.inbox(st.merged, st.reads_after, READER, 30)


@register("unread_count", _sql(f"""
SELECT COUNT(*) AS unread_count FROM merged
WHERE id NOT IN (SELECT notification_id FROM surviving WHERE user_id = {READER})"""))
def q_unread(spark, d):
    st = _State(spark, d)
    return al.unread_count(st.merged, st.reads_after, READER)


@register("mark_all_read", _sql(f"""
SELECT notification_id, user_id, read_at FROM surviving
UNION ALL
SELECT id, CAST({READER} AS BIGINT), {_ts(NOW)} FROM merged
WHERE id NOT IN (SELECT notification_id FROM surviving WHERE user_id = {READER})"""))
def q_mark_all(spark, d):
    st = _State(spark, d)
    return al.mark_read(st.merged, st.reads_after, READER, NOW)


# V8 and V9 of the notification tables. Every seventh stored alert is there twice; the
# reads that are checked are those before stale alerts' reads are taken out, and every
# ninety-seventh is by a user nobody knows.
_NOBODY = 1_000_000_000


@register("dq_unique_notifications", _sql("""
SELECT 'notifications' AS table_name, type || '|' || related_type || '|' || CAST(related_id AS VARCHAR) AS key_value, COUNT(*) AS occurrences
FROM (SELECT * FROM stored UNION ALL SELECT * FROM stored WHERE related_id % 7 = 0)
GROUP BY type, related_type, related_id HAVING COUNT(*) > 1"""))
def q_unique_notifications(spark, d):
    stored = _State(spark, d).stored
    twice = stored.unionByName(stored.where(F.col("related_id") % 7 == 0))
    return dq.dq_unique([("notifications", twice, al.KEY)])


@register("dq_orphans_reads", with_views(f"""
SELECT 'notification_reads' AS table_name, 'notification_id' AS column_name, r.notification_id AS missing_id, COUNT(*) AS rows
FROM reads r WHERE NOT EXISTS (SELECT 1 FROM merged m WHERE m.id = r.notification_id) GROUP BY r.notification_id
UNION ALL
SELECT 'notification_reads', 'user_id', CAST({_NOBODY} AS VARCHAR), n FROM (
  SELECT COUNT(*) AS n FROM reads r JOIN stored s ON s.id = r.notification_id WHERE s.related_id % 97 = 0) WHERE n > 0""",
                                         *_BASE, "users", extra=_EXTRA))
def q_orphans_reads(spark, d):
    st = _State(spark, d)
    marked = st.reads.join(st.stored.select(F.col("id").alias("notification_id"), "related_id"), "notification_id")
    reads = marked.withColumn("user_id", F.when(F.col("related_id") % 97 == 0, F.lit(_NOBODY)).otherwise(F.col("user_id")))
    return dq.dq_orphans([("notification_reads", "notification_id", reads, st.merged),
                          ("notification_reads", "user_id", reads, st.fx.users())], "string")
