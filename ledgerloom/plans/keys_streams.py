"""Registered streaming keys.

Each key runs its streaming query over the given tables read as file
streams (``availableNow``: everything that has landed, then stop) and returns
the resulting table. Stream = batch: the oracle is the batch SQL.
"""

from __future__ import annotations

from ledgerloom.config import AS_OF
from ledgerloom.plans import keys_alerts, keys_sales
from ledgerloom.plans.oracle import with_views
from ledgerloom.plans.registry import register
from ledgerloom.sources.fixtures import Fixture
from ledgerloom.streaming import jobs

RATE_LIMIT_FIXTURE = 1   # requests per client per 15 minutes (fixture: 13 / 104 / 1,111 windows)


@register("stream_stock_levels", with_views("SELECT * FROM stock", "stock"))
def q_stream_stock(spark, d):
    return jobs.stream_stock_levels(spark, jobs.fixture_streams(spark, d).movements(ids=True))


@register("stream_sales_daily", keys_sales.SQL_DAILY)
def q_stream_sales(spark, d):
    fs, fx = jobs.fixture_streams(spark, d), Fixture(spark, d)
    return jobs.stream_sales_daily(spark, fs.challans(), fx.items(), AS_OF, keys_sales.DAYS)


@register("stream_alerts", keys_alerts.ORACLE_MERGED)
def q_stream_alerts(spark, d):
    fx = Fixture(spark, d)
    state = keys_alerts._State(spark, d)
    return jobs.stream_alerts(spark, jobs.fixture_streams(spark, d).movements(ids=True), fx.products(), fx.customers(),
                              fx.queries(), state.stored, AS_OF, keys_alerts.NOW)


@register("rate_violations", f"""
SELECT user_id AS client_id, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start,
       time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE AS window_end, COUNT(*) AS requests
FROM events GROUP BY user_id, time_bucket(INTERVAL 15 MINUTE, ts) HAVING COUNT(*) > {RATE_LIMIT_FIXTURE}""")
def q_rate(spark, d):
    return jobs.rate_violations(spark, jobs.fixture_streams(spark, d).request_log(), RATE_LIMIT_FIXTURE)


@register("stream_low_stock_changes", with_views("""
SELECT product_id, created_at AS changed_at, CASE WHEN low THEN 'entered_low' ELSE 'left_low' END AS event,
       current_stock
FROM (SELECT f.*, LAG(low) OVER (PARTITION BY product_id ORDER BY created_at) AS prev_low
      FROM (SELECT b.*, b.current_stock <= p.minimum_stock_alert_quantity AS low
            FROM (SELECT product_id, created_at,
                         CAST(SUM(delta) OVER (PARTITION BY product_id ORDER BY created_at
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS current_stock
                  FROM (SELECT product_id, created_at,
                               SUM(CASE WHEN movement_type = 'IN' THEN quantity_changed ELSE -quantity_changed END)
                               AS delta FROM movements GROUP BY product_id, created_at)) b
            JOIN products p ON p.id = b.product_id) f)
WHERE (prev_low IS NULL AND low) OR (prev_low IS NOT NULL AND low <> prev_low)""", "movements", "products"))
def q_low_changes(spark, d):
    return jobs.stream_low_stock_changes(spark, jobs.fixture_streams(spark, d).movements(ids=True),
                                         Fixture(spark, d).products())
