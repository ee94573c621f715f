"""Stream = batch: sources landing in several files (micro-batches), with replays."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import inventory as inv
from ledgerloom.sources.fixtures import Fixture
from ledgerloom.sources.tables import load
from ledgerloom.streaming import jobs

from .conftest import SF_SMALL


def _land(spark, scratch, name, order_col, parts, extra=None, reverse=False):
    """Land a table as ``parts`` files, appended one after another in ``order_col`` order."""
    df = load(spark, SF_SMALL, name)
    if extra is not None:
        df = df.unionByName(extra)
    ranked = df.withColumn("_part", F.ntile(parts).over(Window.orderBy(order_col)))   # test data only
    for k in (range(parts, 0, -1) if reverse else range(1, parts + 1)):
        ranked.where(F.col("_part") == k).drop("_part").coalesce(1).write.mode("append").parquet(f"{scratch}/{name}")


def _feed(spark, scratch, batches, schema):
    """A stream over one file per batch, in that order."""
    path = f"{scratch}/feed"
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


LEDGER = "id string, product_id bigint, quantity_changed int, movement_type string, created_at timestamp_ntz"


def _ledger_rows(seed=3, n=240):
    """Shuffled arrival, equal rows with different ids, replayed rows."""
    rng = random.Random(seed)
    day = dt.datetime(2001, 1, 1)
    rows = [(str(i), rng.randrange(6), rng.randint(1, 9), rng.choice(["IN", "OUT"]), day + dt.timedelta(hours=rng.randrange(60)))
            for i in range(n)]
    rows += [("equal-1", 1, 5, "IN", day), ("equal-2", 1, 5, "IN", day)]
    arrivals = rows + rng.sample(rows, 40)
    rng.shuffle(arrivals)
    return rows, [arrivals[i::5] for i in range(5)]


def _products(spark):
    return spark.createDataFrame([(p, "p", "s", 4 * p) for p in range(6)],
                                 "id bigint, product_name string, sku string, minimum_stock_alert_quantity int")


def test_stock_levels_with_late_equal_and_replayed_rows(spark, scratch):
    rows, batches = _ledger_rows()
    got = jobs.stream_stock_levels(spark, _feed(spark, scratch, batches, LEDGER), out=f"{scratch}/out")
    want = inv.stock_levels(spark.createDataFrame(rows, LEDGER))
    assert sorted(got.collect()) == sorted(want.collect())


def test_stock_levels_continue_after_a_restart(spark, scratch):
    rows, batches = _ledger_rows(seed=4)
    feed = _feed(spark, scratch, batches[:2], LEDGER)
    jobs.stream_stock_levels(spark, feed, out=f"{scratch}/out")
    for later in (batches[2:], batches[:1]):  # new rows, then a source that delivers old ones again
        for part in later:
            spark.createDataFrame(part, LEDGER).coalesce(1).write.mode("append").parquet(f"{scratch}/feed")
        got = jobs.stream_stock_levels(spark, feed, out=f"{scratch}/out")
    assert sorted(got.collect()) == sorted(inv.stock_levels(spark.createDataFrame(rows, LEDGER)).collect())


def test_a_storage_error_is_not_an_empty_table(spark, scratch):
    import pytest
    with pytest.raises(Exception):
        jobs.stock_levels(spark, f"{scratch}/nowhere").collect()


def test_low_stock_changes_with_late_and_replayed_rows(spark, scratch):
    rows, batches = _ledger_rows(seed=5)
    products = _products(spark)
    got = jobs.stream_low_stock_changes(spark, _feed(spark, scratch, batches, LEDGER), products, out=f"{scratch}/out")
    want = jobs.low_stock_transitions(jobs.ledger_steps(spark.createDataFrame(rows, LEDGER)), products)
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() > 10
    # one at a time
    level, low, events = {}, {}, []
    steps = {}
    for _, p, q, kind, at in rows:
        steps[p, at] = steps.get((p, at), 0) + (q if kind == "IN" else -q)
    for (p, at), delta in sorted(steps.items(), key=lambda s: (s[0][0], s[0][1])):
        level[p] = level.get(p, 0) + delta
        now = level[p] <= 4 * p
        if now != low.get(p, False) or (p not in low and now):
            events.append((p, at, "entered_low" if now else "left_low", level[p]))
        low[p] = now
    assert sorted(map(tuple, got.collect())) == sorted(events)


def test_late_requests_count(spark, scratch):
    day = dt.datetime(2001, 1, 1)
    late = [(1, day), (1, day), (1, day)]
    batches = [[(2, day + dt.timedelta(days=9))], late[:2], [(2, day + dt.timedelta(days=12))], late[2:]]
    got = jobs.rate_violations(spark, _feed(spark, scratch, batches, "client_id bigint, ts timestamp_ntz"), 1, out=f"{scratch}/out")
    assert [(r.client_id, r.requests) for r in got.collect()] == [(1, 3)]


def test_daily_sales_with_late_and_replayed_challans(spark, scratch):
    from ledgerloom.operators import sales
    schema = "id bigint, status string, confirmed_at timestamp_ntz, challan_number string, customer_id bigint, created_by bigint"
    as_of = dt.date(2001, 2, 1)
    at = lambda d: dt.datetime(2001, 1, d, 10)
    row = lambda i, d: (i, "CONFIRMED" if d else "DRAFT", at(d) if d else None, f"CH-{i}", 1, 1)
    batches = [[row(1, 30)], [row(2, 31), row(1, 30)], [row(3, 24)], [row(4, 20), row(5, None)]]
    items = spark.createDataFrame([(i, i, 2, Decimal("1.50")) for i in range(1, 6)] + [(3, 9, 1, Decimal("2.00"))],
                                  "challan_id bigint, product_id bigint, quantity int, unit_price_snapshot decimal(12,2)")
    got = jobs.stream_sales_daily(spark, _feed(spark, scratch, batches, schema), items, as_of, 30, out=f"{scratch}/out")
    every = spark.createDataFrame([r for b in batches for r in b], schema).distinct()
    want = sales.sales_daily(every, items, as_of, 30)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 4


def test_stock_levels_stream_equals_batch_with_replays(spark, scratch):
    li = load(spark, SF_SMALL, "lineitem")
    replays = li.where(F.col("l_linenumber") == 1)         # delivered twice
    _land(spark, scratch, "lineitem", "l_shipdate", 4, extra=replays)
    _land(spark, scratch, "part", "p_partkey", 1)
    fs = Fixture(spark, scratch, streams={"lineitem", "part"}, max_files_per_trigger=1)
    got = jobs.stream_stock_levels(spark, fs.movements(ids=True))
    want = inv.stock_levels(Fixture(spark, SF_SMALL).movements())
    assert sorted(got.collect()) == sorted(want.collect())


def test_stock_levels_stream_late_arrivals_are_kept(spark, scratch):
    _land(spark, scratch, "lineitem", "l_shipdate", 4, reverse=True)    # newest movements land first
    _land(spark, scratch, "part", "p_partkey", 1)
    fs = Fixture(spark, scratch, streams={"lineitem", "part"}, max_files_per_trigger=1)
    got = jobs.stream_stock_levels(spark, fs.movements(ids=True))
    want = inv.stock_levels(Fixture(spark, SF_SMALL).movements())
    assert sorted(got.collect()) == sorted(want.collect())


def test_rate_violations_stream_equals_batch(spark, scratch):
    _land(spark, scratch, "events", "ts", 3)
    fs = Fixture(spark, scratch, streams={"events"}, max_files_per_trigger=1)
    got = jobs.rate_violations(spark, fs.request_log(), 1)
    ev = load(spark, SF_SMALL, "events")
    want = (ev.groupBy(F.col("user_id").alias("client_id"), F.window(F.col("ts").cast("timestamp"), "15 minutes"))
              .count().where("count > 1")
              .select("client_id", F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                      F.col("window.end").cast("timestamp_ntz").alias("window_end"),
                      F.col("count").alias("requests")))
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.count() == 13


def test_low_stock_changes_across_batches(spark, scratch):
    _land(spark, scratch, "lineitem", "l_shipdate", 3)
    _land(spark, scratch, "part", "p_partkey", 1)
    fs = Fixture(spark, scratch, streams={"lineitem", "part"}, max_files_per_trigger=1)
    products = Fixture(spark, SF_SMALL).products()
    got = jobs.stream_low_stock_changes(spark, fs.movements(ids=True), products)
    one = jobs.stream_low_stock_changes(spark, Fixture(spark, SF_SMALL, streams={"lineitem", "part"}).movements(ids=True),
                                        products)
    assert sorted(got.collect()) == sorted(one.collect())


def test_daily_sales_stream_equals_batch(spark, scratch):
    from ledgerloom.config import AS_OF
    from ledgerloom.operators import sales
    _land(spark, scratch, "orders", "o_orderdate", 3)
    load(spark, SF_SMALL, "supplier").write.parquet(f"{scratch}/supplier.parquet")   # used by the challan view
    fs, fx = Fixture(spark, scratch, streams={"orders"}, max_files_per_trigger=1), Fixture(spark, SF_SMALL)
    got = jobs.stream_sales_daily(spark, fs.challans(), fx.items(), AS_OF, 30)
    want = sales.sales_daily(fx.challans(), fx.items(), AS_OF, 30)
    assert sorted(got.collect()) == sorted(want.collect())


def test_alert_stream_equals_batch_merge(spark, scratch):
    from ledgerloom.plans import keys_alerts
    from ledgerloom.config import AS_OF
    _land(spark, scratch, "lineitem", "l_shipdate", 3)
    _land(spark, scratch, "part", "p_partkey", 1)
    fs, fx = Fixture(spark, scratch, streams={"lineitem", "part"}, max_files_per_trigger=1), Fixture(spark, SF_SMALL)
    state = keys_alerts._State(spark, SF_SMALL)
    got = jobs.stream_alerts(spark, fs.movements(ids=True), fx.products(), fx.customers(), fx.queries(), state.stored,
                             AS_OF, keys_alerts.NOW)
    # Reconciling after every micro-batch sees intermediate ledgers: an alert that
    # cleared and came back is a new alert (new creation time), as in the application.
    # The live set, ids and texts equal the one-shot merge; creation times are the
    # stored one or the run time.
    def body(df):
        return sorted(df.drop("created_at").collect())
    assert body(got) == body(state.merged)
    times = {r.created_at for r in got.select("created_at").distinct().collect()}
    assert times <= {keys_alerts.PREV_AT, keys_alerts.NOW}
