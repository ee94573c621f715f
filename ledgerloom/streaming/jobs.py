"""Structured Streaming versions of the live figures: ST1-ST5.

Each figure is a streaming query over the append-only sources (ledger, orders,
request log); ``trigger`` defaults to ``availableNow`` (process what has landed,
then stop); production runs use ``processing_time="30 seconds"``. Results and
query checkpoints lie below ``out``, a path that the caller names.

No figure has a watermark, so no row is ever too late. ST1 and ST3 keep their
figures in Spark's state store (RocksDB): the ids seen and the sum per product, so a
micro-batch reads its own rows only, and only products that changed go on. ST2, ST4
and ST5 land what a micro-batch adds under its batch id and are summed or derived on
read. Replays are known by id: a ledger row counts once however often it is
delivered, and two equal rows with different ids count twice.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import RATE_WINDOW
from ledgerloom.functions.ordered import running_sum
from ledgerloom.operators import alerts as al
from ledgerloom.operators import inventory as inv
from ledgerloom.operators import sales
from ledgerloom.sources.fixtures import Fixture
from ledgerloom.streaming.sinks import land, landed, prepare, stream_root

LEDGER_SCHEMA = "id string, product_id bigint, created_at timestamp_ntz, delta bigint"


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass",
               "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _run(df: DataFrame, handler, out: str, processing_time: str | None, mode: str = "append"):
    w = df.writeStream.outputMode(mode).foreachBatch(handler).option("checkpointLocation", f"{out}/_checkpoint")
    w = w.trigger(processingTime=processing_time) if processing_time else w.trigger(availableNow=True)
    conf, (key, provider) = df.sparkSession.conf, STATE_STORE
    before = conf.get(key)
    conf.set(key, provider)  # a query keeps the settings that it starts with
    try:
        q = w.start()
    finally:
        conf.set(key, before)
    if processing_time is None:
        q.awaitTermination()
        if q.exception() is not None:
            raise q.exception()
    return q


def ledger_steps(movements: DataFrame) -> DataFrame:
    """What the figures need of a ledger row; ``movements`` carries the ledger ``id``."""
    return movements.select(F.col("id").cast("string").alias("id"), "product_id", "created_at",
                            inv.signed_quantity().cast("bigint").alias("delta"))


# -- ST1 -------------------------------------------------------------------------------
LEVEL_SCHEMA = "product_id bigint, current_stock bigint"


def live_levels(movements: DataFrame) -> DataFrame:
    """Stock per product as streaming state: each ledger id counts once. In update mode
    a micro-batch gives the products that it changed, with their new stock."""
    once = ledger_steps(movements).dropDuplicates(["id"])
    return once.groupBy("product_id").agg(F.sum("delta").cast("bigint").alias("current_stock"))


def stock_levels(spark: SparkSession, out: str) -> DataFrame:
    """Of each product the stock that its latest micro-batch gave."""
    given = landed(spark, f"{out}/levels", LEVEL_SCHEMA)
    return given.groupBy("product_id").agg(F.max_by("current_stock", "batch").alias("current_stock"))


def stream_stock_levels(spark: SparkSession, movements: DataFrame, processing_time: str | None = None,
                        out: str | None = None) -> DataFrame:
    """ST1: stock per product from the movement stream, late and repeated rows included once."""
    out = out or stream_root(spark, "stock_levels")
    prepare(spark, f"{out}/levels", LEVEL_SCHEMA)
    _run(live_levels(movements), lambda batch, i: land(batch, f"{out}/levels", i), out, processing_time, "update")
    return stock_levels(spark, out)


# -- ST2 -------------------------------------------------------------------------------
SALE_SCHEMA = "challan_id bigint, sale_date date, revenue decimal(18,2), units bigint"


def daily_sales(spark: SparkSession, out: str) -> DataFrame:
    """Per day: confirmed challans (each once), revenue and units."""
    once = landed(spark, f"{out}/sales", SALE_SCHEMA).drop("batch").dropDuplicates(["challan_id"])
    return once.groupBy("sale_date").agg(
        F.count(F.lit(1)).alias("challans"), F.sum("revenue").cast(sales.MONEY).alias("revenue"),
        F.sum("units").cast("bigint").alias("units"))


def stream_sales_daily(spark: SparkSession, challans: DataFrame, items: DataFrame, as_of: dt.date, days: int = 30,
                       processing_time: str | None = None, out: str | None = None) -> DataFrame:
    """ST2: daily sales of the window from the challan stream. ``items`` is
    static; a micro-batch reads only the lines of its own challans."""
    out = out or stream_root(spark, "sales_daily")
    prepare(spark, f"{out}/sales", SALE_SCHEMA)

    def add(batch: DataFrame, batch_id: int) -> None:
        sold = batch.select(F.col("id").alias("challan_id"), F.to_date("confirmed_at").alias("sale_date"))
        lines = items.join(sold.select("challan_id").distinct(), "challan_id", "left_semi")
        totals = sales.per_challan(lines.withColumn("revenue", F.col("quantity") * F.col("unit_price_snapshot")))
        rows = sold.join(totals, "challan_id").select(
            "challan_id", "sale_date", F.col("revenue").cast(sales.MONEY).alias("revenue"), F.col("units").cast("bigint").alias("units"))
        land(rows, f"{out}/sales", batch_id)

    _run(sales.confirmed_in_window(challans, as_of, days), add, out, processing_time)
    return daily_sales(spark, out)


# -- ST3 -------------------------------------------------------------------------------
def current_alerts(spark: SparkSession, out: str) -> DataFrame:
    return al.alert_table(f"{out}/alerts").read(spark)


def stream_alerts(spark: SparkSession, movements: DataFrame, products: DataFrame, customers: DataFrame,
                  queries: DataFrame, stored: DataFrame, as_of: dt.date, now: dt.datetime,
                  processing_time: str | None = None, out: str | None = None) -> DataFrame:
    """ST3: reconcile alerts once per micro-batch of ledger activity.

    The first micro-batch merges all sources into ``stored``. Every later one gets
    the products whose stock changed from the state, and changes their alerts in
    the stored table; a replayed micro-batch makes the same changes again."""
    out = out or stream_root(spark, "alerts")
    table = al.alert_table(f"{out}/alerts")

    def run(changed: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            live = al.alerts_live(inv.products_with_stock(products, changed), customers, queries, as_of)
            table.create(al.alerts_merge(stored, live, now))
            return
        land(changed, f"{out}/levels", batch_id)
        levels = spark.read.schema(LEVEL_SCHEMA).parquet(f"{out}/levels/batch={batch_id}")
        known = products.join(levels.select(F.col("product_id").alias("id")), "id", "left_semi")
        live = al.alerts_low_stock(inv.products_with_stock(known, levels))
        al.reconcile_touched(table, al.low_stock_keys(levels), live, now)

    _run(live_levels(movements), run, out, processing_time, "update")
    return current_alerts(spark, out)


# -- ST4 -------------------------------------------------------------------------------
RATE_SCHEMA = "client_id bigint, window_start timestamp_ntz, window_end timestamp_ntz, requests bigint"


def rate_window_counts(requests: DataFrame, window: str = RATE_WINDOW) -> DataFrame:
    """Requests per client and aligned window of one micro-batch."""
    at = F.window(F.col("ts").cast("timestamp"), window)  # the session zone is UTC, as the sources'
    g = requests.groupBy("client_id", at).agg(F.count(F.lit(1)).alias("requests"))
    return g.select("client_id", F.col("window.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("window.end").cast("timestamp_ntz").alias("window_end"), "requests")


def violations(spark: SparkSession, out: str, limit: int) -> DataFrame:
    total = landed(spark, f"{out}/counts", RATE_SCHEMA).groupBy("client_id", "window_start", "window_end").agg(F.sum("requests").alias("requests"))
    return total.where(F.col("requests") > limit)


def rate_violations(spark: SparkSession, requests: DataFrame, limit: int, processing_time: str | None = None,
                    out: str | None = None) -> DataFrame:
    """ST4: client windows with more than ``limit`` requests. Every request of
    the log counts, however late; batches land partial counts."""
    out = out or stream_root(spark, "rate")
    prepare(spark, f"{out}/counts", RATE_SCHEMA)
    _run(requests, lambda batch, i: land(rate_window_counts(batch), f"{out}/counts", i), out, processing_time)
    return violations(spark, out, limit)


# -- ST5 -------------------------------------------------------------------------------
EVENT_SCHEMA = "product_id bigint, changed_at timestamp_ntz, event string, current_stock bigint"


def low_stock_transitions(ledger: DataFrame, products: DataFrame) -> DataFrame:
    """Every moment at which a product enters or leaves low stock.

    Movements at one instant are one step. The balance is a running sum of the
    steps (cut into ranges, so a hot product is spread over tasks); a step flips
    the flag when ``balance - delta`` and ``balance`` fall on different sides
    of the minimum, so no ordered ``lag`` is needed. The first step of a
    product is ``entered_low`` when it starts low.
    """
    steps = ledger.groupBy("product_id", "created_at").agg(F.sum("delta").cast("bigint").alias("delta"))
    mins = products.select(F.col("id").alias("product_id"), "minimum_stock_alert_quantity")
    first = steps.groupBy("product_id").agg(F.min("created_at").alias("_first_at"))
    s = steps.join(mins, "product_id").join(first, "product_id")
    rows = running_sum(s, ["product_id"], ["created_at"], "delta", "stock")
    low_after = F.col("stock") <= F.col("minimum_stock_alert_quantity")
    low_before = (F.col("stock") - F.col("delta")) <= F.col("minimum_stock_alert_quantity")
    flip = F.when(F.col("created_at") == F.col("_first_at"), low_after).otherwise(low_after != low_before)
    return rows.where(flip).select(
        "product_id", F.col("created_at").alias("changed_at"),
        F.when(low_after, "entered_low").otherwise("left_low").alias("event"),
        F.col("stock").cast("bigint").alias("current_stock"))


def low_stock_changes(spark: SparkSession, out: str) -> DataFrame:
    """Of each product the events that its latest batch derived."""
    touched = landed(spark, f"{out}/touched", "product_id bigint").groupBy("product_id").agg(F.max("batch").alias("batch"))
    return landed(spark, f"{out}/events", EVENT_SCHEMA).join(touched, ["product_id", "batch"], "left_semi").drop("batch")


def stream_low_stock_changes(spark: SparkSession, movements: DataFrame, products: DataFrame,
                             processing_time: str | None = None, out: str | None = None) -> DataFrame:
    """ST5: when products enter or leave low stock. A micro-batch derives the
    events of the products it touches again from all their landed rows, so a
    late movement corrects the events that were given before it arrived."""
    out = out or stream_root(spark, "low_stock")
    prepare(spark, f"{out}/ledger", LEDGER_SCHEMA)
    prepare(spark, f"{out}/touched", "product_id bigint")
    prepare(spark, f"{out}/events", EVENT_SCHEMA)

    def run(batch: DataFrame, batch_id: int) -> None:
        land(batch, f"{out}/ledger", batch_id)
        land(batch.select("product_id").distinct(), f"{out}/touched", batch_id)
        touched = spark.read.parquet(f"{out}/touched/batch={batch_id}")
        ledger = landed(spark, f"{out}/ledger", LEDGER_SCHEMA).where(F.col("batch") <= batch_id).drop("batch").dropDuplicates(["id"])
        land(low_stock_transitions(ledger.join(touched, "product_id", "left_semi"), products), f"{out}/events", batch_id)

    _run(ledger_steps(movements), run, out, processing_time)
    return low_stock_changes(spark, out)


# -- fixtures ---------------------------------------------------------------------------
def fixture_streams(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> Fixture:
    return Fixture(spark, sf_dir, streams={"lineitem", "part", "orders", "events"},
                   max_files_per_trigger=max_files_per_trigger)
