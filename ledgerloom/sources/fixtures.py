"""Domain views over the given test tables (the mapping of FIXTURES.md §2).

Each method returns a DataFrame with the domain schema of ``schemas.py``;
the SQL oracle in ``plans/oracle.py`` uses the same expressions. Counts that
appear in the mapping (``% suppliers``) are scalar subqueries, so no value
travels through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.config import AS_OF, OPENING_STOCK_REASON
from ledgerloom.sources.tables import load, load_stream

OPENING_AT = "1995-01-01 00:00:00"


def _case(value: Column, mapping: list[tuple[object, str]], default=None) -> Column:
    out = None
    for key, label in mapping:
        out = (F.when(value == key, F.lit(label)) if out is None
               else out.when(value == key, F.lit(label)))
    return out.otherwise(F.lit(default))


class Fixture:
    """Lazily built domain tables for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, streams: set[str] | None = None,
                 max_files_per_trigger: int | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.streams = set(streams or ())
        self.max_files = max_files_per_trigger

    def table(self, name: str) -> DataFrame:
        """A given table; names listed in ``streams`` are read as file streams."""
        if name in self.streams:
            return load_stream(self.spark, self.sf_dir, name, self.max_files)
        return load(self.spark, self.sf_dir, name)

    # -- counts used by the mapping, as scalar subqueries --------------------
    def _count(self, name: str) -> Column:
        return self.table(name).select(F.count(F.lit(1))).scalar()

    @property
    def n_suppliers(self) -> Column:
        return self._count("supplier")

    @property
    def n_customers(self) -> Column:
        return self._count("customer")

    @property
    def n_parts(self) -> Column:
        return self._count("part")

    # -- people ---------------------------------------------------------------
    def users(self) -> DataFrame:
        s = self.table("supplier")
        return s.select(
            F.col("s_suppkey").alias("id"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("user"), F.col("s_suppkey").cast("string"), F.lit("@example.test")).alias("email"),
            _case(F.col("s_suppkey") % 4, [(0, "ADMIN"), (1, "SALES"), (2, "WAREHOUSE"), (3, "ACCOUNTS")]).alias("role"),
        )

    def customers(self, with_address: bool = False) -> DataFrame:
        c = self.table("customer")
        key = F.col("c_custkey")
        cols = [
            key.alias("id"),
            F.col("c_name").alias("customer_name"),
            F.concat(F.col("c_name"), F.lit(" "), F.col("c_mktsegment")).alias("business_name"),
            F.concat(F.lit("+91"), F.lpad(key.cast("string"), 10, "0")).alias("mobile"),
            F.lit(None).cast("string").alias("email"),
            F.lit(None).cast("string").alias("gst_number"),
            F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "WHOLESALE")
             .when(F.col("c_mktsegment") == "HOUSEHOLD", "RETAIL")
             .otherwise("DISTRIBUTOR").alias("customer_type"),
            F.when(F.col("c_acctbal") < 0, "INACTIVE").when(F.col("c_acctbal") < 1000, "LEAD")
             .otherwise("ACTIVE").alias("status"),
            F.when(key % 7 == 0, F.lit(None).cast("date"))
             .otherwise(F.date_add(F.lit(AS_OF), (key % 30 - 10).cast("int"))).alias("follow_up_date"),
        ]
        if not with_address:
            return c.select(*cols)
        # nation has 25 rows at every scale: a bounded lookup.
        nation = self.table("nation").select("n_nationkey", "n_name")
        return (c.join(F.broadcast(nation), c.c_nationkey == nation.n_nationkey, "left")
                 .select(*cols, F.col("n_name").alias("address")))

    # -- catalogue and ledger -------------------------------------------------
    def products(self) -> DataFrame:
        p = self.table("part")
        return p.select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("product_name"),
            F.concat(F.lit("SKU-"), F.col("p_partkey").cast("string")).alias("sku"),
            F.col("p_type").alias("category"),
            F.col("p_retailprice").cast("decimal(12,2)").alias("unit_price"),
            (F.col("p_size") * 10).alias("minimum_stock_alert_quantity"),
            F.col("p_brand").alias("warehouse_location"),
        )

    def movements(self, opening: bool = True, ids: bool = False) -> DataFrame:
        """Append-only ledger: one opening IN of 400 per part plus one row per
        line; with ``ids`` each row carries its ledger id."""
        li = self.table("lineitem")
        # the given lines have no key of their own; the whole row is one at every scale
        line_id = F.concat_ws("-", F.lit("line"), *(F.col(c).cast("string") for c in li.columns)).alias("id")
        lines = li.select(
            *[line_id] * ids,
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").cast("int").alias("quantity_changed"),
            F.when(F.col("l_returnflag") == "N", "OUT").otherwise("IN").alias("movement_type"),
            F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit(" line "),
                     F.col("l_linenumber").cast("string")).alias("reason"),
            F.when(F.col("l_returnflag") == "N", "CHALLAN").otherwise("MANUAL_ADJUSTMENT").alias("reference_type"),
            F.col("l_orderkey").alias("reference_id"),
            F.col("l_suppkey").alias("created_by"),
            F.col("l_shipdate").alias("created_at"),
        )
        if not opening:
            return lines
        op = self.table("part").select(
            *[F.concat_ws("-", F.lit("opening"), "p_partkey").alias("id")] * ids,
            F.col("p_partkey").alias("product_id"),
            F.lit(400).alias("quantity_changed"),
            F.lit("IN").alias("movement_type"),
            F.lit(OPENING_STOCK_REASON).alias("reason"),
            F.lit("OPENING_STOCK").alias("reference_type"),
            F.lit(None).cast("bigint").alias("reference_id"),
            F.lit(0).cast("bigint").alias("created_by"),
            F.lit(OPENING_AT).cast("timestamp_ntz").alias("created_at"),
        )
        return op.unionByName(lines)

    # -- sales documents --------------------------------------------------------
    def challans(self) -> DataFrame:
        o = self.table("orders")
        st = F.col("o_orderstatus")
        return o.select(
            F.col("o_orderkey").alias("id"),
            F.format_string("CH-%d-%05d", F.year("o_orderdate"), F.col("o_orderkey")).alias("challan_number"),
            F.col("o_custkey").alias("customer_id"),
            (F.col("o_orderkey") % self.n_suppliers).alias("created_by"),
            _case(st, [("F", "CONFIRMED"), ("O", "DRAFT"), ("P", "CANCELLED")]).alias("status"),
            F.col("o_orderdate").alias("created_at"),
            F.when(st == "F", F.col("o_orderdate")).alias("confirmed_at"),
            F.when(st == "P", F.col("o_orderdate")).alias("cancelled_at"),
        )

    def items(self) -> DataFrame:
        """Challan lines with the product snapshot (name, sku, price) copied on."""
        li = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
        p = self.table("part").select("p_partkey", "p_name", "p_retailprice")
        return li.join(p, li.l_partkey == p.p_partkey, "inner").select(
            F.col("l_orderkey").alias("challan_id"),
            F.col("l_linenumber").alias("line_no"),
            F.col("l_partkey").alias("product_id"),
            F.col("p_name").alias("product_name_snapshot"),
            F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string")).alias("sku_snapshot"),
            F.col("p_retailprice").cast("decimal(12,2)").alias("unit_price_snapshot"),
            F.col("l_quantity").cast("int").alias("quantity"),
        )

    def raw_lines(self) -> DataFrame:
        """Challan lines without the product snapshot (ids and quantities only)."""
        li = self.table("lineitem")
        return li.select(F.col("l_orderkey").alias("challan_id"), F.col("l_linenumber").alias("line_no"),
                         F.col("l_partkey").alias("product_id"), F.col("l_quantity").cast("int").alias("quantity"))

    # -- CRM ------------------------------------------------------------------------
    def queries(self) -> DataFrame:
        cv = self.table("conversations")
        user_turn = F.when(F.col("role") == "user", F.col("turn"))
        g = cv.groupBy("conv_id").agg(
            F.min_by(F.col("text"), user_turn).alias("message"),
            F.max_by(F.col("role"), F.col("turn")).alias("last_role"),
        )
        k = F.col("conv_id")
        return g.select(
            k.alias("id"),
            k.alias("customer_id"),
            F.split("message", "\n")[0].alias("subject"),  # the whole first line
            F.col("message"),
            F.when(k % 5 == 0, "RESOLVED").when(F.col("last_role") == "user", "OPEN")
             .otherwise("IN_PROGRESS").alias("status"),
            _case(k % 3, [(0, "LOW"), (1, "MEDIUM"), (2, "HIGH")]).alias("priority"),
            (k % self.n_suppliers).alias("created_by"),
        )

    def replies(self) -> DataFrame:
        cv = self.table("conversations").where(F.col("role") == "assistant")
        return cv.select(
            F.col("conv_id").alias("query_id"),
            F.col("turn"),
            F.col("text").alias("message"),
            ((F.col("conv_id") + F.col("turn")) % self.n_suppliers).alias("created_by"),
        )

    def reviews(self) -> DataFrame:
        d = self.table("documents").select("doc_id", "text")
        k = F.col("doc_id")
        return d.select(
            k.alias("id"),
            (k % self.n_customers).alias("customer_id"),
            (1 + k % 5).cast("int").alias("rating"),
            F.col("text").alias("review"),
            (k % self.n_suppliers).alias("created_by"),
        )

    def follow_ups(self) -> DataFrame:
        ev = self.table("events").where(F.col("event_type").isin("view", "click"))
        return ev.select(
            F.col("event_id").alias("id"),
            (F.col("user_id") % self.n_customers).alias("customer_id"),
            F.col("event_type").alias("note"),
            F.lit(None).cast("date").alias("follow_up_date"),
            (F.col("user_id") % self.n_suppliers).alias("created_by"),
            F.col("ts").alias("created_at"),
        )

    def stock_requests(self) -> DataFrame:
        ev = self.table("events").where(F.col("event_type").isin("error", "signup"))
        status = _case(F.col("event_id") % 3, [(0, "PENDING"), (1, "APPROVED"), (2, "REJECTED")])
        return ev.select(
            F.col("event_id").alias("id"),
            (F.col("event_id") % self.n_parts).alias("product_id"),
            (F.col("user_id") % self.n_suppliers).alias("requested_by"),
            (1 + F.col("event_id") % 50).cast("int").alias("quantity"),
            _case(F.col("user_id") % 3, [(0, "LOW"), (1, "MEDIUM"), (2, "HIGH")]).alias("urgency"),
            F.col("props").alias("message"),
            status.alias("status"),
            F.when(F.col("event_id") % 3 == 0, F.lit(None).cast("bigint"))
             .otherwise((F.col("user_id") + 1) % self.n_suppliers).alias("reviewed_by"),
            F.col("ts").alias("created_at"),
        )

    def request_log(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("client_id"), F.col("ts"))
