"""Batch command jobs re-aimed from single-record writes: W1-W4, W6, W7, W9-W11, W16.

Pattern: a DataFrame of commands plus the current table snapshots in; one
``outcome`` per command (``applied``, ``not_found``, ``conflict``,
``invalid``, ``duplicate``) plus the new rows out. Without MERGE for plain
Parquet, a new snapshot is a join of commands onto the old one.

Several commands for the same record in one batch are applied in command
order. Guarded one-shot transitions (cancel, approve, reject) can only succeed
once per record, so the earliest command on a still-eligible record applies
and later ones conflict; that needs a per-record minimum (an aggregate), not
a sort of each record's commands.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.ordered import positions, running_sums
from ledgerloom.functions.text import challan_number, wall_time
from ledgerloom.operators import quality as dq
from ledgerloom.sources.scratch import written


def _ts(at: dt.datetime) -> Column:
    return wall_time(at)


def _first_command(commands: DataFrame, key: str, seq: str = "command_id") -> DataFrame:
    """The earliest command per record (an aggregate: skew-safe)."""
    return commands.groupBy(key).agg(F.min(seq).alias("_first"))


# -- W7 cancel --------------------------------------------------------------------
def challan_transitions(challans: DataFrame, commands: DataFrame, at: dt.datetime) -> DataFrame:
    """``cancel`` commands (command_id, challan_id): DRAFT -> CANCELLED only."""
    head = challans.select(F.col("id").alias("challan_id"), "status")
    first = _first_command(commands, "challan_id")
    j = commands.join(head, "challan_id", "left").join(first, "challan_id", "left")
    applied = (F.col("status") == "DRAFT") & (F.col("command_id") == F.col("_first"))
    return j.select(
        "command_id", "challan_id",
        F.when(F.col("status").isNull(), "not_found").when(applied, "applied").otherwise("conflict").alias("outcome"),
        F.when(applied, F.lit("CANCELLED")).otherwise(F.col("status")).alias("new_status"),
        F.when(applied, _ts(at)).alias("cancelled_at"))


# -- W9 / W10 approve / reject --------------------------------------------------------
def review_requests(requests: DataFrame, commands: DataFrame, reviewer, at: dt.datetime, decision: str,
                    note: str = "") -> DataFrame:
    """PENDING -> APPROVED/REJECTED, once; later commands conflict (Q5: true outcome)."""
    target = {"approve": "APPROVED", "reject": "REJECTED"}[decision]
    r = requests.select(F.col("id").alias("request_id"), "status", "product_id", "quantity")
    first = _first_command(commands, "request_id")
    j = commands.join(r, "request_id", "left").join(first, "request_id", "left")
    applied = (F.col("status") == "PENDING") & (F.col("command_id") == F.col("_first"))
    return j.select(
        "command_id", "request_id", "product_id", "quantity",
        F.when(F.col("status").isNull(), "not_found").when(applied, "applied").otherwise("conflict").alias("outcome"),
        F.when(applied, F.lit(target)).otherwise(F.col("status")).alias("new_status"),
        F.when(applied, F.lit(reviewer).cast("bigint")).alias("reviewed_by"),
        F.when(applied, _ts(at)).alias("reviewed_at"),
        F.when(applied, F.lit(note)).alias("review_note"))


def approval_movements(decisions: DataFrame, reviewer, at: dt.datetime) -> DataFrame:
    """Each applied approval adds one IN movement (and so stock)."""
    return decisions.where(F.col("outcome") == "applied").select(
        "product_id", F.col("quantity").alias("quantity_changed"), F.lit("IN").alias("movement_type"),
        F.concat(F.lit("Approved stock request "), F.col("request_id").cast("string")).alias("reason"),
        F.lit("STOCK_REQUEST").alias("reference_type"), F.col("request_id").alias("reference_id"),
        F.lit(reviewer).cast("bigint").alias("created_by"), _ts(at).alias("created_at"))


# -- W11 question replies / resolve ---------------------------------------------------
def query_transitions(queries: DataFrame, commands: DataFrame, at: dt.datetime) -> DataFrame:
    """Commands (command_id, query_id, action in reply/resolve) in command order.

    When commands carry ``customer_id``, a question of another customer is
    ``not_found`` (P15) and has no effect on the question. A question is closed
    for a command when it started RESOLVED or an earlier command that found it
    resolved it. A reply to a closed question conflicts; a resolve of a closed
    one finds no open question (``not_found``). A reply moves OPEN to
    IN_PROGRESS, where it stays for later commands. What came before is a
    running count, split by command-id blocks so one busy question is spread
    over many tasks.
    """
    q = queries.select(F.col("id").alias("query_id"), F.col("customer_id").alias("_owner"),
                       F.col("status").alias("initial"))
    j = commands.join(q, "query_id", "left")
    if "customer_id" in commands.columns:
        # The question must belong to the customer named in the command.
        j = j.withColumn("initial", F.when(F.col("_owner") == F.col("customer_id"), F.col("initial")))
    def effective(action: str) -> Column:
        return F.when(F.col("initial").isNotNull() & (F.col("action") == action), 1).otherwise(0)

    s = running_sums(j, ["query_id"], ["command_id"],
                     {"resolves_before": effective("resolve"), "replies_before": effective("reply")}, inclusive=False)
    closed = (F.col("initial") == "RESOLVED") | (F.col("resolves_before") > 0)
    outcome = (F.when(F.col("initial").isNull(), "not_found")
               .when(closed & (F.col("action") == "reply"), "conflict")
               .when(closed, "not_found")
               .when(F.col("action").isin("reply", "resolve"), "applied").otherwise("invalid"))
    status_after = (F.when(F.col("initial").isNull(), F.lit(None))
                    .when(closed | (F.col("action") == "resolve"), F.lit("RESOLVED"))
                    .when((F.col("action") == "reply") | (F.col("replies_before") > 0), F.lit("IN_PROGRESS"))
                    .otherwise(F.col("initial")))
    return s.select("command_id", "query_id", "action", outcome.alias("outcome"),
                    status_after.alias("status_after"),
                    F.when((outcome == "applied") & (F.col("action") == "resolve"), _ts(at)).alias("resolved_at"))


# -- W3 update by key ---------------------------------------------------------------------
PRODUCT_UPDATABLE = ["product_name", "sku", "category", "unit_price", "minimum_stock_alert_quantity",
                     "warehouse_location"]
CUSTOMER_UPDATABLE = ["customer_name", "mobile", "email", "business_name", "gst_number", "customer_type", "address",
                      "status", "follow_up_date"]


def update_by_id(table: DataFrame, updates: DataFrame, updatable: list[str]) -> DataFrame:
    """Every updatable column that ``updates`` carries replaces the stored
    value, null included (an empty field clears it).

    Returns the snapshot after the update with an ``outcome`` column
    (``applied`` / ``unchanged``), plus one ``not_found`` row, without values,
    per unknown id. With a ``command_id`` column the last update of a row wins;
    without it, ``updates`` must hold at most one row per id.
    """
    cols = [c for c in updatable if c in updates.columns and c in table.columns]
    if "command_id" in updates.columns:
        last = updates.groupBy("id").agg(F.max_by(F.struct(*cols), F.col("command_id")).alias("_u"))
        updates = last.select("id", *[F.col(f"_u.{c}").alias(c) for c in cols])
    u = updates.select(F.col("id"), *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_cmd"))
    j = table.withColumn("_stored", F.lit(True)).join(u, "id", "full_outer")
    stored, asked = F.col("_stored").isNotNull(), F.col("_cmd").isNotNull()
    out = [F.when(stored & asked, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
           for c in table.columns if c != "id"]
    return j.select("id", *out, F.when(~stored, "not_found").when(asked, "applied").otherwise("unchanged").alias("outcome"))


def update_products(products: DataFrame, updates: DataFrame) -> DataFrame:
    """W3 for products; stock is not updatable (Q18)."""
    return update_by_id(products, updates, PRODUCT_UPDATABLE)


def update_customers(customers: DataFrame, updates: DataFrame) -> DataFrame:
    """W3 for customers."""
    return update_by_id(customers, updates, CUSTOMER_UPDATABLE)


# -- W1 appends that hang on a parent --------------------------------------------------------
def append_rows(incoming: DataFrame, broken: DataFrame, parent: DataFrame, link: str,
                defaults: dict[str, object] | None = None) -> DataFrame:
    """New rows (``id``, ...) of a table whose ``link`` names a row of ``parent``.

    ``broken``: (record_id, rule) of the rows that break an input rule. A row is
    ``invalid`` if it breaks any, else ``not_found`` if its parent is missing,
    else ``applied``, with ``defaults`` in the columns it left out.
    """
    bad = broken.groupBy(F.col("record_id").alias("id")).agg(F.array_sort(F.collect_set("rule")).alias("_rules"))
    known = parent.select(F.col("id").alias(link)).distinct().withColumn("_known", F.lit(True))
    j = incoming.join(bad, "id", "left").join(known, link, "left")
    outcome = (F.when(F.col("_rules").isNotNull(), "invalid").when(F.col("_known").isNull(), "not_found").otherwise("applied"))
    filled = {c: F.coalesce(F.col(c), F.lit(v)) if c in incoming.columns else F.lit(v) for c, v in (defaults or {}).items()}
    cols = [filled.pop(c).alias(c) if c in filled else F.col(c) for c in incoming.columns]
    return j.select(*cols, *[v.alias(c) for c, v in filled.items()], outcome.alias("outcome"),
                    F.coalesce(F.array_join("_rules", ","), F.lit("")).alias("broken_rules"))


# -- W1 append with validation and defaults --------------------------------------------
def ingest_customers(existing: DataFrame, incoming: DataFrame, skip_duplicates: bool = True) -> DataFrame:
    """Default status LEAD, validate (V1), skip (name, mobile) already present.

    Defaults are applied before the rules, as the input parser does: a request
    without a status is a LEAD, not an invalid request. Of the valid requests
    of one batch the one with the lowest id wins a (name, mobile); an invalid
    request takes nothing from a later one. With ``skip_duplicates=False``
    every valid request is stored, as a plain insert would.
    """
    incoming = incoming.withColumn("status", F.coalesce(F.col("status"), F.lit("LEAD")))
    bad = dq.dq_customers(incoming).groupBy("record_id").agg(
        F.array_sort(F.collect_set("rule")).alias("broken_rules"))
    seen = existing.select("customer_name", "mobile").distinct().withColumn("_dup", F.lit(True))
    judged = incoming.join(bad, incoming.id == bad.record_id, "left").drop("record_id")
    first = (judged.where(F.col("broken_rules").isNull()).groupBy("customer_name", "mobile")
             .agg(F.min("id").alias("_first_id")))
    j = (judged.join(seen, ["customer_name", "mobile"], "left")
         .join(first, ["customer_name", "mobile"], "left"))
    outcome = (F.when(F.col("broken_rules").isNotNull(), "invalid")
               .when(F.lit(skip_duplicates) & (F.col("_dup") | (F.col("id") != F.col("_first_id"))), "duplicate")
               .otherwise("applied"))
    return j.select(*[c for c in incoming.columns if c != "status"], "status",
                    outcome.alias("outcome"),
                    F.coalesce(F.array_join("broken_rules", ","), F.lit("")).alias("broken_rules"))


# -- W16 referential actions ---------------------------------------------------------------
def cascade_delete_customers(customers: DataFrame, commands: DataFrame, challans: DataFrame,
                             follow_ups: DataFrame, queries: DataFrame, replies: DataFrame,
                             reviews: DataFrame) -> DataFrame:
    """Delete customers; follow-ups, questions (with replies) and reviews cascade.

    A customer referenced by a challan cannot be deleted (``conflict``): the
    challan foreign key has no delete action. Returns one row per command with
    the number of rows removed from each child table.
    """
    answered = replies.groupBy("query_id").agg(F.count(F.lit(1)).alias("replies_removed"))
    replied = queries.select(F.col("id").alias("query_id"), "customer_id").join(answered, "query_id", "inner")
    counted = ["follow_ups_removed", "queries_removed", "replies_removed", "reviews_removed"]

    def marks(df: DataFrame, name: str, value: Column | None = None) -> DataFrame:
        return df.where(F.col("customer_id").isNotNull()).select("customer_id", (F.lit(1) if value is None else value).cast("bigint").alias(name))

    # one aggregate over all tables: a chain of joins would hold a sort of every table in one task
    facts = commands.select("customer_id", F.lit(1).cast("bigint").alias("_asked"))
    for part in (marks(customers.select(F.col("id").alias("customer_id")), "_known"), marks(challans, "_blocked"),
                 marks(follow_ups, counted[0]), marks(queries, counted[1]),
                 marks(replied, counted[2], F.col(counted[2])), marks(reviews, counted[3])):
        facts = facts.unionByName(part, allowMissingColumns=True)
    per = facts.groupBy("customer_id").agg(*(F.sum(c).alias(c) for c in ["_asked", "_known", "_blocked", *counted]))
    outcome = F.when(F.col("_known").isNull(), "not_found").when(F.col("_blocked").isNotNull(), "conflict").otherwise("applied")
    dec = per.where(F.col("_asked").isNotNull()).withColumn("outcome", outcome)
    rows = dec.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.coalesce("_known", F.lit(1)))))  # one per stored customer
    return rows.select("customer_id", "outcome", *(
        F.when(F.col("outcome") == "applied", F.coalesce(c, F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias(c) for c in counted))


def delete_products(items: DataFrame, deleted: DataFrame) -> DataFrame:
    """Deleting a product sets the item's product id to null (the snapshot stays)."""
    d = deleted.select(F.col("id").alias("product_id"), F.lit(True).alias("_gone"))
    return items.join(d, "product_id", "left").select(
        *[F.when(F.col("_gone"), F.lit(None).cast("bigint")).otherwise(F.col("product_id")).alias("product_id")
          if c == "product_id" else F.col(c) for c in items.columns])


# -- W4 drafts and W6 numbering --------------------------------------------------------------
def draft_challans(requests: DataFrame, lines: DataFrame, customers: DataFrame,
                   products: DataFrame) -> DataFrame:
    """W4 + J17: new drafts; every item takes a snapshot of name, sku and price.

    ``requests``: challan_id, customer_id. ``lines``: challan_id, product_id,
    quantity, line_no. Outcome per challan: ``not_found`` (customer or any
    product missing), ``invalid`` (no items, a quantity <= 0, a product twice),
    else ``applied``. One row per requested line with its snapshot, and one row
    with null line columns for a request without lines, so that every request
    has an outcome.
    """
    cust = customers.select(F.col("id").alias("customer_id"), F.lit(True).alias("_cust"))
    lines = lines.join(requests.select("challan_id"), "challan_id", "left_semi")
    prod = products.select(F.col("id").alias("product_id"), "product_name", "sku", "unit_price")
    li = written(lines.join(prod, "product_id", "left"), "draft-lines")  # ends the stage: its sorts are not held with the next ones
    per = li.groupBy("challan_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_distinct("product_id").alias("n_products"),
        F.max(F.when(F.col("product_name").isNull(), 1).otherwise(0)).alias("missing"),
        F.min("quantity").alias("min_qty"),
        F.sum("quantity").cast("bigint").alias("total_quantity"))
    head = requests.join(cust, "customer_id", "left").join(per, "challan_id", "left")
    outcome = (F.when(F.col("_cust").isNull() | (F.col("missing") == 1), "not_found")
               .when(F.coalesce(F.col("n_items"), F.lit(0)) == 0, "invalid")
               .when((F.col("min_qty") <= 0) | (F.col("n_products") < F.col("n_items")), "invalid")
               .otherwise("applied"))
    h = head.select("challan_id", "customer_id", outcome.alias("outcome"),
                    F.when(outcome == "applied", F.col("total_quantity")).alias("total_quantity"))
    h = written(h, "draft-heads")
    return h.join(li, "challan_id", "left").select(
        "challan_id", "customer_id", "line_no", "product_id", "quantity", "outcome", "total_quantity",
        F.when(F.col("outcome") == "applied", F.col("product_name")).alias("product_name_snapshot"),
        F.when(F.col("outcome") == "applied", F.col("sku")).alias("sku_snapshot"),
        F.when(F.col("outcome") == "applied", F.col("unit_price")).alias("unit_price_snapshot"))


def challan_numbers(new_challans: DataFrame, last_sequence: Column) -> DataFrame:
    """Sequential numbers for new challans in (created_at, id) order.

    The global position is computed per sampled range (counts, then a prefix sum
    over the few range totals, then a row number inside each range), so no
    single task sorts all rows. ``last_sequence`` is the stored counter (a
    scalar column, e.g. a scalar subquery).
    """
    pos = positions(new_challans, [], ["created_at", "id"], "pos")
    seq = (last_sequence + F.col("pos")).cast("bigint")
    return pos.select("id", "created_at", seq.alias("sequence"),
                      challan_number(F.year("created_at"), seq).alias("challan_number"))

