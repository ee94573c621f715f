"""Batch all-or-nothing allocation (W5 confirm drafts, W8 manual adjustments).

One request at a time, the application locks the products, checks every
item against the current stock and either applies all items or none. A
batch in arrival order is sequential across products. This module decides a
whole batch exactly, with set operations only:

* every request is ``U`` (undecided), ``A`` (accepted) or ``R`` (rejected);
* per item, ``lo`` = demand of earlier accepted requests and ``hi`` = ``lo``
  plus demand of earlier undecided ones (a supply is negative demand and
  accepted from the start);
* accept a request when every item has ``stock - hi >= qty``; reject it when
  some item has ``stock - lo < qty``.

Accepted-so-far ⊆ true-accepted ⊆ not-rejected-so-far, so every decision is
the one the sequential process makes; the earliest undecided request has
``hi = lo`` and is always decided, so each round makes progress. A round reads
only the lines still undecided and those accepted in the round before, whose
demand it adds to the later lines' ``lo`` before they drop out: the work shrinks
with what is left. It is one split running sum (``functions.ordered``: hot
products are cut into ranges) and one ``groupBy(request)``, written to the
cluster's checkpoint folder.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.ordered import RANGE, in_ranges, running_sums
from ledgerloom.session import require_checkpoint_dir
from ledgerloom.functions.text import wall_time
from ledgerloom.sources.scratch import written

UNDECIDED, ACCEPTED, REJECTED = "U", "A", "R"
ORDER = ["seq_ts", "seq_id", "request_id", "line_no"]


def allocate(demands: DataFrame, stock: DataFrame) -> tuple[DataFrame, int]:
    """Decide a batch.

    ``demands``: request_id, seq_ts (timestamp), seq_id (tie-break), product_id,
    qty (int; negative = a supply that is always applied), line_no.
    ``stock``: product_id, available. A request is made of demands or of supplies, not both.
    Returns (decisions: request_id, status, short_product_id; rounds used).
    """
    rows, status, rounds = _decide(demands, stock)
    return status.join(_first_short(rows, status), "request_id", "left"), rounds


def _decide(demands: DataFrame, stock: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """The lines in ranges, (request_id, status) written once, and the rounds used."""
    require_checkpoint_dir(demands.sparkSession)
    st = stock.select("product_id", F.col("available").cast("bigint").alias("available"))
    rows = (demands.join(st, "product_id", "left")
            .withColumn("available", F.coalesce(F.col("available"), F.lit(0)))
            .withColumn("is_supply", F.col("qty") < 0))
    rows = in_ranges(rows, ["product_id"], ORDER)  # cut once, for all rounds
    line = [*ORDER, "product_id", "qty", "available", RANGE]
    state = F.when(F.col("is_supply"), F.lit(ACCEPTED)).otherwise(F.lit(UNDECIDED))
    work = rows.select(*line, F.lit(0).cast("bigint").alias("lo"), state.alias("status"))
    status = rows.where("is_supply").select("request_id", F.lit(ACCEPTED).alias("status")).distinct()
    undecided = work.where(F.col("status") == UNDECIDED).count()
    rounds = 0
    while undecided > 0:
        rounds += 1
        before = running_sums(work, ["product_id"], ORDER, {
            "taken": F.when(F.col("status") == ACCEPTED, F.col("qty")).otherwise(F.lit(0)),
            "asked": F.when(F.col("status") == UNDECIDED, F.col("qty")).otherwise(F.lit(0))},
            bucket=F.col(RANGE), inclusive=False, ranged=True)
        live = before.where(F.col("status") == UNDECIDED).select(*line, (F.col("lo") + F.col("taken")).alias("lo"), "asked")
        live = written(live, "allocation-live")  # the verdicts and the lines need different columns: the sums would run twice
        verdict = live.groupBy("request_id").agg(
            F.min((F.col("available") - F.col("lo") - F.col("asked") >= F.col("qty")).cast("int")).alias("all_ok"),
            F.max((F.col("available") - F.col("lo") < F.col("qty")).cast("int")).alias("any_short"))
        verdict = verdict.select("request_id", F.when(F.col("all_ok") == 1, F.lit(ACCEPTED))
                                 .when(F.col("any_short") == 1, F.lit(REJECTED)).otherwise(F.lit(UNDECIDED)).alias("status"))
        judged = written(live.drop("asked").join(verdict, "request_id"), "allocation")
        status = status.unionByName(judged.where(F.col("status") != UNDECIDED).select("request_id", "status").distinct())
        work = judged.where(F.col("status") != REJECTED)
        left = judged.where(F.col("status") == UNDECIDED).count()
        if left >= undecided:   # cannot happen: the earliest undecided request is always decided
            raise RuntimeError(f"allocation made no progress in round {rounds} ({left} lines undecided)")
        undecided = left

    return rows, written(status, "allocation-status"), rounds


def _first_short(rows: DataFrame, status: DataFrame) -> DataFrame:
    """The first short item of each rejected request (all earlier requests are decided: hi = lo)."""
    line = [*ORDER, "product_id", "qty", "available", "is_supply", RANGE]
    r = rows.select(*line).join(status, "request_id", "inner")
    lo_q = F.when(F.col("status") == ACCEPTED, F.col("qty")).otherwise(F.lit(0))
    final = running_sums(r, ["product_id"], ORDER, {"lo": lo_q}, bucket=F.col(RANGE), inclusive=False, ranged=True)
    return (final.where((F.col("status") == REJECTED) & ~F.col("is_supply")
                        & (F.col("available") - F.col("lo") < F.col("qty")))
            .groupBy("request_id").agg(F.min_by("product_id", F.struct("line_no", "product_id"))
                                       .alias("short_product_id"),
                                       F.min_by(F.col("available") - F.col("lo"), F.struct("line_no", "product_id"))
                                       .alias("short_available")))


def confirm_drafts(challans: DataFrame, lines: DataFrame, stock: DataFrame, products: DataFrame,
                   batch: DataFrame, at: dt.datetime) -> dict[str, DataFrame]:
    """Confirm a batch of challans in arrival order, all-or-nothing per challan.

    ``batch``: challan_id, requested_at (arrival order; ties by challan_id). A
    challan listed more than once is decided once, at its first request.
    Outcomes: ``applied``, ``insufficient_stock`` (with the first short
    product), ``product_missing`` (Q17), ``conflict`` (not DRAFT), ``not_found``,
    ``invalid`` (no items). Returns decisions, OUT movements and the new stock.
    """
    # A challan requested twice counts once, at its first request (the repeat
    # would find it no longer a draft).
    b = batch.groupBy("challan_id").agg(F.min("requested_at").alias("requested_at"))
    head = challans.select(F.col("id").alias("challan_id"), "status", "challan_number")
    known = b.join(head.select("challan_id", "status"), "challan_id", "left")
    asked = lines.join(b.select("challan_id"), "challan_id", "left_semi")
    items = asked.groupBy("challan_id", "product_id").agg(
        F.sum("quantity").cast("bigint").alias("qty"), F.min("line_no").alias("line_no"))
    pids = products.select(F.col("id").alias("product_id"), F.lit(True).alias("_exists")).distinct()
    checked = written(items.join(pids, "product_id", "left"), "allocation-items")
    items = checked.drop("_exists")
    flags = checked.groupBy("challan_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.max(F.when(F.col("_exists").isNull(), 1).otherwise(0)).alias("missing"),
        F.max(F.when(F.col("qty").isNull() | (F.col("qty") <= 0), 1).otherwise(0)).alias("bad_qty"))
    pre = known.join(flags, "challan_id", "left").select(
        "challan_id", "requested_at",
        F.when(F.col("status").isNull(), "not_found")
         .when(F.col("status") != "DRAFT", "conflict")
         .when((F.coalesce(F.col("n_items"), F.lit(0)) == 0) | (F.col("bad_qty") == 1), "invalid")
         .when(F.col("missing") == 1, "product_missing").alias("pre_outcome"))
    pre = written(pre, "allocation-requests")
    eligible = pre.where(F.col("pre_outcome").isNull())
    demands = (items.join(eligible.select("challan_id", "requested_at"), "challan_id", "inner")
               .select(F.col("challan_id").alias("request_id"), F.col("requested_at").alias("seq_ts"),
                       F.col("challan_id").alias("seq_id"), "product_id", "qty", "line_no"))
    rows, status, _ = _decide(demands, stock)
    d = status.join(_first_short(rows, status), "request_id", "left").withColumnRenamed("request_id", "challan_id")
    out = pre.join(d, "challan_id", "left").select(
        "challan_id",
        F.coalesce(F.col("pre_outcome"),
                   F.when(F.col("status") == ACCEPTED, "applied").otherwise("insufficient_stock")).alias("outcome"),
        "short_product_id", "short_available")
    applied = status.where(F.col("status") == ACCEPTED).select(F.col("request_id").alias("challan_id"))
    accepted = eligible.select("challan_id").join(applied, "challan_id", "left_semi")
    moves = (items.join(accepted, "challan_id", "inner")
             .join(head.select("challan_id", "challan_number"), "challan_id", "inner")
             .select("product_id", F.col("qty").cast("int").alias("quantity_changed"),
                     F.lit("OUT").alias("movement_type"),
                     F.concat(F.lit("Confirmed sales challan "), F.col("challan_number")).alias("reason"),
                     F.lit("CHALLAN").alias("reference_type"), F.col("challan_id").alias("reference_id"),
                     wall_time(at).alias("created_at")))
    used = moves.groupBy("product_id").agg(F.sum("quantity_changed").alias("used"))
    new_stock = (stock.join(used, "product_id", "left")
                 .select("product_id", (F.col("available") - F.coalesce(F.col("used"), F.lit(0))).alias("available")))
    return {"decisions": out, "movements": moves, "stock": new_stock}


def apply_adjustments(commands: DataFrame, stock: DataFrame, products: DataFrame) -> DataFrame:
    """Manual IN/OUT adjustments in order; an OUT larger than the stock is refused.

    ``commands``: command_id, product_id, movement_type, quantity, requested_at.
    A refused OUT does not count, so later OUTs may pass: the same exact
    allocation as W5 with one-item requests and INs as supplies. A command
    whose quantity is not a positive whole number, whose type is not IN/OUT or
    that names no product is ``invalid``; a product that is not in ``products``
    is ``not_found``; neither takes part.
    """
    qty = F.col("quantity").try_cast("int")          # F23: coerce landed text to a number
    valid = ((qty > 0) & F.col("movement_type").isin("IN", "OUT") & F.col("requested_at").isNotNull()
             & F.col("product_id").isNotNull())
    known = products.select(F.col("id").alias("product_id")).distinct().withColumn("_known", F.lit(True))
    commands = commands.withColumn("_valid", F.coalesce(valid, F.lit(False))).join(known, "product_id", "left")
    dem = commands.where(F.col("_valid") & F.col("_known")).select(
        F.col("command_id").alias("request_id"), F.col("requested_at").alias("seq_ts"),
        F.col("command_id").alias("seq_id"), "product_id",
        F.when(F.col("movement_type") == "IN", -qty).otherwise(qty).cast("bigint").alias("qty"),
        F.lit(0).alias("line_no"))
    decisions, _ = allocate(dem, stock)
    return commands.join(decisions.select(F.col("request_id").alias("command_id"), "status"), "command_id", "left") \
        .select("command_id", "product_id", "movement_type", "quantity", "requested_at",
                F.when(~F.col("_valid"), "invalid").when(F.col("_known").isNull(), "not_found")
                 .when(F.col("status") == ACCEPTED, "applied")
                 .otherwise("insufficient_stock").alias("outcome"))


def adjustment_effects(decisions: DataFrame, stock: DataFrame, created_by) -> dict[str, DataFrame]:
    """The ledger rows of the applied adjustments, and the stock after them."""
    done = decisions.where(F.col("outcome") == "applied").withColumn("_qty", F.col("quantity").try_cast("int"))
    moves = done.select("product_id", F.col("_qty").alias("quantity_changed"), "movement_type",
                        F.lit("MANUAL_ADJUSTMENT").alias("reference_type"), F.col("command_id").alias("reference_id"),
                        F.lit(created_by).cast("bigint").alias("created_by"), F.col("requested_at").alias("created_at"))
    change = moves.groupBy("product_id").agg(F.sum(
        F.when(F.col("movement_type") == "IN", F.col("quantity_changed")).otherwise(-F.col("quantity_changed"))).alias("_change"))
    after = stock.join(change, "product_id", "full_outer").select(
        "product_id", (F.coalesce("available", F.lit(0)) + F.coalesce("_change", F.lit(0))).cast("bigint").alias("available"))
    return {"movements": moves, "stock": after}
