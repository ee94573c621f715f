"""Data-quality jobs over whole tables: V1-V10, U2, S4, P13.

Each rule set yields one row per violation ``(table_name, record_id, rule)``.
Rules of one table are evaluated in a single pass: an array of
``when(bad, rule)`` is compacted and exploded, so a table is scanned once no
matter how many rules it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.config import (CAPABILITY_MATRIX, CRM_RULES, CUSTOMER_RULES, CUSTOMER_STATUSES,
                               CUSTOMER_TYPES, MOVEMENT_TYPES, PRICE_MAX, PRIORITIES,
                               PRODUCT_RULES, REASON_RULE, REQUEST_MESSAGE_RULE,
                               REQUEST_QTY_MAX, ROLES, REVIEW_NOTE_MAX)

EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
VIOLATION_SCHEMA = "table_name string, record_id bigint, rule string"


def _length_rule(col: str, lo: int, hi: int, optional: bool = False) -> Column:
    n = F.length(F.trim(F.col(col)))
    bad = (n < lo) | (n > hi)
    return bad if optional else (F.col(col).isNull() | bad)


def violations(df: DataFrame, table: str, key: str, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """One row per (record, broken rule)."""
    arr = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]))
    return (df.select(F.col(key).cast("bigint").alias("record_id"), F.explode(arr).alias("rule"))
              .select(F.lit(table).alias("table_name"), "record_id", "rule"))


def dq_customers(customers: DataFrame) -> DataFrame:
    """V1."""
    rules = [(f"{c}_length", _length_rule(c, lo, hi, optional=(c == "gst_number")))
             for c, (lo, hi) in CUSTOMER_RULES.items() if c in customers.columns]
    rules += [
        ("email_format", F.col("email").isNotNull() & ~F.col("email").rlike(EMAIL_PATTERN)),
        ("customer_type_enum", ~F.coalesce(F.col("customer_type").isin(*CUSTOMER_TYPES), F.lit(False))),
        ("status_enum", ~F.coalesce(F.col("status").isin(*CUSTOMER_STATUSES), F.lit(False))),
    ]
    return violations(customers, "customers", "id", rules)


def dq_products(products_stock: DataFrame) -> DataFrame:
    """V2 (stock is the ledger-derived level)."""
    rules = [(f"{c}_length", _length_rule(c, lo, hi)) for c, (lo, hi) in PRODUCT_RULES.items()]
    rules += [
        ("unit_price_range", F.col("unit_price").isNull() | (F.col("unit_price") < 0)
         | (F.col("unit_price") > F.lit(PRICE_MAX))),
        ("current_stock_negative", F.col("current_stock") < 0),
        ("minimum_negative", F.col("minimum_stock_alert_quantity").isNull()
         | (F.col("minimum_stock_alert_quantity") < 0)),
    ]
    return violations(products_stock, "products", "id", rules)


def dq_movements(movements: DataFrame, key: str = "product_id") -> DataFrame:
    """V3 (the ledger has no single-column key in the fixture: reported per product)."""
    lo, hi = REASON_RULE
    rules = [
        ("quantity_not_positive", F.col("quantity_changed").isNull() | (F.col("quantity_changed") <= 0)),
        ("movement_type_enum", ~F.coalesce(F.col("movement_type").isin(*MOVEMENT_TYPES), F.lit(False))),
        ("reason_length", _length_rule("reason", lo, hi)),
    ]
    return violations(movements, "stock_movements", key, rules)


def duplicate_challan_products(lines: DataFrame) -> DataFrame:
    """A product listed more than once in one challan."""
    return (lines.groupBy("challan_id", "product_id").agg(F.count(F.lit(1)).alias("occurrences"))
                 .where(F.col("occurrences") > 1))


def dq_challans(challans: DataFrame, lines: DataFrame) -> DataFrame:
    """V4: no items; quantity not positive; product twice in one challan."""
    # Distinct line keys first (map-side combine): a challan with a huge number of
    # lines is one row on the anti join's build side, not a skewed partition.
    no_items = challans.select(F.col("id").alias("challan_id")).join(
        lines.select("challan_id").distinct(), "challan_id", "left_anti").select(
        "challan_id", F.lit("no_items").alias("rule"))
    bad_qty = lines.where(F.col("quantity").isNull() | (F.col("quantity") <= 0)).select(
        "challan_id", F.lit("quantity_not_positive").alias("rule"))
    dup = duplicate_challan_products(lines).select("challan_id", F.lit("duplicate_product").alias("rule"))
    return (no_items.unionByName(bad_qty).unionByName(dup)
            .select(F.lit("challans").alias("table_name"), F.col("challan_id").alias("record_id"), "rule"))


def dq_crm(follow_ups: DataFrame, queries: DataFrame, replies: DataFrame, reviews: DataFrame) -> DataFrame:
    """V5 over follow-ups, questions, replies and reviews."""
    r = CRM_RULES
    fu = violations(follow_ups, "customer_follow_ups", "id", [("note_length", _length_rule("note", *r["note"]))])
    q = violations(queries, "customer_queries", "id", [
        ("subject_length", _length_rule("subject", *r["subject"])),
        ("message_length", _length_rule("message", *r["message"])),
        ("priority_enum", ~F.coalesce(F.col("priority").isin(*PRIORITIES), F.lit(False)))])
    rp = violations(replies.withColumn("reply_key", F.col("query_id") * 1000000 + F.col("turn")),
                    "customer_query_replies", "reply_key", [("reply_length", _length_rule("message", *r["reply"]))])
    rv = violations(reviews, "customer_reviews", "id", [
        ("rating_range", F.col("rating").isNull() | ~F.col("rating").between(1, 5)),
        ("review_length", _length_rule("review", *r["review"]))])
    return fu.unionByName(q).unionByName(rp).unionByName(rv)


def dq_stock_requests(requests: DataFrame) -> DataFrame:
    """V6; the note of a review, where the table has one, is optional and bounded."""
    lo, hi = REQUEST_MESSAGE_RULE
    note = [("review_note_length", F.length("review_note") > REVIEW_NOTE_MAX)] if "review_note" in requests.columns else []
    return violations(requests, "stock_requests", "id", note + [
        ("quantity_range", F.col("quantity").isNull() | ~F.col("quantity").between(1, REQUEST_QTY_MAX)),
        ("urgency_enum", ~F.coalesce(F.col("urgency").isin(*PRIORITIES), F.lit(False))),
        ("message_length", _length_rule("message", lo, hi))])


def dq_unique(pairs: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """V8: keys that occur more than once: (table_name, key_value, occurrences).

    As in a SQL UNIQUE constraint, rows with a NULL key part never collide.
    """
    out = None
    for table, df, cols in pairs:
        key = F.concat_ws("|", *[F.col(c).cast("string") for c in cols])
        complete = F.lit(True)
        for c in cols:
            complete = complete & F.col(c).isNotNull()
        d = (df.where(complete).groupBy(*cols).agg(F.count(F.lit(1)).alias("occurrences")).where(F.col("occurrences") > 1)
               .select(F.lit(table).alias("table_name"), key.alias("key_value"), "occurrences"))
        out = d if out is None else out.unionByName(d)
    return out


def dq_orphans(links: Sequence[tuple[str, str, DataFrame, DataFrame]], id_type: str = "bigint") -> DataFrame:
    """V9: child rows whose (non-null) link has no parent; one row per distinct dangling value.

    ``links``: (table, column, child frame, parent frame with an ``id`` column), whose
    ids are compared and returned as ``id_type``.
    Links that point at the same parent frame are unioned first, so each
    parent is anti-joined once; child values are pre-aggregated per
    (table, column, value) before the shuffle.
    """
    by_parent: dict[int, tuple[DataFrame, list[DataFrame]]] = {}
    for table, col, child, parent in links:
        vals = (child.where(F.col(col).isNotNull())
                .select(F.lit(table).alias("table_name"), F.lit(col).alias("column_name"),
                        F.col(col).cast(id_type).alias("missing_id"))
                .groupBy("table_name", "column_name", "missing_id").agg(F.count(F.lit(1)).alias("rows")))
        by_parent.setdefault(id(parent), (parent, []))[1].append(vals)
    out = None
    for parent, parts in by_parent.values():
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        d = u.join(parent.select(F.col("id").cast(id_type).alias("missing_id")), "missing_id", "left_anti") \
             .select("table_name", "column_name", "missing_id", "rows")
        out = d if out is None else out.unionByName(d)
    return out


def items_missing_product(lines: DataFrame, products: DataFrame) -> DataFrame:
    """Per challan, item product ids not found among products (or null, Q17)."""
    p = products.select(F.col("id").alias("product_id"))
    missing = lines.join(p, "product_id", "left_anti")
    return missing.groupBy("challan_id").agg(F.count(F.lit(1)).alias("missing_items"))


def challan_totals_check(challans: DataFrame, lines: DataFrame, header_totals: DataFrame | None = None) -> DataFrame:
    """State timestamps consistent with status; header total equals the item sum."""
    rules = [
        ("confirmed_without_time", (F.col("status") == "CONFIRMED") & F.col("confirmed_at").isNull()),
        ("cancelled_without_time", (F.col("status") == "CANCELLED") & F.col("cancelled_at").isNull()),
        ("draft_with_decision_time", (F.col("status") == "DRAFT")
         & (F.col("confirmed_at").isNotNull() | F.col("cancelled_at").isNotNull())),
        ("status_enum", ~F.coalesce(F.col("status").isin("DRAFT", "CONFIRMED", "CANCELLED"), F.lit(False))),
    ]
    state = violations(challans, "challans", "id", rules)
    if header_totals is None:
        return state
    sums = lines.groupBy("challan_id").agg(F.sum("quantity").cast("bigint").alias("item_total"))
    h = header_totals.select(F.col("id").alias("challan_id"), F.col("total_quantity").cast("bigint").alias("header"))
    bad = (h.join(sums, "challan_id", "left")
            .where(F.col("header") != F.coalesce(F.col("item_total"), F.lit(0)))
            .select(F.lit("challans").alias("table_name"), F.col("challan_id").alias("record_id"),
                    F.lit("total_mismatch").alias("rule")))
    return state.unionByName(bad)


def capability_matrix(spark: SparkSession) -> DataFrame:
    """The fixed role -> capability table (68 rows) as a DataFrame."""
    rows = [(cap, role, allowed) for cap, *flags in CAPABILITY_MATRIX for role, allowed in zip(ROLES, flags)]
    schema = T.StructType([T.StructField("capability", T.StringType()), T.StructField("role", T.StringType()),
                           T.StructField("allowed", T.BooleanType())])
    return spark.createDataFrame(rows, schema)


def user_capabilities(users: DataFrame, matrix: DataFrame) -> DataFrame:
    """Every user with every capability their role grants.

    The matrix is a fixed 68-row table, so broadcasting it is bounded.
    """
    granted = matrix.where(F.col("allowed")).select("role", "capability")
    return users.join(F.broadcast(granted), "role", "inner").select(
        F.col("id").alias("user_id"), F.col("name").alias("user_name"), "role", "capability")
