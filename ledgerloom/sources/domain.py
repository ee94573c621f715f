"""S1 for the domain tables: fixed schemas and a stored, date-partitioned layout.

In production the domain tables are stored, not derived views. This module
holds their ``StructType``s (the 13 tables that carry data; the document
sequence table is a counter and is not kept — see ``challan_numbers``), writes
them with a layout that lets Parquet skip what a query does not need, and
reads them back with the fixed schema (no inference):

* ``challans`` partitioned by ``confirmed_month`` (``yyyy-MM``; drafts and
  cancellations land in the null partition) and sorted by confirmation time
  inside each file, so the sales window prunes partitions and row groups;
* ``stock_movements`` partitioned by ``created_month`` and sorted by product;
* ``challan_items`` sorted by ``challan_id`` so row-group statistics bound the
  join keys.

``write_bucketed`` stores challans and their items in equally many buckets of the
challan id instead, as tables of the session's catalog: their join needs no shuffle
of either side, so the lines, the largest table, are never moved.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_L, _I, _S, _D, _TS, _B = (T.LongType(), T.IntegerType(), T.StringType(), T.DateType(),
                           T.TimestampNTZType(), T.BooleanType())
_MONEY = T.DecimalType(12, 2)


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


DOMAIN_SCHEMAS: dict[str, T.StructType] = {
    "users": _struct(("id", _L), ("name", _S), ("email", _S), ("role", _S)),
    "customers": _struct(("id", _L), ("customer_name", _S), ("business_name", _S), ("mobile", _S),
                         ("email", _S), ("gst_number", _S), ("customer_type", _S), ("status", _S),
                         ("follow_up_date", _D), ("address", _S)),
    "customer_follow_ups": _struct(("id", _L), ("customer_id", _L), ("note", _S), ("follow_up_date", _D),
                                   ("created_by", _L), ("created_at", _TS)),
    "products": _struct(("id", _L), ("product_name", _S), ("sku", _S), ("category", _S), ("unit_price", _MONEY),
                        ("minimum_stock_alert_quantity", _I), ("warehouse_location", _S)),
    "stock_movements": _struct(("id", _S), ("product_id", _L), ("quantity_changed", _I), ("movement_type", _S),
                               ("reason", _S), ("reference_type", _S), ("reference_id", _L),
                               ("created_by", _L), ("created_at", _TS)),
    "challans": _struct(("id", _L), ("challan_number", _S), ("customer_id", _L), ("created_by", _L),
                        ("status", _S), ("created_at", _TS), ("confirmed_at", _TS), ("cancelled_at", _TS),
                        ("total_quantity", _L)),
    "challan_items": _struct(("challan_id", _L), ("line_no", _I), ("product_id", _L),
                             ("product_name_snapshot", _S), ("sku_snapshot", _S),
                             ("unit_price_snapshot", _MONEY), ("quantity", _I)),
    "notifications": _struct(("id", _S), ("type", _S), ("title", _S), ("detail", _S), ("priority", _S),
                             ("related_type", _S), ("related_id", _L), ("created_at", _TS)),
    "notification_reads": _struct(("notification_id", _S), ("user_id", _L), ("read_at", _TS)),
    "customer_queries": _struct(("id", _L), ("customer_id", _L), ("subject", _S), ("message", _S),
                                ("status", _S), ("priority", _S), ("created_by", _L), ("created_at", _TS), ("resolved_at", _TS)),
    "customer_reviews": _struct(("id", _L), ("customer_id", _L), ("rating", _I), ("review", _S),
                                ("created_by", _L), ("created_at", _TS)),
    "customer_query_replies": _struct(("query_id", _L), ("turn", _L), ("message", _S), ("created_by", _L), ("created_at", _TS)),
    "stock_requests": _struct(("id", _L), ("product_id", _L), ("requested_by", _L), ("quantity", _I),
                              ("urgency", _S), ("message", _S), ("status", _S), ("reviewed_by", _L),
                              ("created_at", _TS), ("reviewed_at", _TS), ("review_note", _S)),
}

# table -> (partition column, expression that derives it, sort columns inside files)
LAYOUT = {
    "challans": ("confirmed_month", lambda: F.date_format("confirmed_at", "yyyy-MM"), ["confirmed_at", "id"]),
    "stock_movements": ("created_month", lambda: F.date_format("created_at", "yyyy-MM"), ["product_id", "created_at"]),
    "challan_items": (None, None, ["challan_id"]),
}


# table -> (bucket column, sort columns inside a bucket)
BUCKETED = {"challans": ("id", ["id"]), "challan_items": ("challan_id", ["challan_id", "line_no"])}


def conform(df: DataFrame, name: str) -> DataFrame:
    """Project and cast a frame onto the fixed schema of ``name``; a column that the
    frame does not have is null."""
    def column(f: T.StructField):
        return (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)

    return df.select(*[column(f) for f in DOMAIN_SCHEMAS[name].fields])


def write_domain_table(df: DataFrame, root: str, name: str, mode: str = "overwrite") -> None:
    """Store one domain table in the layout above (whole-table rewrite or append)."""
    out = conform(df, name)
    part, expr, sort = LAYOUT.get(name, (None, None, []))
    if part:
        # a month is spread over as many tasks as it needs, and so are the rows without one
        out = out.withColumn(part, expr()).repartitionByRange(part, *sort)
    if sort:
        # with the partition column first, the writer needs no sort of its own, which would undo this one
        out = out.sortWithinPartitions(*([part] if part else []), *sort)
    w = out.write.mode(mode)
    if part:
        w = w.partitionBy(part)
    w.parquet(f"{root.rstrip('/')}/{name}")


def _catalog_name(root: str, name: str) -> str:
    return f"ledgerloom_{name}_{zlib.crc32(root.rstrip('/').encode()):08x}"


def write_bucketed(df: DataFrame, root: str, name: str, buckets: int) -> DataFrame:
    """Store ``challans`` or ``challan_items`` in buckets of the challan id, each
    bucket one sorted file (per month), and return the table."""
    key, sort = BUCKETED[name]
    part, expr, _ = LAYOUT[name]
    out = conform(df, name)
    if part:
        out = out.withColumn(part, expr())
    # the shuffle hashes like the buckets, so a task holds one bucket and writes one file (per month)
    w = out.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", f"{root.rstrip('/')}/{name}")
    w = w.bucketBy(buckets, key).sortBy(*sort)
    if part:
        w = w.partitionBy(part)
    w.saveAsTable(_catalog_name(root, name))
    return df.sparkSession.table(_catalog_name(root, name))


def open_bucketed(spark: SparkSession, root: str, name: str, buckets: int) -> DataFrame:
    """A table of ``write_bucketed`` in a session that has not written it."""
    key, sort = BUCKETED[name]
    part = LAYOUT[name][0]
    fields = [*DOMAIN_SCHEMAS[name].fields, *([T.StructField(part, _S)] if part else [])]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    months = f"PARTITIONED BY ({part})" if part else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_catalog_name(root, name)} ({columns}) USING parquet {months} "
              f"CLUSTERED BY ({key}) SORTED BY ({', '.join(sort)}) INTO {buckets} BUCKETS LOCATION '{root.rstrip('/')}/{name}'")
    return spark.table(_catalog_name(root, name))


def read_domain_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Scan a stored domain table with its fixed schema (plus its partition column)."""
    schema = DOMAIN_SCHEMAS[name]
    part = LAYOUT.get(name, (None,))[0]
    if part:
        schema = T.StructType(list(schema.fields) + [T.StructField(part, _S, True)])
    return spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{name}")


def with_totals(challans: DataFrame, items: DataFrame) -> DataFrame:
    """Challans with the total units that a stored challan carries (0 without lines)."""
    total = items.groupBy(F.col("challan_id").alias("id")).agg(F.sum("quantity").cast("bigint").alias("total_quantity"))
    return challans.join(total, "id", "left").withColumn("total_quantity", F.coalesce("total_quantity", F.lit(0)))


def materialize_fixture(fixture, root: str) -> None:
    """Write the fixture's domain views as stored domain tables (a one-off load, S8)."""
    frames = {
        "users": fixture.users(), "customers": fixture.customers(with_address=True), "customer_follow_ups": fixture.follow_ups(),
        "products": fixture.products(), "stock_movements": fixture.movements(ids=True),
        "challans": with_totals(fixture.challans(), fixture.raw_lines()),
        "challan_items": fixture.items(), "customer_queries": fixture.queries(),
        "customer_reviews": fixture.reviews(), "customer_query_replies": fixture.replies(),
        "stock_requests": fixture.stock_requests(),
    }
    for name, df in frames.items():
        write_domain_table(df, root, name)


def materialize_bucketed(fixture, root: str, buckets: int) -> tuple[DataFrame, DataFrame]:
    """The fixture's challans and their items in buckets of the challan id."""
    return (write_bucketed(with_totals(fixture.challans(), fixture.raw_lines()), root, "challans", buckets),
            write_bucketed(fixture.items(), root, "challan_items", buckets))
