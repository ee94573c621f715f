"""Stored tables with a unique key, changed by copy-on-write.

Plain Parquet has no unique index and no MERGE. A keyed table is partitioned by a
hash of its key into a fixed number of buckets; a batch of commands

1. is folded to one row per key (a partial/final aggregate, so a key that holds a
   third of all commands is no hot task);
2. meets only the buckets its keys fall into (partition pruning by bucket number;
   the list has at most ``buckets`` small numbers);
3. rewrites only the buckets in which a row really changes, by dynamic partition
   overwrite. Files of all other buckets are not touched.

The rewrite stages its files and swaps whole buckets when all tasks are done. A job
that dies before that leaves the table as it was; one that dies while swapping may
leave some buckets old, and running the same batch again completes it, because
every step here is idempotent. One writer at a time.

Each bucket holds one row without a key, so that a bucket that loses its last row
is rewritten as well; reading leaves it out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.scratch import written

BUCKET = "_bucket"


@dataclass(frozen=True)
class KeyedTable:
    """Where the table lies, its columns, its unique key (never null), and into how
    many buckets it is cut: a bucket is what the smallest change rewrites."""

    path: str
    schema: T.StructType
    key: tuple[str, ...]
    buckets: int = 1024

    @property
    def columns(self) -> list[str]:
        return self.schema.names

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(k) for k in self.key)), F.lit(self.buckets)).cast("int")

    def has_key(self) -> Column:
        return reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in self.key))

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])).parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).where(self.has_key()).drop(BUCKET)

    def create(self, rows: DataFrame) -> None:
        """Store a whole table whose keys are unique and not null."""
        self._write(rows.select(*self.columns).withColumn(BUCKET, self.bucket()), range(self.buckets))

    def _write(self, rows: DataFrame, buckets: Sequence[int]) -> None:
        spark = rows.sparkSession
        marks = spark.range(1).select(F.explode(F.lit(list(buckets))).alias(BUCKET))
        marks = marks.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields), BUCKET)
        (rows.unionByName(marks).repartition(BUCKET).sortWithinPartitions(BUCKET, *self.key)
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path))

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of ``rows`` fall into: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.where(self.has_key()).select(self.bucket()).distinct().collect())

    def near(self, spark: SparkSession, buckets: Sequence[int]) -> DataFrame:
        """The stored rows of these buckets; no other bucket is listed or read."""
        return self._stored(spark).where(F.col(BUCKET).isin(list(buckets)) & self.has_key()).drop(BUCKET)

    def apply(self, puts: DataFrame, deletes: DataFrame | None = None) -> list[int]:
        """Make the rows of ``puts`` (one per key) the stored ones and take out the keys
        of ``deletes``; returns the buckets that were rewritten."""
        spark = puts.sparkSession
        gone = puts.select(*self.key)
        if deletes is not None:
            gone = gone.unionByName(deletes.select(*self.key))
        buckets = self.touched(gone)
        if buckets:
            kept = self.near(spark, buckets).join(gone, list(self.key), "left_anti")
            rows = kept.select(*self.columns).unionByName(puts.select(*self.columns))
            self._write(rows.withColumn(BUCKET, self.bucket()), buckets)
        return buckets


def upsert(table: KeyedTable, commands: DataFrame, order: str, update: Sequence[str]) -> DataFrame:
    """``INSERT ... ON DUPLICATE KEY UPDATE update`` for a batch of commands.

    ``commands`` carries the table's columns and ``order``, a unique number. The
    commands of one key take effect in this order: the first on an absent key
    inserts its row, every other one sets the ``update`` columns (none: it changes
    nothing). Returns ``order``, the key and an ``outcome`` per command: ``inserted``,
    ``updated``, ``unchanged`` (there is nothing to update) or ``invalid`` (no key)."""
    spark, key = commands.sparkSession, list(table.key)
    update = list(update)
    rest = [c for c in table.columns if c not in key]
    valid = commands.where(table.has_key())
    folded = valid.groupBy(*key).agg(F.min(F.struct(order, *rest)).alias("first"), F.max(F.struct(F.col(order).alias("_order"), *update)).alias("last"))
    old = table.near(spark, table.touched(folded)).select(*key, F.struct(*rest).alias("old"))
    decided = written(folded.join(old, key, "left"), "upsert")

    new = F.col("old").isNull()
    wanted = [F.when(new | F.lit(c in update), F.col(f"last.{c}") if c in update else F.col(f"first.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in rest]
    changed = reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"old.{c}")) for c in update), F.lit(False))
    table.apply(decided.select(*key, "old", *wanted).where(new | changed))

    asked = commands.select(order, *key)
    known = decided.select(*(F.col(k).alias(f"_{k}") for k in key), F.when(new, F.col(f"first.{order}")).alias("_first"))
    same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_{k}") for k in key))
    outcome = (F.when(~table.has_key(), "invalid").when(F.col(order) == F.col("_first"), "inserted")
               .otherwise("updated" if update else "unchanged"))
    return asked.join(known, same, "left").select(order, *key, outcome.alias("outcome"))
