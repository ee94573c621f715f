"""Pages by number from a rank directory.

``offset`` sorts and throws away every row before the page, so page 1,000 costs more
than page 1. A ranked table is stored in list order, newest first, cut into
ranges at quantiles that Spark samples, each a partition folder of sorted files. The
directory beside it holds per range how many rows it has, the rank of its first row,
and that row's time and key. Page k is then found by its ranks: the directory names
the ranges that hold them (a page of 100 rows lies in 100 at most, as no range is
empty), and only their files are opened.

The directory has a row per range, a few hundred thousand at 100 TB, so the sum
over earlier ranges is a window over that small table.

``add`` gives new rows the range they fall into, by a running count of the
directory's bounds among them, and rewrites only those ranges (dynamic partition
overwrite); rows newer than all others go to the first range. A range grows by what is added
to it; ``create`` on the table's rows cuts them evenly again. One writer at a time.
The directory is written after the rows and always counted from them, so adding the
same rows again, by their key, completes an ``add`` that was cut off.

Times may be null (they come last); the key is unique and not null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.ordered import running_sum
from ledgerloom.functions.text import check_page
from ledgerloom.sources.scratch import written

RANGE = "_range"


@dataclass(frozen=True)
class Place:
    """The ranges that hold a page, and how many of their rows come before it."""

    ranges: list[int]
    skip: int


@dataclass(frozen=True)
class RankedTable:
    """Where the table lies, its columns, and what its list is sorted by, descending."""

    path: str
    schema: T.StructType
    time: str = "created_at"
    key: str = "id"

    def order(self) -> list[Column]:
        return [F.desc_nulls_last(self.time), F.desc(self.key)]

    def _stored(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType([*self.schema.fields, T.StructField(RANGE, T.IntegerType())])).parquet(f"{self.path}/rows")

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark).drop(RANGE)

    def directory(self, spark: SparkSession) -> DataFrame:
        """(range, rows, before, first): ``before`` rows come earlier in the list."""
        first = T.StructType([T.StructField(c, self.schema[c].dataType) for c in (self.time, self.key)])
        return spark.read.schema(T.StructType([T.StructField(RANGE, T.IntegerType()), T.StructField("rows", T.LongType()),
                                               T.StructField("before", T.LongType()), T.StructField("first", first)])).parquet(f"{self.path}/directory")

    def create(self, rows: DataFrame, ranges: int | None = None) -> None:
        """Store a whole table; ``ranges`` only where the session's partition sizes do not suit."""
        cut = rows.select(*self.schema.names)
        cut = cut.repartitionByRange(ranges, *self.order()) if ranges else cut.repartitionByRange(*self.order())
        # the numbers are written first: sorting by a number of the plan's own would number anew
        numbered = written(cut.withColumn(RANGE, F.spark_partition_id()), "ranked")
        self._write(numbered, "static")
        self._list(rows.sparkSession)

    def _write(self, rows: DataFrame, mode: str) -> None:
        (rows.repartition(RANGE).sortWithinPartitions(RANGE, *self.order())
         .write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(RANGE).parquet(f"{self.path}/rows"))

    def _list(self, spark: SparkSession) -> None:
        # the first in the list has the largest (time, key); a null time is the smallest
        found = self._stored(spark).groupBy(RANGE).agg(F.count(F.lit(1)).alias("rows"), F.max(F.struct(self.time, self.key)).alias("first"))
        earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
        found.select(RANGE, "rows", "before", "first").write.mode("overwrite").parquet(f"{self.path}/directory")

    def add(self, rows: DataFrame) -> list[int]:
        """Store more rows, each in its place; a key that the range has already is
        replaced. Returns the ranges that were rewritten."""
        spark = rows.sparkSession
        bounds = self.directory(spark).select("first.*", F.lit(True).alias("_bound"), RANGE)
        if bounds.isEmpty():
            self.create(rows)
            return sorted(r[0] for r in self.directory(spark).select(RANGE).collect())
        new = rows.select(*self.schema.names)
        placed = new.select(self.time, self.key).withColumn("_bound", F.lit(False)).withColumn(RANGE, F.lit(None).cast("int"))
        # a row falls into the last range that begins at or before it
        count = running_sum(bounds.unionByName(placed), [], [*self.order(), F.desc("_bound")], F.col("_bound").cast("int"), "_nth")
        nth = count.where("NOT _bound").select(self.key, F.greatest("_nth", F.lit(1)).alias("_nth"))
        numbers = bounds.select(RANGE, F.row_number().over(Window.orderBy(RANGE)).alias("_nth"))
        fresh = written(new.join(nth.join(numbers, "_nth").drop("_nth"), self.key), "ranked-add")
        touched = sorted(r[0] for r in fresh.select(RANGE).distinct().collect())  # numbers of ranges
        if touched:
            kept = self._stored(spark).where(F.col(RANGE).isin(touched)).join(fresh.select(self.key), self.key, "left_anti")
            self._write(kept.select(*fresh.columns).unionByName(fresh), "dynamic")
            self._list(spark)
        return touched

    def total(self, spark: SparkSession) -> int:
        """A1 without reading a row."""
        return self.directory(spark).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def place(self, spark: SparkSession, page: int, limit: int = 20) -> Place:
        offset, limit = check_page(page, limit)
        holds = (F.col("before") < offset + limit) & (F.col("before") + F.col("rows") > offset)
        found = self.directory(spark).where(holds).select(RANGE, "before").collect()  # ``limit`` rows at most
        return Place(sorted(r[0] for r in found), offset - min((r.before for r in found), default=offset))

    def page(self, spark: SparkSession, page: int, limit: int = 20) -> DataFrame:
        """The rows of one page, in list order; no other range's files are opened."""
        at = self.place(spark, page, limit)
        near = self._stored(spark).where(F.col(RANGE).isin(at.ranges)).drop(RANGE)
        return near.orderBy(*self.order()).offset(at.skip).limit(limit)

    def ranked(self, spark: SparkSession) -> DataFrame:
        """Every row with its ``rank`` in the list, from 1: the directory says how many rows
        come before a range, a window inside each range does the rest."""
        starts = self.directory(spark).select(RANGE, "before")
        inside = F.row_number().over(Window.partitionBy(RANGE).orderBy(*self.order()))
        return self._stored(spark).join(starts, RANGE).withColumn("rank", F.col("before") + inside).drop(RANGE, "before")
