"""W6 across batches: a durable counter that hands each batch a range of numbers.

Every batch id owns one small folder with the first number of its range and how many
there are. A batch that runs again gets the range it had, so no number is given
twice and none is left out. One writer at a time, like an auto-increment column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.commands import challan_numbers

_SCHEMA = "first bigint, n bigint, batch bigint"


@dataclass(frozen=True)
class Counter:
    path: str

    def start(self, spark: SparkSession, last: int) -> None:
        """The numbers up to ``last`` are taken."""
        self._own(spark, -1, last + 1, 0)

    def _own(self, spark: SparkSession, batch_id: int, first: int, n: int) -> None:
        spark.createDataFrame([(first, n)], "first bigint, n bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")

    def ranges(self, spark: SparkSession) -> DataFrame:
        """(first, n, batch) of every batch that has its range."""
        return spark.read.schema(_SCHEMA).parquet(self.path)

    def reserve(self, spark: SparkSession, batch_id: int, n: int) -> int:
        """The first of ``n`` numbers that belong to this batch, now and when it runs again."""
        own = self.ranges(spark).where(F.col("batch") == batch_id).first()
        if own is not None:
            if own.n != n:
                raise ValueError(f"batch {batch_id} has {own.n} numbers and now asks for {n}")
            return own.first
        first = self.ranges(spark).agg(F.max(F.col("first") + F.col("n"))).first()[0]
        self._own(spark, batch_id, first, n)
        return first


def number_batch(counter: Counter, batch_id: int, new_challans: DataFrame) -> DataFrame:
    """Numbers for one batch of new challans, in (created_at, id) order."""
    first = counter.reserve(new_challans.sparkSession, batch_id, new_challans.count())
    return challan_numbers(new_challans, F.lit(first - 1))
