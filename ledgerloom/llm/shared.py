"""Small helpers of the operators: shared scratch tables, bounded collection."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import vectext as vt
from ledgerloom.session import prepare_for_fixtures, require_checkpoint_dir


#: Rows that travel to a Python worker at a time; texts are long.
BATCH_ROWS = 1000


def ready(spark: SparkSession) -> SparkSession:
    """The session with what the operators assume of it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return prepare_for_fixtures(spark)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a new table in the shared checkpoint folder and read it
    back: cuts the lineage, survives lost executors and is computed once."""
    spark = df.sparkSession
    path = f"{require_checkpoint_dir(prepare_for_fixtures(spark))}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(n: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo n (the folds of the learned operators)."""
    return F.crc32(F.col(column).cast("string")) % n


def label_sample(labels: DataFrame, learn, label: str, n: int, key: str = "doc_id") -> DataFrame:
    """(key, label, place): the ``n`` labelled learning ids with the smallest digests,
    all of them if fewer. A bounded table made on the driver, small enough to be
    broadcast; of repeated labels the largest counts."""
    spark = labels.sparkSession
    known = (labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & learn)
             .groupBy(F.col(key).alias("key")).agg(F.max(F.col(label)).cast("int").alias("label")))
    picked = known.orderBy(F.xxhash64(F.col("key").cast("string")), "key").limit(n)
    rows = [(r.key, r.label, place) for place, r in enumerate(picked.collect())]
    return spark.createDataFrame(rows, known.schema.add("place", "integer"))


def filter_texts(docs: DataFrame, text: str, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text ``keep`` keeps:
    a function of the bytes and offsets of a piece of the texts, to a mask.
    Rows travel as one struct, so no column name can clash."""
    packed = docs.select(F.struct("*").alias("row"))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = b.column(0)
            data, offsets = vt.column_bytes(rows.field(place))
            masks = [keep(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]) for lo, hi in vt.pieces(offsets)]
            mask = pa.array(np.concatenate(masks) if masks else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([rows.filter(mask)], ["row"])

    return packed.mapInArrow(run, packed.schema).select("row.*")
