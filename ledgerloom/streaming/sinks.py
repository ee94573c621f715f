"""Sinks of the streaming jobs: plain Parquet, one folder per micro-batch.

``land`` writes what a micro-batch produced to ``<path>/batch=<id>``; a replayed
batch rewrites the same folder, so nothing is doubled. A figure is the sum, or
the newest version, over all folders, computed on read. ``prepare`` writes an
empty (or initial) folder ``batch=-1`` first, so that reading never meets a
missing path and a storage error is never taken for an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerloom.session import require_checkpoint_dir


def stream_root(spark: SparkSession, job: str) -> str:
    """A fresh folder for one run of a job, inside the cluster's checkpoint
    folder; for checks and tests. Production runs name their own output path."""
    base = require_checkpoint_dir(spark).rstrip("/")
    return f"{base}/ledgerloom-streams/{job}-{uuid.uuid4().hex[:12]}"


def land(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def prepare(spark: SparkSession, path: str, schema: T.StructType | str, initial: DataFrame | None = None) -> None:
    land(initial if initial is not None else spark.createDataFrame([], schema), path, -1)


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows, with the ``batch`` they came in; nothing is inferred from the files."""
    return spark.read.schema(f"{schema}, batch bigint").parquet(path)
