"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ledgerloom.session import prepare_for_fixtures, require_checkpoint_dir


def scratch_path(spark, name: str) -> str:
    """A new folder below the cluster's checkpoint folder, never used before."""
    return f"{require_checkpoint_dir(prepare_for_fixtures(spark)).rstrip('/')}/ledgerloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: the lineage ends here, the rows survive
    lost executors, and nothing is computed twice (an eager ``checkpoint`` runs the
    last stage for its count and again for its files)."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
