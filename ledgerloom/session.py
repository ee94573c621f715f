"""Session construction and cluster-facing settings.

On a cluster the session is created by the platform; ``build_session`` is for
tests, the bench and local runs. Library code only *reads* settings from the
active session (``checkpoint_dir``) and never points at machine-local paths
unless the caller asked for a local session.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session of ours wants. AQE re-plans joins from runtime sizes
# (broadcast only when the measured side is under the threshold, skew-join
# splitting, partition coalescing), so no operator hard-codes a broadcast of a
# table that grows with the data.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


# Settings for a large cluster (~1000 executors, ~100 TB of input), applied as
# runtime SQL settings with ``apply_cluster_settings``. Sizing: the largest
# shuffles are line-level (challan ⋈ items, ledger windows, allocation
# rounds); after projection that is on the order of 15-20 TB, i.e. ~65k
# partitions of ~256 MB, which AQE coalesces for smaller stages. Scans use
# 512 MB splits (~200k scan tasks, ~50 waves on 4,000 cores).
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.shuffle.partitions": "65536",
    "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def apply_cluster_settings(spark: SparkSession, overrides: dict | None = None) -> SparkSession:
    """Apply ``CLUSTER_CONF`` (and overrides) to a running session's SQL settings."""
    for key, value in {**CLUSTER_CONF, **(overrides or {})}.items():
        spark.conf.set(key, value)
    return spark


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "ledgerloom", extra: dict | None = None) -> SparkSession:
    """Local/test session. Sets a checkpoint folder only when none is configured."""
    master = master or f"local[{os.environ.get('BENCH_CPUS', '8')}]"
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("LEDGERLOOM_DRIVER_MEMORY", "16g")
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not checkpoint_dir(spark) and _is_local(spark):
        # Tests and local runs only: a fresh scratch folder per session.
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-ckpt-", dir="/tmp"))
    return spark


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared checkpoint folder the cluster names (``spark.checkpoint.dir``)."""
    sc = spark.sparkContext
    found = sc.getCheckpointDir()
    if found:
        return found
    conf = sc.getConf().get("spark.checkpoint.dir")
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir()
    return None


def require_checkpoint_dir(spark: SparkSession) -> str:
    found = checkpoint_dir(spark)
    if not found:
        raise RuntimeError(
            "spark.checkpoint.dir is not set; iterative jobs cut lineage with "
            "checkpoint() into the cluster's shared checkpoint folder")
    return found


def prepare_for_fixtures(spark: SparkSession) -> SparkSession:
    """What the fixture jobs assume of a session they did not create.

    The fixture times are wall-clock UTC, so the session zone is pinned to
    UTC; a checkpoint folder is set only when the session names none (local
    checks), never replacing the cluster's.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if not checkpoint_dir(spark) and _is_local(spark):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-ckpt-", dir="/tmp"))
    return spark


def _is_local(spark: SparkSession) -> bool:
    """A scratch folder on this machine is only shared by all tasks in local mode."""
    return spark.sparkContext.master.startswith("local")
