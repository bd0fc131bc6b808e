"""Session settings shared by the jobs, the tests and the bench.

Every job is a lazy DataFrame plan, so these settings are the only place where
execution strategy is steered; the plans themselves carry no hints except where a
side has a proven size bound.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every session needs for correct results (not tuning):
#  - UTC so DATE(ts) and date literals mean the same thing on every executor,
#  - ANSI on so an unguarded division or overflow fails instead of returning NULL.
CORRECTNESS_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
}

# Settings for scale. AQE re-plans between stages from *measured* sizes:
#  - a join side is broadcast only when its materialised size is below the
#    threshold, otherwise the sort-merge join stays (the size check with a fallback).
#    The driver builds every broadcast table, in up to three times the rows' size, and a
#    job has up to 15 of them at a time, so the limit is small: 10 MB,
#  - skewed shuffle partitions of a join are split (a hot product or order key),
#  - small shuffle partitions are coalesced, up to 16 MB: shuffle bytes are compressed,
#    and a task that sorts or groups the narrow history rows holds about 20 times as much.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB",
    "spark.sql.files.maxPartitionBytes": "128MB",
    # Static size estimates of Parquet scans use the compressed file size; a factor
    # keeps a dimension near the threshold from being broadcast on that estimate alone
    # (AQE still broadcasts it when its measured size is small).
    "spark.sql.sources.fileCompressionFactor": "4.0",
}


def apply_conf(spark: SparkSession) -> SparkSession:
    """Set the correctness and scale settings on an existing session."""
    for key, value in {**CORRECTNESS_CONF, **SCALE_CONF}.items():
        spark.conf.set(key, value)
    return spark


ROWS_PER_PIECE = 500_000


def split_shuffles(spark: SparkSession, rows: int) -> None:
    """Let every shuffle start from enough pieces for a table of ``rows`` rows.

    AQE only merges pieces (up to the advisory size); ``spark.sql.shuffle.partitions`` of them
    alone would each grow with the table, and so would the task that sorts one. All
    shuffles get the same number, so that grouped and joined sides still match.
    """
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_PIECE))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(pieces))


def shuffle_partitions_for(largest_shuffle_bytes: int, target_partition_bytes: int = 256 * 2**20,
                           minimum: int = 200) -> int:
    """Initial shuffle partitions so the largest shuffle splits into ~256 MB pieces.

    AQE only *coalesces* shuffle partitions (and splits skewed join partitions), so the
    initial number must be large enough for the biggest stage; small stages are merged
    back to the advisory size at run time. Example: the margin base at 100 TB shuffles
    its eligible, column-pruned lines (order of 5-10 TB) -> 20,000-40,000 partitions.
    """
    return max(minimum, -(-largest_shuffle_bytes // target_partition_bytes))


def apply_cluster_conf(spark: SparkSession, largest_shuffle_bytes: int) -> SparkSession:
    """``apply_conf`` plus shuffle partitioning sized for the largest expected shuffle."""
    apply_conf(spark)
    n = str(shuffle_partitions_for(largest_shuffle_bytes))
    spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", n)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "shelfwise") -> SparkSession:
    """A local session for tests and the bench (no UI, no extra ports)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SHELFWISE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**CORRECTNESS_CONF, **SCALE_CONF}.items():
        builder = builder.config(key, value)
    event_dir = os.environ.get("SHELFWISE_EVENT_LOG_DIR")
    if event_dir:  # stage and task metrics for the bench, read back from the files
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this setting names a shared folder and is only read; a cluster session
    without one is refused. A scratch folder is set only for a local session (tests).
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        current = tempfile.mkdtemp(prefix="shelfwise-ckpt-")
        spark.conf.set("spark.checkpoint.dir", current)
    spark.sparkContext.setCheckpointDir(current)
    return current
