"""The stock-health snapshot table read by the trend job.

One partition per ``snapshot_date``. Writing a date again replaces only that date's
partition (dynamic partition overwrite), so a re-run after a failure is idempotent.
The table should live in shared storage (e.g. under the cluster's
``spark.checkpoint.dir`` or a warehouse path), never on a machine-local disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARTITION = "snapshot_date"


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write (or rewrite) the snapshot dates present in ``df``."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(PARTITION).parquet(path))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
