"""The set of logical input tables a job reads.

``Tables`` is a plain name -> DataFrame mapping with attribute access. It can be
built from a warehouse folder (one Parquet dataset per logical table, history
partitioned by ``date``), from the driver's test tables (``sources.testdata``) or
from hand-made DataFrames in tests.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


class Tables:
    """Lazily built logical tables; each is built at most once per instance."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._built:
            try:
                builder = self._builders[name]
            except KeyError as exc:
                raise AttributeError(f"no logical table {name!r}") from exc
            self._built[name] = builder()
        return self._built[name]

    def replace(self, **frames: DataFrame) -> "Tables":
        """A copy with some tables swapped for given DataFrames (used by tests)."""
        builders = dict(self._builders)
        for name, frame in frames.items():
            builders[name] = (lambda f=frame: f)
        return Tables(builders)

    @classmethod
    def from_frames(cls, **frames: DataFrame) -> "Tables":
        return cls({name: (lambda f=frame: f) for name, frame in frames.items()})


def conform(df: DataFrame, name: str) -> DataFrame:
    """Select and cast a frame to the logical schema of table ``name``."""
    schema = schemas.TABLES[name]
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def from_warehouse(spark: SparkSession, root: str, fmt: str = "parquet") -> Tables:
    """Tables stored as ``{root}/{name}`` datasets with the logical schemas.

    The schema is given to the reader, so no inference pass over the files is made;
    ``product_history`` is expected to be partitioned by ``date`` so that the date
    windows of the jobs prune partitions.
    """
    def reader(name):
        return lambda: spark.read.format(fmt).schema(schemas.TABLES[name]).load(f"{root}/{name}")

    return Tables({name: reader(name) for name in schemas.TABLES})


# Tables kept by day: name -> (day, column that deals out a day's rows).
BY_DAY = {"product_history": ("date", "product_id"), "stock_health_snapshots": ("snapshot_date", "PRODUCT_ID")}


def dealt_by_day(df: DataFrame, day: str, key: str, rows_per_file: int) -> DataFrame:
    """``df`` repartitioned by (day, bucket), with as many buckets for a day as its own row
    count asks for: a large day is written by several tasks, a small one as a single file."""
    files = df.groupBy(F.col(day).alias("_day")).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_files"))
    dealt = df.join(files, df[day].eqNullSafe(files["_day"]))
    # rows without a key deal themselves out by their other columns
    spread = F.xxhash64(*[F.col(c) for c in df.columns if c != day])
    bucket = F.pmod(F.when(F.col(key).isNull(), spread).otherwise(F.xxhash64(key)), F.col("_files"))
    return (dealt.withColumn("_bucket", bucket).repartition(F.col(day), F.col("_bucket"))
            .drop("_day", "_files", "_bucket"))


def write_warehouse(tables: Tables, root: str, mode: str = "overwrite", rows_per_file: int = 10_000_000) -> None:
    """Write every logical table to ``{root}/{name}`` (the tables kept by day partitioned by it).

    A day's rows are divided over ceil(rows / ``rows_per_file``) tasks and files, whatever
    its size, instead of one small file per date from every task.
    """
    for name in schemas.TABLES:
        df = getattr(tables, name)
        if name in BY_DAY:
            day, key = BY_DAY[name]
            dealt_by_day(df, day, key, rows_per_file).write.mode(mode).partitionBy(day).parquet(f"{root}/{name}")
        else:
            df.write.mode(mode).parquet(f"{root}/{name}")
