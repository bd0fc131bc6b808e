"""Helpers shared by the operators: shared storage, held-out folds, samples, and
vectorised hashing of character n-grams and words over blocks of texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwise.conf import ensure_checkpoint_dir

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ARROW_BYTES = 4 << 20  # of a batch: what a Python task and its executor hold of the texts at once
_folders: list[str] = []  # written by this process
MIX32 = np.uint32(0x9E3779B1)
ROLL32 = np.uint32(0x01000193)


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Arrow batches of at most ARROW_BYTES (or one row): rows alone, Spark's default up to
    64 MB, would let long texts fill an executor's memory outside the heap."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the cluster's shared folder and read back: later steps
    neither recompute it nor depend on the executors that made it."""
    spark = bounded_batches(df.sparkSession)
    path = f"{shared_folder(spark)}/{tag}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the cluster's shared one, known to ``drop_stored``."""
    _folders.append(f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}")
    return _folders[-1]


def drop_stored(spark: SparkSession) -> int:
    """Delete what the operators called in this process have stored so far, and say how many
    folders that were. For callers who have written the results they want: DataFrames that
    still read those folders fail afterwards."""
    hadoop, n = spark.sparkContext._jsc.hadoopConfiguration(), len(_folders)
    while _folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folders.pop())
        path.getFileSystem(hadoop).delete(path, True)
    return n


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def first_per_class(df: DataFrame, label: str, per_class: int, key: Column) -> DataFrame:
    """The ``per_class`` rows of each label with the smallest hash of ``key``. Below Spark's
    limit of 1,000 every task keeps that many rows before the shuffle; for a larger bound one
    task ranks all rows of a label, so this is then for rows whose number is bounded already."""
    order = Window.partitionBy(label).orderBy("_order", "_key")
    return (df.withColumn("_key", key.cast("string")).withColumn("_order", _place("_key"))
            .withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_class)
            .drop("_key", "_order", "_rank"))


def _place(key: str) -> Column:
    """Hash of a column as a number from 0 to 1."""
    return F.shiftrightunsigned(F.xxhash64(key), 11) / F.lit(float(1 << 53))


def sample_per_class(df: DataFrame, label: str, per_class: int, key: Column, slots: int = 256) -> DataFrame:
    """``first_per_class`` for any number of rows and any bound, each row with a key of its own,
    without bringing a class together. The labels are counted; the rows whose hash lies below
    twice the share that is wanted (about 2 * per_class + 64 of a label) are counted by slots
    of their hash; whole slots are kept as long as they fit, and only the rows of the slot at
    the border are ranked. That fewer than ``per_class`` rows lie below the hash is ruled out
    for practical purposes (below 1e-12), and then only shrinks the sample."""
    room = 2 * per_class + 64
    counts = df.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    likely = (df.withColumn("_key", key.cast("string")).withColumn("_order", _place("_key"))
              .join(counts, F.col(label).eqNullSafe(F.col("_label"))).where(F.col("_order") * F.col("_n") < room)
              .withColumn("_slot", F.floor(F.col("_order") * F.col("_n") * slots / room)))
    in_slot = likely.groupBy("_label", "_slot").agg(F.count("*").alias("_in"))
    upto = Window.partitionBy("_label").orderBy("_slot")  # over at most ``slots`` rows
    in_slot = (in_slot.withColumn("_left", F.lit(per_class) - F.sum("_in").over(upto) + F.col("_in"))
               .select(F.col("_label").alias("_of"), F.col("_slot").alias("_at"), "_in", "_left").where("_left > 0"))
    rows = likely.join(in_slot, F.col("_label").eqNullSafe(F.col("_of")) & (F.col("_slot") == F.col("_at")))
    border = Window.partitionBy("_label").orderBy("_order", "_key")
    ranked = (rows.where("_in > _left").withColumn("_rank", F.row_number().over(border))
              .where("_rank <= _left").drop("_rank"))
    return rows.where("_in <= _left").unionByName(ranked).select(*df.columns)


class CharBlock:
    """Code points of several texts (or parts of very long ones), each text between two
    spaces. Part p covers ``points[start[p]:end[p]]``; n-grams that begin in the first
    ``own[p]`` positions are its own, the rest only completes them."""

    def __init__(self, parts: list[tuple[int, str, int]]):
        self.doc = np.array([p[0] for p in parts], dtype=np.int64)
        sizes = np.array([len(p[1]) for p in parts], dtype=np.int64)
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.own = np.array([p[2] for p in parts], dtype=np.int64)
        joined = "".join(p[1] for p in parts)
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)

    def foreign(self, valid: np.ndarray, n: int) -> None:
        """Unset positions whose n-gram leaves its part or belongs to the next part."""
        for s, own, e in zip(self.start.tolist(), self.own.tolist(), self.end.tolist()):
            valid[min(s + own, max(s, e - n + 1)):e] = False

    def ngrams(self, sizes: tuple[int, ...], bits: int, inside_words: bool
               ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(n, bucket per position, valid flag per position) for each n. With
        ``inside_words`` only the first and the last character may be white space."""
        points, length = self.points, len(self.points)
        rolled = points.copy()
        space = points <= 32
        inner = np.zeros(length, dtype=bool)
        for n in range(1, max(sizes) + 1):
            if n > 1:
                rolled = rolled[:-1] * ROLL32 + points[n - 1:]
            if n > 2:
                inner = inner[:max(0, length - n + 1)] | space[n - 2:length - 1]
            if n not in sizes:
                continue
            bucket = np.zeros(length, dtype=np.uint32)
            mixed = (rolled + np.uint32(n)) * MIX32
            mixed ^= mixed >> np.uint32(15)
            bucket[:len(rolled)] = (mixed * ROLL32 * MIX32) >> np.uint32(32 - bits)
            valid = np.ones(length, dtype=bool)
            if inside_words and n > 2:
                valid[:len(inner)] = ~inner
            self.foreign(valid, n)
            yield n, bucket, valid

    def sums(self, values: np.ndarray, out: np.ndarray) -> None:
        """Add each part's sum of ``values`` to ``out[document]``."""
        np.add.at(out, self.doc, np.add.reduceat(values, self.start, dtype=np.float64))


def char_blocks(texts: list[str | None], nmax: int, size: int = 1 << 18) -> Iterator[CharBlock]:
    """The texts in blocks of about ``size`` characters; longer texts come in parts."""
    parts, held = [], 0
    for doc, text in enumerate(texts):
        padded = f" {text or ''} "
        for at in range(0, len(padded), size):
            part = padded[at:at + size + nmax - 1]
            parts.append((doc, part, min(size, len(padded) - at)))
            held += len(part)
            if held >= size:
                yield CharBlock(parts)
                parts, held = [], 0
    if parts:
        yield CharBlock(parts)


SPACE_BYTE = np.zeros(256, dtype=bool)
SPACE_BYTE[[9, 10, 11, 12, 13, 32]] = True
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, dtype=np.uint64)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


class WordHasher:
    """64-bit hashes of the words (runs of bytes other than ASCII white space) of a byte
    array, from prefix sums of byte * odd**position modulo 2**64."""

    def __init__(self, capacity: int = 1 << 18):
        self.grow(capacity)

    def grow(self, capacity: int) -> None:
        self.up, self.down = _powers(ODD, capacity + 1), _powers(INVERSE, capacity + 1)

    def __call__(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of each word."""
        if len(data) > len(self.up) - 1:
            self.grow(len(data))
        space = SPACE_BYTE[data]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        start, end = edge[0::2], edge[1::2]
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:len(data)], out=total[1:])
        value = (total[end] - total[start]) * self.down[start]
        value ^= value >> np.uint64(31)
        value *= np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(29)
        return value, start, end


def word_blocks(texts: list[str | None], size: int = 1 << 18) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, UTF-8 bytes of the texts with A-Z lower-cased), about
    ``size`` bytes at a time; a text is never split."""
    first, held, part = 0, 0, []
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        part.append(data)
        held += len(data) + 1
        if held >= size:
            yield first, part
            first, held, part = i + 1, 0, []
    if part:
        yield first, part
