"""Quality by importance resampling (target against raw text) and Gumbel top-k.

Two generative models count hashed character n-grams: the target model over a bounded
sample of documents labelled as good, the raw model over all documents. A document's log
weight is the sum of log(target / raw) over its n-grams. Adding Gumbel noise, drawn from a
hash of the row, and keeping the k largest keys samples k documents without replacement in
proportion to the weights. The k-th largest key is found exactly, on Spark, 16 bits of the
ordered key at a time, so nothing is sorted in one task.

Defined results: a null or empty text has the n-grams of its padding only; without
labelled rows the weight is 0.0 for all; equal keys (repeated rows) at the threshold are
all selected; texts are read whole, long ones in parts; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import char_blocks, sample_per_class, stored, table

SIZES = (1, 2, 3)
BITS = 16


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Occurrences of each n-gram bucket in column text of all rows: every task sums its
    rows first, so at most 2**BITS rows per task are shuffled and come back."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << BITS, np.int64)
        for frame in frames:
            for block in char_blocks(frame["text"].tolist(), max(SIZES)):
                for _, bucket, valid in block.ngrams(SIZES, BITS, inside_words=False):
                    total += np.bincount(bucket[valid], minlength=1 << BITS)
        some = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": some, "n": total[some]})

    counts = texts.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out, rows = np.zeros(1 << BITS), counts.toArrow().to_pandas()
    out[rows["bucket"].to_numpy(int)] = rows["n"]
    return out


def log_ratios(docs: DataFrame, labels: DataFrame, target_rows: int = 10000, smooth: float = 1.0) -> np.ndarray:
    """log(target / raw) per bucket; the target model reads at most ``target_rows``
    documents labelled quality 1 (the documented bound), the raw model all documents."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id", "quality").distinct()
    chosen = sample_per_class(good, "quality", target_rows, F.col("doc_id"))
    # at most target_rows pairs of numbers are sent to every task
    target = bucket_counts(docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id"))
    raw = bucket_counts(docs)
    if not target.sum():
        return np.zeros(1 << BITS, np.float32)
    share = [(c + smooth * raw / max(1.0, raw.sum()) * 1000) / (c.sum() + 1000 * smooth) for c in (target, raw)]
    return np.log(np.maximum(share[0], 1e-12) / np.maximum(share[1], 1e-12)).astype(np.float32)


def weigher(docs: DataFrame, ratios: np.ndarray) -> Callable[[str], Column]:
    """Column function: struct of the log weight of a text and its number of n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # 2**BITS numbers

    @F.pandas_udf("log_weight double, n_grams long")
    def weigh(text: pd.Series) -> pd.DataFrame:
        total, n = np.zeros(len(text)), np.zeros(len(text))
        for block in char_blocks(text.tolist(), max(SIZES)):
            for _, bucket, valid in block.ngrams(SIZES, BITS, inside_words=False):
                block.sums(shared.value[bucket] * valid, total)
                block.sums(valid, n)
        return pd.DataFrame({"log_weight": total, "n_grams": n.astype(np.int64)})

    return weigh


def kth_largest(keys: DataFrame, k: int) -> int | None:
    """The k-th largest value of the long column ``ordered``, by counting 16 bits at a
    time from the top; None if there are fewer rows."""
    prefix = F.lit(True)
    low = -(1 << 63)
    for shift in (48, 32, 16, 0):
        digit = F.shiftright(F.col("ordered"), shift)
        counts = sorted(((r["digit"], r["count"]) for r in  # at most 65,536 rows
                         keys.where(prefix).groupBy(digit.alias("digit")).count().collect()), reverse=True)
        for value, n in counts:
            if k <= n:
                low, prefix = value << shift, digit == value
                break
            k -= n
        else:
            return None
    return low


def resampled(docs: DataFrame, labels: DataFrame, keep_share: float = 0.8, seed: int = 17, **options) -> DataFrame:
    """doc_id, n_grams, log_weight, mean_log_ratio, gumbel_key, selected for every row;
    ``keep_share`` of the rows (rounded up) are selected."""
    weigh = weigher(docs, log_ratios(docs, labels, **options))
    unit = ((F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 11).cast("double") + 0.5)
            / F.lit(float(1 << 53)))
    scored = stored(docs.select("doc_id", weigh("text").alias("w"), (-F.log(-F.log(unit))).alias("gumbel"))
                    .select("doc_id", "w.n_grams", "w.log_weight",
                            (F.col("w.log_weight") / F.greatest("w.n_grams", F.lit(1))).alias("mean_log_ratio"),
                            (F.col("w.log_weight") + F.col("gumbel")).alias("gumbel_key"))
                    # keys in fixed steps of 1e-9, so that their order is that of whole numbers
                    .withColumn("ordered", F.round(F.col("gumbel_key") * 1e9).cast("long")), "scored")
    threshold = kth_largest(scored, int(np.ceil(keep_share * scored.count())))
    if threshold is None:
        threshold = -(1 << 63)
    return scored.withColumn("selected", F.col("ordered") >= F.lit(threshold)).drop("ordered")


def op8_quality_resampling(spark, sf_dir: str) -> DataFrame:
    """Weights, keys and selection of every row of ``documents``."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
