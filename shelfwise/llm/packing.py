"""Variable-capacity best-fit packing of documents into training sequences.

Several sequence lengths are permitted. Documents longer than the largest are cut into
pieces of that length; whole texts are packed, nothing is dropped. Pieces go, longest
first, into the open bin they fill best (least room left). If none has room a bin is
opened at the size with the least cost for each token it can still expect. Plans with
different largest sizes are compared on the cost of their final bins, so the sizes are
chosen jointly, and at the end every bin shrinks to the smallest permitted size that
holds its contents.

Only lengths are shuffled. Pieces are dealt evenly over shards of a bounded number of
rows (a repeated document does not gather in one shard), and each shard is packed alone:
the loss is at most a few unfilled bins per shard.

Defined results: a null or blank text has one piece of length 0 and no bin (null bin
columns); repeated rows and null ids are packed like others; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stored, table

CAPACITIES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 64.0  # cost of a sequence, in tokens
ATTENTION = 1.0 / 65536  # cost of a token pair, in tokens


def cost(capacity: int) -> float:
    return OVERHEAD + capacity + ATTENTION * capacity * capacity


def word_count(text: str) -> Column:
    """Number of words (runs of characters other than ASCII white space)."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]++"))


def fill(lengths: list[int], capacities: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """Best fit of lengths given in descending order: the bin of each and what each bin
    holds. Bins are opened at any of ``capacities`` (ascending)."""
    room: list[tuple[int, int]] = []  # (room left, bin), ascending
    where, held, left = [], [], sum(lengths)
    for length in lengths:
        at = bisect_left(room, (length, -1))
        if at < len(room):
            space, chosen = room.pop(at)
        else:
            space = min((c for c in capacities if c >= length), key=lambda c: cost(c) / max(1, min(c, left)))
            chosen = len(held)
            held.append(0)
        where.append(chosen)
        held[chosen] += length
        left -= length
        if space > length:
            insort(room, (space - length, chosen))
    return where, held


def pack(lengths: list[int], capacities: tuple[int, ...]) -> tuple[list[int], list[int], list[int]]:
    """(bin of each length, contents of each bin, final capacity of each bin) of the
    cheapest plan; ``lengths`` in descending order, none above the largest capacity."""
    sizes = np.array(sorted(capacities))
    best: tuple[float, list[int], list[int], list[int]] | None = None
    for top in range(len(sizes)):
        allowed = tuple(int(c) for i, c in enumerate(sizes) if i <= top or lengths and c >= lengths[0])
        where, held = fill(lengths, allowed)
        final = sizes[np.searchsorted(sizes, held)].tolist()
        total = sum(map(cost, final))
        if best is None or total < best[0]:
            best = (total, where, held, final)
    return best[1:]


def pieces(docs: DataFrame, tokens: Column, largest: int) -> DataFrame:
    """doc_id, piece, start_token, n_tokens: each document cut at multiples of ``largest``."""
    last = F.floor((F.greatest("tokens", F.lit(1)) - 1) / largest).cast("int")
    return (docs.select("doc_id", tokens.cast("long").alias("tokens"))
            .select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
            .select("doc_id", "piece", (F.col("piece").cast("long") * largest).alias("start_token"),
                    F.least(F.col("tokens") - F.col("piece").cast("long") * largest, F.lit(largest)).alias("n_tokens")))


def packed(docs: DataFrame, tokens: Column | None = None, capacities: tuple[int, ...] = CAPACITIES,
           shard_rows: int = 20000) -> DataFrame:
    """doc_id, piece, start_token, n_tokens, bin_id, bin_offset, bin_tokens, bin_capacity:
    one row per piece. ``tokens`` gives the length of a row's text (words by default)."""
    cut = stored(pieces(docs, word_count("text") if tokens is None else tokens, max(capacities)), "pieces")
    shards = max(1, -(-cut.where("n_tokens > 0").count() // shard_rows))

    def pack_shard(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        where, held, final = pack(frame["n_tokens"].tolist(), capacities)
        bins = np.asarray(where)
        frame["bin_id"] = (int(key[0]) << 32) + bins
        frame["bin_offset"] = frame.groupby("bin_id")["n_tokens"].cumsum() - frame["n_tokens"]
        frame["bin_tokens"] = np.asarray(held)[bins]
        frame["bin_capacity"] = np.asarray(final)[bins]
        return frame.drop(columns="shard")

    kept = "doc_id long, piece int, start_token long, n_tokens long"
    new = "bin_id long, bin_offset long, bin_tokens long, bin_capacity int"
    dealt = (cut.where("n_tokens > 0").withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)))
             .groupBy("shard").applyInPandas(pack_shard, f"{kept}, {new}"))
    empty = cut.where("n_tokens = 0").select("*", *[F.lit(None).cast(c.split()[1]).alias(c.split()[0])
                                                   for c in new.split(", ")])
    return dealt.union(empty)


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every row of ``documents`` with its bin."""
    return packed(table(spark, sf_dir, "documents"))
