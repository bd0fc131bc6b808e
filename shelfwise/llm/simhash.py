"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most r bits apart share a value within ceil(r / 2) bits of both. So
every distinct fingerprint emits all variants within that half radius, the variants are
shuffled, and fingerprints that meet on a variant are candidates. Fingerprints are made
distinct first (copies are one row, however many), so at most sum(C(64, i)) fingerprints
can meet on one variant: 65 for two bits. No key is ever hot and nothing is capped.

For an even radius all that meet are within r bits of each other, so a chain through the
sorted members links them; for an odd radius members are compared pair by pair within
that fixed bound. Each colliding pair is kept once and checked bit by bit, and connected
components of the links give the class of every fingerprint.

Defined results: null and blank texts have fingerprint zero and link like any other; with
fewer words than a shingle the whole word sequence is the one shingle; repeated rows share
a component; a null doc_id takes part but is never a component's id unless all are null.
Very long texts are read whole, in runs of shingles. Other columns are never read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import stored, table

SEED = 42
RUN = 1 << 16  # shingles hashed at a time


def fingerprint_of(text: str | None, shingle: int) -> int:
    """64-bit SimHash of the word shingles of a text, as an unsigned integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    last = ends[len(words) - n:] if n > 1 or len(words) >= shingle else ends[-1:]
    bits = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, RUN):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in
                           zip(starts[at:min(n, at + RUN)].tolist(), last[at:at + RUN].tolist())], dtype="<u8")
        bits += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
                              ).sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(shingle: int):
    """Column function: fingerprint of a text column (the 64 bits as a signed long)."""

    @F.pandas_udf("long")
    def simhash(text: pd.Series) -> pd.Series:
        values = np.fromiter((fingerprint_of(t, shingle) for t in text), dtype=np.uint64, count=len(text))
        return pd.Series(values.view(np.int64))

    return simhash


def masks(bits: int) -> list[int]:
    """All 64-bit masks with at most ``bits`` ones, as signed longs."""
    out = []
    for k in range(bits + 1):
        for places in combinations(range(64), k):
            mask = sum(1 << p for p in places)
            out.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return out


def colliding_pairs(distinct: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints (column ``fp``) at most
    ``max_bits`` bits apart; for an even ``max_bits``, enough of them to connect all."""
    ball = F.array(*[F.lit(m) for m in masks((max_bits + 1) // 2)])
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # dealt out first, as every fingerprint is about to become a whole ball; round-robin, since
    # Spark leaves out a shuffle by the key that the rows already lie by
    met = (distinct.repartition(tasks).select("fp", F.explode(ball).alias("mask"))
           .select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
           .groupBy("variant").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
           .where(F.size("fps") > 1))
    if max_bits % 2 == 0:
        pairs = F.transform(F.sequence(F.lit(1), F.size("fps") - 1),
                            lambda i: F.struct(F.get("fps", i - 1).alias("a"), F.get("fps", i).alias("b")))
    else:
        pairs = F.flatten(F.transform("fps", lambda x, i: F.transform(
            F.slice("fps", i + 2, F.size("fps")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return (met.select(F.inline(pairs)).distinct()
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links, root being the smallest node that can be
    reached. Large-star and small-star steps in turn until nothing changes; every step
    writes its links to the shared folder, and only a row count and a hash come back."""
    links = stored(links.select("a", "b"), "links")
    before = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = (both.where("b > a").join(low, "a").where("b != low")
                 .select(F.col("low").alias("a"), "b").distinct())
        low2 = large.groupBy("b").agg(F.min("a").alias("low"))
        small = large.join(low2, "b")
        links = stored(small.select(F.col("low").alias("a"), "b")
                       .union(small.where("a != low").select(F.col("low").alias("a"), F.col("a").alias("b")))
                       .distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return links.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("node"), "root")


def classes(marked: DataFrame, first: Column, max_bits: int) -> DataFrame:
    """(fp, winner) for every distinct fingerprint of ``marked``, ``winner`` being the
    smallest value of ``first`` in its component."""
    firsts = marked.groupBy("fp").agg(F.min(first).alias("first"))
    roots = stored(components(colliding_pairs(firsts.select("fp"), max_bits)), "roots")
    member = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
    rooted = (firsts.join(member, firsts.fp == member.node, "left")
              .select("fp", "first", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("winner"))
    return rooted.join(smallest, "root").select("fp", "winner")


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs`` (columns doc_id, text)."""
    marked = stored(docs.select("doc_id", fingerprints(shingle)("text").alias("fp")), "fingerprints")
    return (marked.join(classes(marked, F.col("doc_id"), max_bits), "fp")
            .select("doc_id", "fp", F.col("winner").alias("component_id")))


def one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` (all columns) that stay: of each component the row with the
    smallest doc_id (one of them if repeated; a null id only if all are null)."""
    marked = stored(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                                fingerprints(shingle)("text").alias("fp"))
                    .withColumn("row_id", F.monotonically_increasing_id()), "marked")
    ids = marked.select("fp", F.struct(F.col("row.doc_id").isNull().alias("unnamed"), F.col("row.doc_id").alias("id"),
                                       "row_id").alias("first"))
    losers = (ids.join(classes(ids, F.col("first"), max_bits), "fp").where("first.row_id != winner.row_id")
              .select("first.row_id"))
    return marked.join(losers, "row_id", "left_anti").select("row.*")


def hex_of(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for every row of ``documents``."""
    return (near_duplicates(table(spark, sf_dir, "documents"))
            .select("doc_id", hex_of("fp").alias("fingerprint"), "component_id"))
