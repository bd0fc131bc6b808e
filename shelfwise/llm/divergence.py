"""How far the sources of a language differ in their words, exactly, by count-level bitmaps.

Each (lang, source) group gives every kept term of its language the smoothed share
p = 1 + floor(10**9 * (count + 5) / (N + 5 V)); two groups differ by the sum of |p - q| over
all kept terms, and a group's own terms are those it holds more of than its language.

1. Tasks count terms and documents per group in dictionaries of bounded size; one shuffle by
   (lang, term) adds them up and drops terms in fewer than MIN_DOCUMENTS documents.
2. The kept terms of a language are dealt to blocks of about BLOCK_TERMS, by the size of
   their total count and a hash, and numbered inside a block. Per block and group the terms
   with one count are one bitset: (count level, bitset) is what is stored.
3. A pair of groups meets block by block. p depends on nothing but the count, so the sum
   needs the number of terms with count c here and d there: AND of two bitsets and popcount.
   Terms that only one group has are what is left of its level, terms that neither has are
   what is left of the block; as f(c, 0), f(0, d) and f(0, 0) are known, these zeros enter as
       sum f = sum_cd cells (f(c,d) - f(c,0) - f(0,d) + f(0,0))
             + sum_c n(c) (f(c,0) - f(0,0)) + sum_d n(d) (f(0,d) - f(0,0)) + V f(0,0),
   so blocks in which a group has no term cost nothing and no zero is ever stored.
4. Groups of a language meet in tiles of about TILE groups, so that a task holds the
   levels of two tiles in one block, however many groups, terms or documents there are. Only
   sums of pairs are shuffled; a hot source is one row in each block like any other.

Every pair of sources of a language is a row of the result, as asked; nothing else grows
with the square of anything. Arithmetic is exact: whole numbers in numpy (p is computed
with Python's), DECIMAL in SQL.

Defined results: null text, lang and source count as empty; a group without kept terms has
N = 0; a language without kept terms has only pairs, of value 0, and a language of one source
has none. Repeated rows count each. Ties are ranked by the bytes of the item. An empty table
gives no rows. Texts are counted whole; other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import stored, table

MIN_DOCUMENTS = 30
TOP_TERMS = 50
SMOOTHING = 5
UNIT = 10**9
BLOCK_TERMS = 1024
TILE = 32
HELD_TERMS = 400_000  # entries a task holds before it sends its counts on
SPACED = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters (lower-cased) and characters beyond ASCII, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(SPACED).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents): partial counts per task."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for (lang, source), (times, found) in held.items():
                if times:
                    yield pd.DataFrame({"lang": lang, "source": source,
                                        "term": [t.decode("utf-8", "surrogatepass") for t in times],
                                        "n": list(times.values()), "d": [found[t] for t in times]})
            held.clear()

        for frame in frames:
            for lang, source, text in zip(frame["lang"], frame["source"], frame["text"]):
                times, found = held.setdefault((lang, source), (Counter(), Counter()))
                terms = terms_of(text)
                times.update(terms)
                found.update(set(terms))
            if sum(len(t) for t, _ in held.values()) > HELD_TERMS:
                yield from flush()
        yield from flush()

    return docs.mapInPandas(count, "lang string, source string, term string, n long, d long")


def kept_terms(docs: DataFrame, min_documents: int) -> DataFrame:
    """lang, source, term, n (occurrences in the group, above 0), total (in the language)."""
    term = Window.partitionBy("lang", "term")  # a row for each source
    return (term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source")
            .agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
            .withColumn("total", F.sum("n").over(term)).withColumn("documents", F.sum("d").over(term))
            .where(F.col("documents") >= min_documents).select("lang", "source", "term", "n", "total"))


def share(count: Column, whole: Column, terms: Column) -> Column:
    """p of a count, exact; callers see to it that ``terms`` is not 0."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + SMOOTHING).cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", top, (whole + SMOOTHING * terms).cast("decimal(20,0)"))


def shares(counts: np.ndarray, whole: int, terms: int) -> np.ndarray:
    below = whole + SMOOTHING * terms
    return np.array([1 + UNIT * (c + SMOOTHING) // below for c in counts.tolist()], dtype=np.int64)


def count_levels(kept: DataFrame, block_terms: int) -> DataFrame:
    """lang, band, block, source, counts, bits: for each group and block the counts that occur
    and, concatenated, the bitset of the terms with each of them."""
    band = F.length(F.bin("total"))
    terms = kept.select("lang", "term", band.alias("band")).distinct()
    sizes = terms.groupBy("lang", "band").agg(F.ceil(F.count("*") / block_terms).alias("blocks"))
    place = ["lang", "band", "block"]
    number = F.dense_rank().over(Window.partitionBy(*place).orderBy("term")) - 1
    dealt = (kept.withColumn("band", band).join(sizes, ["lang", "band"])
             .withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
             .repartition(*place).withColumn("id", number)  # by band alone, Spark would gather its blocks in one task
             .groupBy(*place, "source").agg(F.collect_list("n").alias("n"), F.collect_list("id").alias("id")))

    def bitsets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            counts, bits = [], []
            for n, ids in zip(frame["n"], frame["id"]):
                level, which = np.unique(np.asarray(n, np.int64), return_inverse=True)
                ids = np.asarray(ids, np.int64)
                sets = np.zeros((len(level), int(ids.max()) // 64 + 1), np.uint64)
                np.bitwise_or.at(sets, (which, ids >> 6), np.uint64(1) << (ids & 63).astype(np.uint64))
                counts.append(level)
                bits.append(sets.tobytes())
            yield frame[[*place, "source"]].assign(counts=counts, bits=bits)

    return dealt.mapInPandas(bitsets, "lang string, band int, block long, source string, counts array<long>, bits binary")


def joint_cells(a: np.ndarray, b: np.ndarray, room: int = 1 << 19) -> np.ndarray:
    """Number of terms in each of a's levels and each of b's."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    step = max(1, room // max(1, b.size))
    out = [np.bitwise_count(a[at:at + step, None, :] & b[None, :, :]).sum(axis=2, dtype=np.int64)
           for at in range(0, len(a), step)]
    return np.concatenate(out)


def pair_parts(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| over one block for the pairs of two tiles, less f(0, 0) for each term."""
    terms = int(rows["v"].iloc[0])
    groups = {}
    for source, whole, tile, counts, bits in zip(rows["source"], rows["whole"], rows["tile"], rows["counts"], rows["bits"]):
        counts = np.asarray(counts, np.int64)
        sets = np.frombuffer(bits, np.uint64).reshape(len(counts), -1)
        none, p = shares(np.zeros(1, np.int64), int(whole), terms)[0], shares(counts, int(whole), terms)
        groups[source] = (tile, none, p, np.bitwise_count(sets).sum(axis=1, dtype=np.int64), sets)
    found: dict[tuple[str, str], int] = {}

    def add(one: str, other: str, value: int) -> None:
        key = (one, other) if one < other else (other, one)
        found[key] = found.get(key, 0) + value

    for source, peers in zip(rows["source"], rows["peers"]):
        _, none, p, size, _ = groups[source]
        theirs = np.array([shares(np.zeros(1, np.int64), int(h["whole"]), terms)[0] for h in peers], np.int64)
        alone = size @ (np.abs(p[:, None] - theirs) - np.abs(none - theirs))
        for h, value in zip(peers, alone.tolist()):
            if h["source"] != source:
                add(source, h["source"], value)
    between = rows["low"].iloc[0] != rows["high"].iloc[0]
    names = list(groups)
    for i, one in enumerate(names):
        tile, none, p, _, sets = groups[one]
        for other in names[i + 1:]:
            tile2, none2, q, _, sets2 = groups[other]
            if between and tile == tile2:
                continue  # they meet where their tile meets itself
            f = (np.abs(p[:, None] - q) - np.abs(p - none2)[:, None] - np.abs(none - q)) + abs(none - none2)
            add(one, other, int((joint_cells(sets, sets2) * f).sum()))
    return pd.DataFrame([(rows["lang"].iloc[0], a, b, x) for (a, b), x in found.items()],
                        columns=["lang", "one", "other", "value"])


def divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS,
               block_terms: int = BLOCK_TERMS, tile_groups: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has all other sources of the language
    by their distance, part ``term`` the ``top_terms`` kept terms most above the language's share."""
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    kept = stored(kept_terms(docs, min_documents), "kept")
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_whole"), F.countDistinct("term").alias("v"))
    group_sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    groups = docs.select("lang", "source").distinct()
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile_groups).alias("tiles"))
    groups = stored(groups.join(group_sums, ["lang", "source"], "left").join(langs, "lang", "left").join(tiles, "lang")
                    .fillna(0, ["whole", "lang_whole", "v"])
                    .withColumn("tile", F.pmod(F.xxhash64("source"), F.col("tiles"))), "groups")
    # every group with every tile of its language, and the groups in that tile
    peers = (groups.groupBy("lang", F.col("tile").alias("with"))
             .agg(F.collect_list(F.struct("source", "whole")).alias("peers")))  # about tile_groups
    meet = (groups.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
            .join(peers, ["lang", "with"]))
    levels = stored(count_levels(kept, block_terms), "levels")
    parts = (levels.join(meet.select("lang", "source", "whole", "v", "tile", "with", "peers"), ["lang", "source"])
             .withColumn("low", F.least("tile", "with")).withColumn("high", F.greatest("tile", "with"))
             .groupBy("lang", "band", "block", "low", "high")
             .applyInPandas(pair_parts, "lang string, one string, other string, value long")
             .groupBy("lang", "one", "other").agg(F.sum("value").alias("present")))
    none = F.lit(0).cast("long")
    zeros = F.col("v") * F.abs(share(none, F.col("whole"), F.col("v")) - share(none, F.col("peer.whole"), F.col("v")))
    pairs = (meet.withColumn("peer", F.explode("peers")).where("source != peer.source")
             .select("lang", "source", F.col("peer.source").alias("item"),
                     F.when(F.col("v") > 0, zeros).otherwise(0).alias("zeros"))
             .withColumn("one", F.least("source", "item")).withColumn("other", F.greatest("source", "item"))
             .join(parts, ["lang", "one", "other"], "left")
             .select("lang", "source", F.lit("pair").alias("part"), "item",
                     (F.col("zeros") + F.coalesce("present", F.lit(0))).cast("long").alias("value")))
    above = (kept.join(groups.select("lang", "source", "whole", "lang_whole", "v"), ["lang", "source"])
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                     (share(F.col("n"), F.col("whole"), F.col("v"))
                      - share(F.col("total"), F.col("lang_whole"), F.col("v"))).cast("long").alias("value"))
             .where("value > 0"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = (above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
              .unionByName(pairs.withColumn("rank", F.row_number().over(order))))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language of ``documents`` and their own terms."""
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


_SHARE = f"1 + ({UNIT}::HUGEINT * ({{c}} + {SMOOTHING})) // ({{n}} + {SMOOTHING} * v)"
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
occurrences AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (
  SELECT lang, term, count(*) AS total FROM occurrences GROUP BY lang, term HAVING count(DISTINCT rid) >= {MIN_DOCUMENTS}),
held AS (
  SELECT lang, source, term, count(*) AS c FROM occurrences JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, sum(total) AS ln, count(*) AS v FROM kept GROUP BY lang),
groups AS (
  SELECT g.lang, g.source, coalesce((SELECT sum(c) FROM held h WHERE h.lang = g.lang AND h.source = g.source), 0) AS n
  FROM (SELECT DISTINCT lang, source FROM d) g),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(h.c, 0) AS c,
         {_SHARE.format(c="coalesce(h.c, 0)", n="n")} AS p, {_SHARE.format(c="total", n="ln")} AS lang_p
  FROM groups g JOIN langs USING (lang) JOIN kept k USING (lang)
  LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - lang_p FROM cells WHERE c > 0 AND p > lang_p),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
