"""Removal of every word covered by a window of WINDOW words that also starts earlier, found
by level-wise doubling.

A window of 2 L words can only repeat if both its halves repeat, so windows are looked up by
level: all windows of FIRST words, then windows of twice that length whose halves were both
found more than once, and so on up to WINDOW words, or until no candidates survive.

1. Texts are dealt to blocks of about BLOCK_BYTES, stored bucketed by block: every later step
   reads a block where it lies, and no text is ever shuffled.
2. At each level a block hashes its candidates and asks, once for each distinct one: which of
   these does another block hold too? A question is a sorted array for one bucket of the hash
   space; a level below the last sends 4 bytes of the hash, in which (with the bucket, whose
   number grows with the data) two different windows rarely agree, and that only leaves a
   false candidate. A bucket compares what it got and answers with one bit for each value.
   What repeats inside a block needs no question.
3. The answers are all that is kept between levels: a block works out its survivors again from
   its texts and the bits so far. Hashes have 128 bits, joined level by level.
4. At the last level the question holds 96 bits of the window and the place of its first start in
   the block, and the bit says whether another block has an earlier one. Every start but the
   first of all is removed with its WINDOW words.

However often a window occurs, a block asks for it once, so a passage or copy that fills a
third of the rows is one value for each block. A bucket gets about BUCKET_BYTES of text's
worth of values. Nothing is counted on the driver but the number of survivors of a level.

Defined results: a null text has no words. Rows are ordered by doc_id (null first), rows of
one doc_id by a digest of their text; of equal rows one, whichever is read first, counts as
the earlier. Documents of fewer words than WINDOW keep every word. A text is read whole by one
task, which holds about 20 times its size. An empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import SPACE_BYTE, shared_folder, stored, table

WINDOW = 20
FIRST = 5
BLOCK_BYTES = 2 << 20  # of text; one longer text is a block of its own
BUCKET_BYTES = 16 << 20  # of text, whose windows meet in one bucket of the hash space
SHORT = 64  # bytes of a word
ASKED = np.dtype([("high", "<u8"), ("low", "<u4"), ("doc", "<i8"), ("tie", "<u4")])
STEPS = np.random.default_rng(12).integers(1, 1 << 63, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)
BYTES = np.random.default_rng(13).integers(0, 1 << 64, (2, 256), dtype=np.uint64)


def lengths(window: int, first: int) -> list[int]:
    out = [min(first, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def mixed(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(29))


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of the words of a byte array that ends in white space."""
    edge = np.flatnonzero(np.diff(SPACE_BYTE[data].view(np.int8), prepend=1))
    return edge[0::2], edge[1::2]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each word: a polynomial in random values of its bytes, byte by byte
    for all words at once. Words of over SHORT bytes, for which such polynomials modulo 2**64
    can be made to collide, are hashed by XXH3."""
    size = end - start
    order = np.argsort(np.minimum(size, SHORT + 1).astype(np.uint8), kind="stable")[::-1]
    order = order[np.searchsorted(-size[order], -SHORT):] if len(order) and size.max() > SHORT else order
    at, n = start[order], np.bincount(size[order], minlength=SHORT + 1)
    longer = len(order) - np.cumsum(n)  # words of more than j bytes
    value = np.zeros((2, len(order)), np.uint64)
    for j in range(SHORT):
        k = longer[j]
        if not k:
            break
        byte = data[at[:k] + j]
        for lane in (0, 1):
            value[lane, :k] = value[lane, :k] * STEPS[lane] + BYTES[lane][byte]
    out = np.zeros((2, len(start)), np.uint64)
    out[:, order] = mixed(value)
    for i in np.flatnonzero(size > SHORT).tolist():
        out[:, i] = np.frombuffer(xxhash.xxh3_128_digest(data[start[i]:end[i]].tobytes()), np.uint64)
    return out


class Block:
    """The words of some documents in a row, one place free after each document."""

    def __init__(self, rows: pd.DataFrame, window: int, first: int, buckets: int):
        rows = rows.sort_values("at")
        self.doc_id, self.at = rows["doc_id"].tolist(), rows["at"].to_numpy(np.int64)
        raw = self.raw = [(t or "").encode("utf-8", "surrogatepass") for t in rows["text"]]
        data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        begin, end = words_of(data)
        text_end = np.cumsum([len(r) + 1 for r in raw])
        self.n_words = np.bincount(np.searchsorted(text_end, begin, side="right"), minlength=len(raw))
        self.start = np.cumsum(self.n_words + 1) - self.n_words - 1
        size = len(begin) + len(raw)
        place = np.arange(len(begin)) + np.repeat(np.arange(len(raw)), self.n_words)
        self.hashes = np.zeros((2, size), np.uint64)
        self.hashes[:, place] = word_hashes(data, begin, end)
        self.left = np.zeros(size, np.int64)  # words from here to the end of the document
        self.left[place] = np.repeat(self.start + self.n_words, self.n_words) - place
        self.order = np.array([-(1 << 63) if d is None or d != d else int(d) for d in self.doc_id], np.int64)
        self.tie = np.fromiter((int.from_bytes(hashlib.blake2b(r, digest_size=4).digest(), "little") for r in raw),
                               np.int64, len(raw))
        self.levels, self.buckets = lengths(window, first), buckets

    def windows(self, level: int) -> np.ndarray:
        """Both hashes of the windows of a level at every place (of any value where none fits)."""
        size = self.levels[0]
        value = np.zeros_like(self.hashes)
        for k in range(size):
            value[:, :value.shape[1] - k] += self.hashes[:, k:] * STEPS[k]
        value = mixed(value)
        for up in self.levels[1:level + 1]:
            joined = value * STEPS[-1]
            joined[:, :joined.shape[1] - (up - size)] += value[:, up - size:] * STEPS[-2]
            value, size = mixed(joined), up
        return value

    def bucket(self, value: np.ndarray) -> np.ndarray:
        return (value >> np.uint64(32)) % np.uint64(self.buckets)

    def candidates(self, level: int, repeated: np.ndarray | None) -> np.ndarray:
        """Starts whose halves are among the starts ``repeated`` on the level below."""
        fits = self.left >= self.levels[level]
        if level:
            here, ahead = np.zeros(len(fits), bool), self.levels[level] - self.levels[level - 1]
            here[repeated] = True
            fits[:len(fits) - ahead] &= here[:len(fits) - ahead] & here[ahead:]
        return np.flatnonzero(fits)

    def distinct(self, level: int, at: np.ndarray):
        """(bucket of each value, values to ask about, index of each start's value, number of
        the starts with a value), values by bucket."""
        value = self.windows(level)[:, at]
        bucket = self.bucket(value[0])
        if level < len(self.levels) - 1:
            key, which, n = np.unique((bucket << np.uint64(32)) | (value[0] & np.uint64(0xFFFFFFFF)),
                                      return_inverse=True, return_counts=True)
            return (key >> np.uint64(32)).astype(np.int64), key.astype("<u4"), which, n
        doc = np.searchsorted(self.start, at, side="right") - 1
        rank = np.empty(len(self.start), np.int64)
        rank[np.lexsort((self.at, self.tie, self.order))] = np.arange(len(rank))
        low = value[1] & np.uint64(0xFFFFFFFF)
        order = np.lexsort((at, rank[doc], low, value[0], bucket))
        high, low = value[0][order], low[order]
        new = np.ones(len(order), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        least = order[new]  # the earliest start of each value
        asked = np.empty(len(least), ASKED)
        asked["high"], asked["low"], asked["doc"], asked["tie"] = (
            high[new], low[new], self.order[doc[least]], self.tie[doc[least]])
        self.least = least
        return bucket[least].astype(np.int64), asked, which, np.bincount(which, minlength=len(least))

    def survivors(self, bits: dict[tuple[int, int], bytes], level: int) -> np.ndarray:
        """Starts of the windows of a level that occur elsewhere too; on the last level those
        that are not the first of all."""
        at = self.candidates(level, self.survivors(bits, level - 1) if level else None)
        if not len(at):
            return at
        bucket, asked, which, n = self.distinct(level, at)
        told = np.zeros(len(asked), bool)
        for b, lo, hi in pieces(bucket):
            told[lo:hi] = np.unpackbits(np.frombuffer(bits[level, b], np.uint8), count=hi - lo)
        if level < len(self.levels) - 1:
            return at[told[which] | (n[which] > 1)]
        hit = np.ones(len(at), bool)
        hit[self.least] = told
        return at[hit]

    def questions(self, bits: dict[tuple[int, int], bytes], level: int) -> list[tuple]:
        """(bucket, values, number of values that repeat inside the block)"""
        at = self.candidates(level, self.survivors(bits, level - 1) if level else None)
        if not len(at):
            return []
        bucket, asked, _, n = self.distinct(level, at)
        return [(b, asked[lo:hi].tobytes(), int((n[lo:hi] > 1).sum())) for b, lo, hi in pieces(bucket)]

    def kept(self, bits: dict[tuple[int, int], bytes] | None) -> list[tuple]:
        """(doc_id, n_words, n_removed, kept words) of each row; no ``bits``: nothing repeats."""
        size = self.hashes.shape[1]
        edge = np.zeros(size + 1, np.int64)
        if bits is not None:
            at = self.survivors(bits, len(self.levels) - 1)
            edge[at] += 1
            edge[at + self.levels[-1]] -= 1
        gone = np.cumsum(edge) > 0
        out = []
        for doc_id, raw, start, n in zip(self.doc_id, self.raw, self.start.tolist(), self.n_words.tolist()):
            dead, words = gone[start:start + n], raw.split()  # by ASCII white space, as bytes do
            n_removed = int(dead.sum())
            if n_removed:
                words = [words[i] for i in np.flatnonzero(~dead).tolist()]
            out.append((doc_id, n, n_removed, b" ".join(words)))
        return out


def pieces(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, begin, end) of the runs of a sorted array."""
    cut = np.flatnonzero(np.diff(bucket)) + 1
    ends = np.append(cut, len(bucket))
    for lo, hi in zip(np.append(0, cut).tolist(), ends.tolist()):
        yield int(bucket[lo]), lo, hi


def in_two(values: np.ndarray) -> np.ndarray:
    """The values that stand in it more than once."""
    values = np.sort(values)
    return np.unique(values[1:][values[1:] == values[:-1]])


def answer(rows: pd.DataFrame, last: bool) -> pd.DataFrame:
    """One bit for each value of each question: held by another block too; on the last level:
    another block has an earlier start."""
    parts = [np.frombuffer(v, ASKED if last else "<u4") for v in rows["asked"]]
    values = np.concatenate(parts)
    ends = np.cumsum([len(p) for p in parts])
    if last:
        some = np.flatnonzero(np.isin(values["high"], in_two(values["high"])))
        v, block = values[some], rows["block"].to_numpy(np.int64)[np.searchsorted(ends, some, side="right")]
        order = np.lexsort((block, v["tie"], v["doc"], v["low"], v["high"]))
        v = v[order]
        told = np.zeros(len(values), bool)
        told[some[order[1:]]] = (v["high"][1:] == v["high"][:-1]) & (v["low"][1:] == v["low"][:-1])
    else:
        told = np.isin(values, in_two(values))
    bits = [np.packbits(told[e - len(p):e]).tobytes() for p, e in zip(parts, ends.tolist())]
    live = [int(told[e - len(p):e].sum()) + n for p, e, n in zip(parts, ends.tolist(), rows["inside"])]
    return pd.DataFrame({"block": rows["block"], "bucket": rows["bucket"], "bits": bits, "live": live})


def in_blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """The rows with ``block`` and their number in it."""

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held, at = TaskContext.get().partitionId() << 32, 0, 0
        for frame in frames:
            blocks, places = [], []
            for text in frame["text"]:
                if held >= block_bytes:
                    block, held, at = block + 1, 0, 0
                blocks.append(block)
                places.append(at)
                held, at = held + len(text or ""), at + 1
            yield frame.assign(block=blocks, at=places, doc_id=frame["doc_id"].astype("Int64"))

    return docs.select("doc_id", "text").mapInPandas(deal, "doc_id long, text string, block long, at int")


def bucketed(df: DataFrame, key: str, buckets: int, tag: str) -> DataFrame:
    """``df`` written to the shared folder, bucketed by ``key``, so that groups of a key need no shuffle."""
    name = f"llm_{uuid.uuid4().hex}_{tag}"
    path = f"{shared_folder(df.sparkSession)}/{tag}"
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def without_repeated_windows(docs: DataFrame, window: int = WINDOW, first: int = FIRST, block_bytes: int = BLOCK_BYTES,
                             bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (words joined by a space) for every row."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + total // bucket_bytes
    files = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))  # else Spark deals the texts out anew
    blocks = bucketed(in_blocks(docs, block_bytes), "block", files, "blocks").groupBy("block")
    last = len(lengths(window, first)) - 1
    told = None  # block, level, bucket, bits

    def read(rows: pd.DataFrame, bits: pd.DataFrame | None) -> tuple[Block, dict]:
        found = {} if bits is None else {(level, b): v for level, b, v in zip(bits["level"], bits["bucket"], bits["bits"])}
        return Block(rows, window, first, buckets), found

    def each_block(work, schema: str) -> DataFrame:
        """``work(rows, bits)`` for every block, with the answers it has got so far."""
        if told is None:
            return blocks.applyInPandas(lambda rows: work(rows, None), schema)
        return blocks.cogroup(told.groupBy("block")).applyInPandas(work, schema)

    def asking(level: int):
        def ask(rows: pd.DataFrame, bits: pd.DataFrame | None) -> pd.DataFrame:
            out = []
            if len(rows):
                block, found = read(rows, bits)
                out = [(rows["block"].iloc[0], *q) for q in block.questions(found, level)]
            return pd.DataFrame(out, columns=["block", "bucket", "asked", "inside"])

        return ask

    def answering(level: int):
        return lambda rows: answer(rows, level == last)

    for level in range(last + 1):
        asked = each_block(asking(level), "block long, bucket long, asked binary, inside long")
        got = asked.groupBy("bucket").applyInPandas(answering(level), "block long, bucket long, bits binary, live long")
        got = stored(got.withColumn("level", F.lit(level)), f"bits-{level}")
        told = got.drop("live") if told is None else told.unionByName(got.drop("live"))
        if not got.agg(F.sum("live")).first()[0]:
            told = None  # no candidates survive
            break
    found_any = told is not None

    def remove(rows: pd.DataFrame, bits: pd.DataFrame | None) -> pd.DataFrame:
        out = []
        if len(rows):
            block, found = read(rows, bits)
            out = [(d, n, gone, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass"))
                   for d, n, gone, kept in block.kept(found if found_any else None)]
        out = pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    return each_block(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Removed words and digest of what is left for every row of ``documents``."""
    return without_repeated_windows(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")


# doc_id is a key of the given table; rows that share one would need the digest above
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
words AS (SELECT rid, doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
runs AS (
  SELECT rid, doc_id, pos, string_agg(word, ' ') OVER ahead AS k, count(*) OVER ahead AS n
  FROM words WINDOW ahead AS (PARTITION BY rid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
later AS (
  SELECT rid, pos FROM runs WHERE n = {WINDOW}
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, rid, pos) > 1),
gone AS (SELECT DISTINCT rid, unnest(range(pos, pos + {WINDOW})) AS pos FROM later),
kept AS (
  SELECT rid, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
  FROM words ANTI JOIN gone USING (rid, pos) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (rid)
"""
