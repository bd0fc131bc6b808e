"""Removal of every byte inside a string of LENGTH bytes that also starts elsewhere,
decided with suffix arrays built by linear grouping.

No suffix array can span a cluster, so the text is first brought together where it
matters. Every text is winnowed: of each WINDOW neighbouring 16-byte hashes the smallest
marks an anchor, so two equal strings of LENGTH bytes have their first anchor at the same
offset, less than WINDOW from their start, with equal bytes for LENGTH - WINDOW after it.
The hash of those bytes is the anchor's key.

1. Keys are counted over all texts. A bitmap of fixed size with the repeated ones is
   broadcast; a key that only shares a bit costs some work later and changes nothing.
2. Each anchor with a repeated key names its segment, the bytes from WINDOW - 1 before it
   to LENGTH after its start, by a hash. Segments are counted: one that occurs twice has
   all its strings repeated. A key that also has a segment seen once is open; only for
   open keys are the bytes sent, each distinct segment about once, to meet in a task.
3. There, segments become strings of content-defined chunks. ``suffix_order`` sorts their
   suffixes: groups of equal Lyndon prefix are handled in descending order, each suffix
   points to the previous suffix of a smaller group, which moves to a new, higher group
   with the longer prefix; then suffixes are emitted, each placing those whose Lyndon
   prefix ends where it starts. Nothing is renamed or sorted again recursively. Suffixes
   that share enough chunks lie side by side; strings of LENGTH bytes whose chunks have
   no neighbour are done, the others are compared in full by a 64-bit hash of their bytes.
   A key of more than BATCH_SEGMENTS distinct segments never meets in a task: its strings are
   taken in blocks of neighbouring places, and Spark counts by hash what all strings of a
   block share and the whole stretch of bytes they cover. Only where different stretches
   share the former do they meet as segments of a new key, or in smaller blocks.
4. The repeated starts go back to every text that has the segment, as intervals.

Only hashes, segments of repeated anchors and, once, the texts are shuffled. Equal segments
and equal texts are aggregated before they meet, so copies do not gather in one task.

Defined results: a null text counts as empty; texts shorter than LENGTH keep every byte;
repeated rows of LENGTH bytes or more lose all bytes; other columns are never read. Very
long texts are read whole. Bytes are those of UTF-8, and a cut may leave partial characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import INVERSE, ODD, _powers, stored, table

LENGTH = 400
WINDOW = 128
GRAM = 16
CHUNK_GRAM = 8
MARK_BITS = 27
BATCH_SEGMENTS = 2000
BLOCK = 32  # places of a block at first; a quarter of it each further time
SALT = np.random.default_rng(23).integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)


class Rolling:
    """64-bit hashes of all strings of a length in a byte array."""

    up, down = _powers(ODD, 1 << 16), _powers(INVERSE, 1 << 16)

    def __init__(self, data: np.ndarray):
        if len(data) >= len(Rolling.up):
            Rolling.up, Rolling.down = _powers(ODD, 2 * len(data)), _powers(INVERSE, 2 * len(data))
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(SALT[data] * Rolling.up[:len(data)], out=self.total[1:])

    def between(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self.total[end] - self.total[begin]) * Rolling.down[begin]
        value = (value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return value ^ (value >> np.uint64(29))

    def all_of(self, size: int) -> np.ndarray:
        begin = np.arange(max(0, len(self.total) - size))
        return self.between(begin, begin + size)


def sliding(values: np.ndarray, size: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every ``size`` neighbours."""
    n = len(values) - size + 1
    fill = -(-len(values) // size) * size
    padded = np.concatenate((values, np.full(fill - len(values), values[-1], values.dtype))).reshape(-1, size)
    ahead = best.accumulate(padded, axis=1).ravel()
    behind = best.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[size - 1:size - 1 + n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, keys) of the anchors of a text's bytes."""
    if len(data) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rolling = Rolling(data)
    gram = rolling.all_of(GRAM)
    least = sliding(gram, WINDOW, np.minimum)
    around = np.concatenate((np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)))
    place = np.flatnonzero(sliding(around, WINDOW, np.maximum) == gram)
    place = place[place + LENGTH - WINDOW <= len(data)]
    return place, rolling.between(place, place + LENGTH - WINDOW)


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def suffix_order(symbols: list[int]) -> list[int]:
    """Suffix array of a list of numbers by linear grouping."""
    n = len(symbols)
    if not n:
        return []
    # groups are intervals of ``order``; a group is named by where it begins
    order = sorted(range(n), key=symbols.__getitem__)
    place, group, last = [0] * n, [0] * n, [0] * n
    begin = 0
    for at, s in enumerate(order):
        if at and symbols[s] != symbols[order[at - 1]]:
            begin = at
        group[s] = begin
        place[s] = at
        last[begin] = at
    size_of = [1] * n  # length of the prefix that defines a suffix's group
    previous = [-2] * n  # -2: not known yet
    high = n - 1
    while high >= 0:
        begin = group[order[high]]
        members = sorted(order[begin:high + 1])
        length = size_of[members[0]]
        times: dict[int, int] = {}
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= begin:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        by_times: dict[int, list[int]] = {}
        for p, k in times.items():
            by_times.setdefault(k, []).append(p)
        for k in sorted(by_times, reverse=True):
            moved: dict[int, int] = {}  # old group -> where its remaining members end
            for p in by_times[k]:
                old = group[p]
                end = moved.get(old, last[old])
                other, at = order[end], place[p]
                order[at], order[end] = other, p
                place[other], place[p] = at, end
                moved[old] = end - 1
                size_of[p] += k * length
            for old, end in moved.items():
                top, new = last[old], end + 1
                if new > old:
                    last[old], last[new] = end, top
                    for at in range(new, top + 1):
                        group[order[at]] = new
        high = begin - 1
    # emission: a suffix is next in its group when the suffix after its prefix is emitted
    waiting: dict[int, list[int]] = {}
    for s in range(n):
        waiting.setdefault(s + size_of[s], []).append(s)
    free = list(range(n))  # next place of the group that begins here
    out = [-1] * n
    for at in range(-1, n):
        for s in waiting.get(n if at < 0 else out[at], ()):
            g = group[s]
            out[free[g]] = s
            free[g] += 1
    return out


def repeated_starts(keys: np.ndarray, counts: np.ndarray, before: np.ndarray, segments: list[bytes]
                    ) -> list[np.ndarray]:
    """For each distinct segment, the starts (offsets in it) of its strings of LENGTH bytes
    that hold the anchor and occur at least twice among the segments of the same key."""
    sizes = np.fromiter(map(len, segments), np.int64, len(segments))
    base = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(segments), np.uint8)
    rolling = Rolling(data)
    edge = (rolling.all_of(CHUNK_GRAM) & np.uint64(31)) == 0
    # chunk strings: the content between neighbouring edges, a separator after each segment
    spans = []
    for i, (b, size) in enumerate(zip(base.tolist(), sizes.tolist())):
        cuts = b + np.flatnonzero(edge[b:b + size - CHUNK_GRAM + 1])
        spans.append(cuts)
    cut_all = np.concatenate(spans) if spans else np.zeros(0, np.int64)
    n_cuts = np.fromiter(map(len, spans), np.int64, len(spans))
    owner = np.repeat(np.arange(len(spans)), n_cuts)
    inside = np.flatnonzero(owner[1:] == owner[:-1])  # chunks from one cut to the next
    _, rank = np.unique(rolling.between(cut_all[inside], cut_all[inside + 1]), return_inverse=True)
    # symbol of each cut: its chunk's rank, or (last cut of a segment) a separator of its own, lower than all ranks
    symbol = np.arange(len(cut_all), dtype=np.int64) - len(cut_all)
    symbol[inside] = rank
    order = np.array(suffix_order(symbol.tolist()), dtype=np.int64)
    position = np.empty(len(order), np.int64)
    position[order] = np.arange(len(order))
    # strings of LENGTH bytes around the anchor: first cut inside, chunks inside
    n_starts = np.maximum(0, np.minimum(before, sizes - LENGTH) + 1)
    segment = np.repeat(np.arange(len(segments)), n_starts)
    start = np.arange(n_starts.sum()) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
    at = base[segment] + start
    low = np.searchsorted(cut_all, at)
    high = np.searchsorted(cut_all, at + LENGTH - CHUNK_GRAM, side="right")
    depth = np.maximum(0, high - low - 1)  # whole chunks inside
    # suffixes that share the first d chunks are neighbours in the suffix array
    alone = np.zeros(len(at), bool)
    if len(order):
        same, shared = np.ones(max(0, len(order) - 1), bool), np.zeros(max(0, len(order) - 1), np.int64)
        for d in range(int(depth.max(initial=0))):
            a, b = order[:-1] + d, order[1:] + d
            same &= (a < len(symbol)) & (b < len(symbol))
            same[same] = symbol[a[same]] == symbol[b[same]]
            shared += same
        nearest = np.maximum(np.append(shared, 0), np.append(0, shared))  # best of both neighbours
        some = depth > 0
        alone[some] = nearest[position[low[some]]] < depth[some]
    # a segment that occurs twice repeats whatever its neighbours are
    twice = counts[segment] >= 2
    compare = np.flatnonzero(~alone | twice)
    value = rolling.between(at[compare], at[compare] + LENGTH)
    value ^= (keys[segment[compare]].view(np.uint64) * np.uint64(ODD)
              + (before[segment[compare]] - start[compare]).astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    _, group = np.unique(value, return_inverse=True)
    total = np.bincount(group, counts[segment[compare]]) if len(group) else np.zeros(0)
    hit = compare[total[group] >= 2] if len(group) else compare
    return np.split(start[hit], np.searchsorted(segment[hit], np.arange(1, len(segments))))


def anchor_keys(docs: DataFrame) -> DataFrame:
    """(key, n) of all anchors, summed per task first."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [anchors(np.frombuffer(as_bytes(t), np.uint8))[1] for t in frame["text"]]
            key, n = np.unique(np.concatenate(found), return_counts=True)
            yield pd.DataFrame({"key": key.view(np.int64), "n": n})

    return docs.select("text").mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """2**MARK_BITS bits, set where a key of the column hashes to."""
    bits = (keys.select(F.shiftrightunsigned("key", 64 - MARK_BITS).alias("bit"))
            .groupBy(F.shiftright("bit", 5).cast("int").alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(bit & 31 as int)))").alias("bits"))
            .toArrow())  # at most 2**(MARK_BITS - 5) rows
    out = np.zeros(1 << (MARK_BITS - 5), np.uint32)
    out[bits["word"].to_numpy()] = bits["bits"].to_numpy().astype(np.uint32)
    return out


def marked_anchors(data: np.ndarray, marks: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(key, first byte of the segment, anchor's offset in it, end of the segment) of the
    anchors whose key is in the bitmap."""
    place, key = anchors(data)
    bit = key >> np.uint64(64 - MARK_BITS)
    some = (marks[(bit >> np.uint64(5)).astype(np.int64)] >> (bit & np.uint64(31)).astype(np.uint32)) & 1 == 1
    place, key = place[some], key[some].view(np.int64)
    begin = np.maximum(0, place - WINDOW + 1)
    return zip(key.tolist(), begin.tolist(), (place - begin).tolist(), np.minimum(len(data), place + LENGTH).tolist())


def digest(part: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True)


def slices(frames: Iterator[pd.DataFrame], rows: int = 256) -> Iterator[pd.DataFrame]:
    """The rows a few at a time, so that what a task makes of them stays small."""
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at:at + rows]


def members_of(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """text_id, begin, key, before, hash, size of the segment of every marked anchor."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = shared.value
        for frame in slices(frames):
            rows = []
            for text_id, text in zip(frame["text_id"].tolist(), frame["text"]):
                raw = as_bytes(text)
                for key, begin, before, end in marked_anchors(np.frombuffer(raw, np.uint8), marks):
                    rows.append((text_id, begin, key, before, digest(raw[begin:end]), end - begin))
            yield pd.DataFrame(rows, columns=["text_id", "begin", "key", "before", "hash", "size"])

    return docs.mapInPandas(cut, "text_id binary, begin long, key long, before int, hash long, size int")


def segments_of(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """key, before, hash, n, segment: the distinct segments of marked anchors."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        marks = shared.value
        for frame in slices(frames, 1024):
            found: dict[tuple, list] = {}
            for text in frame["text"]:
                raw = as_bytes(text)
                for key, begin, before, end in marked_anchors(np.frombuffer(raw, np.uint8), marks):
                    part = raw[begin:end]
                    found.setdefault((key, before, digest(part)), [0, part])[0] += 1
            yield pd.DataFrame([(*k, n, part) for k, (n, part) in found.items()],
                               columns=["key", "before", "hash", "n", "segment"])

    return (docs.select("text").mapInPandas(cut, "key long, before int, hash long, n long, segment binary")
            .groupBy("key", "before", "hash").agg(F.sum("n").alias("n"), F.first("segment").alias("segment")))


def starts_of_segments(distinct: DataFrame, tasks: int) -> DataFrame:
    """key, before, hash, lo, hi: runs of repeated starts in those of the distinct segments
    (key, before, hash, n, segment) that occur once. Whole keys are handled together, BATCH_SEGMENTS or
    a little more at a time."""

    def decide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(rows: pd.DataFrame) -> pd.DataFrame:
            found = repeated_starts(rows["key"].to_numpy(np.int64), rows["n"].to_numpy(np.int64),
                                    rows["before"].to_numpy(np.int64), rows["segment"].tolist())
            out = []
            for k, b, h, n, starts in zip(rows["key"], rows["before"], rows["hash"], rows["n"], found):
                if n == 1 and len(starts):
                    out += [(k, b, h, lo, hi) for lo, hi in runs_of(starts)]
            return pd.DataFrame(out, columns=["key", "before", "hash", "lo", "hi"])

        held = None
        for frame in frames:
            held = frame if held is None else pd.concat((held, frame), ignore_index=True)
            while len(held) > BATCH_SEGMENTS:
                key = held["key"].to_numpy()
                cut = int(np.searchsorted(key, key[BATCH_SEGMENTS], side="left"))
                if cut == 0:  # one key: up to its end, if that is here
                    cut = int(np.searchsorted(key, key[0], side="right"))
                    if cut == len(held):
                        break
                yield done(held.iloc[:cut])
                held = held.iloc[cut:]
        if held is not None and len(held):
            yield done(held)

    dealt = distinct.repartition(tasks, "key").sortWithinPartitions("key")
    return dealt.mapInPandas(decide, "key long, before int, hash long, lo int, hi int")


def runs_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) of every run of neighbouring numbers."""
    cut = np.flatnonzero(np.diff(starts) != 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()))


def blocks_of(hot: DataFrame, width: int) -> DataFrame:
    """For each segment and block of ``width`` places that it has strings in: lo and hi, the
    places of those strings, core, a hash of the bytes that all strings of a block share, and
    part, a hash of the bytes from the first to the last byte of the segment's strings."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames, 1024):
            sizes = np.fromiter(map(len, frame["segment"]), np.int64, len(frame))
            before = frame["before"].to_numpy(np.int64)
            low = np.maximum(0, before - sizes + LENGTH)
            first = low // width
            n_blocks = np.maximum(0, before // width - first + 1) * (low <= before)
            row = np.repeat(np.arange(len(frame)), n_blocks)
            block = first[row] + np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
            lo, hi = np.maximum(low[row], block * width), np.minimum(before[row], block * width + width - 1)
            anchor = (np.cumsum(sizes) - sizes + before)[row]
            rolling = Rolling(np.frombuffer(b"".join(frame["segment"]), np.uint8))
            core = rolling.between(anchor - block * width, anchor + LENGTH - (block + 1) * width + 1)
            part = rolling.between(anchor - hi, anchor + LENGTH - lo)
            yield pd.DataFrame({"key": frame["key"].to_numpy()[row], "before": before[row],
                                "hash": frame["hash"].to_numpy()[row], "n": frame["n"].to_numpy()[row],
                                "block": block, "lo": lo, "hi": hi, "core": core.view(np.int64), "part": part.view(np.int64)})

    return hot.mapInPandas(cut, "key long, before int, hash long, n long, block int, lo int, hi int, core long, part long")


def starts_of_hot(hot: DataFrame, tasks: int, width: int = BLOCK) -> DataFrame:
    """key, before, hash, lo, hi like starts_of_segments, without bringing keys together. A part
    that several segments have repeats in all its strings; one that a single segment has, in
    none if no other part shares its core. Parts that share a core are distinct segments of a
    key of their own: up to BATCH_SEGMENTS of them meet, more go on in smaller blocks. A
    segment has at most four blocks each time."""
    name = ["key", "before", "hash"]

    def others(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, b, h, last, single in zip(*(frame[c] for c in (*name, "last", "single"))):
                left = np.ones(last + 1, bool)
                for places in single if single is not None else ():
                    left[b - places["hi"]:b - places["lo"] + 1] = False
                if left.any():
                    out += [(k, b, h, lo, hi) for lo, hi in runs_of(np.flatnonzero(left))]
            yield pd.DataFrame(out, columns=[*name, "lo", "hi"])

    parts = stored(blocks_of(hot, width).groupBy(F.xxhash64("key", "block", "core").alias("sub"), "lo", "hi", "part")
                   .agg(F.sum("n").alias("n"), F.min(F.struct(*name)).alias("owner")), "parts")
    single = (parts.where("n = 1").groupBy("owner.key", "owner.before", "owner.hash")
              .agg(F.collect_list(F.struct("lo", "hi")).alias("single")))  # at most four
    last = F.least("before", F.octet_length("segment") - LENGTH)
    repeated = (hot.where("n = 1").select(*name, last.alias("last")).where("last >= 0").join(single, name, "left")
                .mapInPandas(others, "key long, before int, hash long, lo int, hi int"))
    shared = parts.groupBy("sub").agg(F.count("*").alias("parts")).where("parts > 1")
    inner = (parts.join(shared, "sub").select("*", *[F.col(f"owner.{c}").alias(c) for c in name])
             .join(hot.select(*name, "segment"), name)
             .select(F.col("sub").alias("key"), F.col("hi").alias("before"), F.col("part").alias("hash"), "n", "parts",
                     F.expr(f"substring(segment, before - hi + 1, hi - lo + {LENGTH})").alias("segment")))
    inner = stored(inner, "inner")
    found = starts_of_segments(inner.where(F.col("parts") <= BATCH_SEGMENTS).drop("parts"), tasks)
    more = inner.where(F.col("parts") > BATCH_SEGMENTS).drop("parts")
    if not more.isEmpty():  # never at a width of 1, where a part is its core
        found = found.union(starts_of_hot(more, tasks, max(1, width // 4)))
    found = found.select(F.col("key").alias("sub"), F.col("before").alias("hi"), F.col("hash").alias("part"),
                         F.col("lo").alias("from"), F.col("hi").alias("to"))
    offset = F.col("owner.before") - F.col("hi")
    return repeated.union(found.join(parts.where("n = 1"), ["sub", "hi", "part"])
                          .select("owner.key", "owner.before", "owner.hash", offset + F.col("from"), offset + F.col("to")))


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) for every row."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select("doc_id", "text", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("text_id"))
    name = ["key", "before", "hash"]
    repeated = anchor_keys(docs).where("n >= 2")
    members = stored(members_of(named.select("text_id", "text"), bitmap_of(repeated)), "members")
    kinds = stored(members.groupBy(*name, "size").agg(F.count("*").alias("n")), "kinds")
    opened = kinds.groupBy("key").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).where("least = 1 and kinds > 1")
    segments = stored(segments_of(docs, bitmap_of(opened)), "segments")
    hot = stored(kinds.groupBy("key").count().where(F.col("count") > BATCH_SEGMENTS).select("key"), "hot")
    whole = (kinds.where(f"n >= 2 and size >= {LENGTH}")
             .select(*name, F.lit(0).alias("lo"), F.least("before", F.col("size") - LENGTH).alias("hi")))
    starts = whole.union(starts_of_segments(segments.join(hot, "key", "left_anti"), tasks))
    if not hot.isEmpty():
        starts = starts.union(starts_of_hot(stored(segments.join(hot, "key", "left_semi"), "hot_segments"), tasks))
    spans = (members.join(starts, name)
             .select("text_id", F.struct((F.col("begin") + F.col("lo")).alias("lo"),
                                         (F.col("begin") + F.col("hi") + LENGTH).alias("hi")).alias("span"))
             .groupBy("text_id").agg(F.sort_array(F.collect_set("span")).alias("spans")))

    def remove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in slices(frames):
            rows = []
            for doc_id, text, spans in zip(frame["doc_id"], frame["text"], frame["spans"]):
                raw = as_bytes(text)
                merged: list[list[int]] = []
                for span in spans if spans is not None else ():
                    if merged and span["lo"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], span["hi"])
                    else:
                        merged.append([span["lo"], span["hi"]])
                ends = [0] + [hi for _, hi in merged]
                kept = b"".join(raw[e:lo] for e, lo in zip(ends, [lo for lo, _ in merged] + [len(raw)]))
                rows.append((doc_id, len(raw), len(raw) - len(kept), len(merged), hashlib.sha256(kept).hexdigest(), kept))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    return (named.join(stored(spans, "spans"), "text_id", "left").select("doc_id", "text", "spans")
            .mapInPandas(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"))


def op5_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Removed bytes and digest of what is left for every row of ``documents``."""
    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
