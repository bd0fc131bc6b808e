"""Benchmark decontamination by latent semantic retrieval.

1. Term statistics: words are hashed to FEATURES terms; the document frequency of each
   term is counted over all STEP-word steps of all documents.
2. Latent space: a randomised SVD (random range, power iterations, small exact SVD) of the
   TF-IDF matrix of the benchmark's passages. The products with the matrix run on its
   partitions; only sums of fixed size meet on the driver.
3. Candidates: every WINDOW-word window of every document (half overlapping, whole texts)
   is projected into that space; windows whose cosine with a benchmark passage reaches
   ``min_cosine`` go on. An item shorter than a window fills only a part of it, so its
   least cosine falls with the root of its length. Of the windows that go on, those with
   too few of the item's content words around them for any check to accept are left out by
   counts. The benchmark comes in blocks of bounded size, so it is a stated query set
   against all rows, never a join of all pairs.
4. Checks: longest common subsequence of words between the benchmark item and the words
   around the window (bit-parallel, so one step per word). Nearly the whole item in order
   is a leak. A paraphrase, with less of it in order, is a leak if enough of the item's
   content words (terms in under RARE of the steps) and of the content words of its answer
   (the last sentence) are there in order. Copies of a leaked item make its own words
   frequent, so an item with fewer content words than others is also checked with the rarer
   half of its words, and of its answer's words, as content words.

Defined results: null, blank and short texts have no windows or one short one; an empty
benchmark finds nothing; null or blank items are never found; repeated items are found
each under its own item_id; repeated documents are all reported. Other columns are kept
apart and never read. Very long documents are read whole, one block of steps at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import WordHasher, stored, table, word_blocks

BITS = 13
FEATURES = 1 << BITS
STEP = 24
WINDOW = 2 * STEP
RARE = 0.01
SLACK = 0.8  # for words of an item that weigh less than others
LEAK_TYPE = "array<struct<item:int,cosine:double,lcs_ratio:double,content_ratio:double,answer_ratio:double>>"


@dataclass
class Item:
    """Word hashes of one benchmark item, in how many steps the term of each is, from which
    number of steps on a term is common, and where the last sentence begins."""

    words: list[int]
    steps: list[int]
    common_from: float
    answer_from: int

    def __post_init__(self) -> None:
        self.rare = [w for w, n in zip(self.words, self.steps) if n < self.common_from]
        self.answer = [w for w, n in zip(self.words[self.answer_from:], self.steps[self.answer_from:])
                       if n < self.common_from]
        self.rarer = self.rarer_answer = None
        if 2 * len(self.rare) < len(self.words):
            self.rarer = rarer_half(self.words, self.steps)
            self.rarer_answer = rarer_half(self.words[self.answer_from:], self.steps[self.answer_from:])
        # the checks accept no text with fewer than ``part`` * ``least`` of the needed words
        self.needed = self.rarer if self.rarer and self.rare else self.rare or self.words
        self.least = min(len(self.rare) or len(self.rarer), len(self.rarer)) if self.rarer else len(self.rare)


def rarer_half(words: list[int], steps: list[int]) -> list[int]:
    """The words, in order, whose terms are in no more steps than that of the middle one."""
    middle = sorted(steps)[(len(steps) - 1) // 2] if steps else 0
    return [w for w, n in zip(words, steps) if n <= middle]


def ratios(content: list[int], answer: list[int], words: list[int]) -> tuple[float, float]:
    """Shares of the content words, and of those of the answer, that ``words`` has in order."""
    whole = common_length(content, words) / len(content) if content else 0.0
    return whole, common_length(answer, words) / len(answer) if answer else whole


def terms(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BITS)).astype(np.int64)


class Steps:
    """Words of a block of texts and their steps of STEP words, none crossing texts."""

    def __init__(self, hasher: WordHasher, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        self.hashes, start, _ = hasher(data)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.first = np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))))
        n_words = np.diff(self.first)
        self.n_steps = -(-n_words // STEP)
        self.base = np.concatenate(([0], np.cumsum(self.n_steps)))
        within = np.arange(len(start)) - np.repeat(self.first[:-1], n_words)
        self.of_word = np.repeat(self.base[:-1], n_words) + within // STEP
        self.place = within % STEP
        self.begin = np.flatnonzero(np.diff(self.of_word, prepend=-1))

    def distinct_terms(self) -> np.ndarray:
        """The terms of every step, each once."""
        pairs = self.of_word * FEATURES + terms(self.hashes)
        pairs = np.sort(pairs.astype(np.int32) if len(self.begin) < (1 << 31 - BITS) else pairs)
        return pairs[np.diff(pairs, prepend=-1) != 0] & (FEATURES - 1)

    def sums(self, vectors: np.ndarray) -> np.ndarray:
        """Sum of the term vectors over each step. Steps are filled up with a term of zeros,
        so one take and one addition a place serve many steps."""
        width = vectors.shape[1]
        padded = np.ascontiguousarray(np.concatenate((vectors, np.zeros((1, width), vectors.dtype))))
        grid = np.full((len(self.begin), STEP), FEATURES, np.int64)
        grid[self.of_word, self.place] = terms(self.hashes)
        out = np.zeros((len(grid), width), vectors.dtype)
        some = np.empty((256, width), vectors.dtype)  # a temporary that fits the cache
        for at in range(0, len(grid), 256):
            part, columns = out[at:at + 256], grid[at:at + 256].T.copy()
            for column in columns:
                part += np.take(padded, column, axis=0, out=some[:len(part)], mode="clip")
        return out

    def windows(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first step, vector) of each window of two steps (or the only step)."""
        text = np.repeat(np.arange(len(self.n_steps)), self.n_steps)
        step = np.arange(len(text)) - np.repeat(self.base[:-1], self.n_steps)
        follows = step + 1 < self.n_steps[text]
        vector = sums.copy()
        at = np.flatnonzero(follows)
        vector[at] += sums[at + 1]
        keep = follows | (self.n_steps[text] == 1)
        return text[keep], step[keep], vector[keep]


def common_length(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, one bit of an integer per item word."""
    place: dict[int, int] = {}
    for i, w in enumerate(item):
        place[w] = place.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in words:
        hit = place.get(w)
        if hit:
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return len(item) - row.bit_count()


def term_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(steps with each hashed term, number of steps) over all documents."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, seen = WordHasher(), np.zeros(FEATURES + 1, np.int64)
        for frame in frames:
            for _, texts in word_blocks(frame["text"].tolist()):
                steps = Steps(hasher, texts)
                seen[:FEATURES] += np.bincount(steps.distinct_terms(), minlength=FEATURES)
                seen[FEATURES] += len(steps.begin)
        some = np.flatnonzero(seen)
        yield pd.DataFrame({"term": some, "n": seen[some]})

    total = np.zeros(FEATURES + 1, np.int64)
    for row in (docs.select("text").mapInPandas(count, "term long, n long").groupBy("term")
                .agg(F.sum("n").alias("n")).collect()):  # at most FEATURES + 1 rows
        total[row["term"]] = row["n"]
    return total[:FEATURES], int(total[FEATURES])


def passage_rows(items: DataFrame, idf: np.ndarray) -> DataFrame:
    """TF-IDF rows (term, value arrays) of the benchmark's passages."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for frame in frames:
            for _, texts in word_blocks(frame["text"].tolist()):
                steps, out = Steps(hasher, texts), []
                term = terms(steps.hashes)
                for t in range(len(texts)):
                    for at in range(steps.first[t], steps.first[t + 1], WINDOW):
                        distinct, n = np.unique(term[at:min(at + WINDOW, steps.first[t + 1])], return_counts=True)
                        value = n * idf[distinct]
                        if value.any():
                            out.append((distinct.tolist(), (value / np.linalg.norm(value)).tolist()))
                yield pd.DataFrame(out, columns=["term", "value"])

    return items.select("text").mapInPandas(rows, "term array<int>, value array<double>")


def latent_basis(rows: DataFrame, rank: int, oversample: int = 16, power: int = 2, partitions: int = 8,
                 seed: int = 11) -> np.ndarray:
    """Leading right singular vectors (FEATURES x rank) of the TF-IDF rows by randomised
    SVD. Each product A'(A Q) is summed over ``partitions`` tasks; a partial sum has
    FEATURES * (rank + oversample) numbers whatever the number of rows."""
    rows = rows.repartition(partitions)
    rng = np.random.default_rng(seed)
    width = rank + oversample
    q = np.linalg.qr(rng.normal(size=(FEATURES, width)))[0].astype(np.float32)
    for _ in range(power + 1):
        shared = rows.sparkSession.sparkContext.broadcast(q)

        def gram(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            out, base = np.zeros((FEATURES, width), np.float32), shared.value
            for frame in frames:
                for term, value in zip(frame["term"], frame["value"]):
                    value = np.asarray(value, np.float32)[:, None]
                    out[term] += value * (value * base[term]).sum(axis=0)
            yield pd.DataFrame({"sum": [out.tobytes()]})

        total = np.zeros((FEATURES, width), np.float32)
        for row in rows.mapInPandas(gram, "sum binary").toLocalIterator():
            total += np.frombuffer(row["sum"], np.float32).reshape(FEATURES, width)
        q = np.linalg.qr(total)[0].astype(np.float32)
    # the columns of A'A Q span the leading right singular vectors; a small exact SVD orders them
    vectors, squared, _ = np.linalg.svd(total.astype(np.float64), full_matrices=False)
    keep = min(rank, int((squared > 1e-6 * max(squared[0], 1e-30)).sum()))
    return vectors[:, :max(1, keep)].astype(np.float32)


def benchmark_blocks(items: DataFrame, max_items: int, max_bytes: int) -> Iterator[pd.DataFrame]:
    """The benchmark, a bounded block of rows (item_id, text) at a time."""
    block, held = [], 0
    for row in items.select("item_id", "text").where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).toLocalIterator():
        block.append((row["item_id"], row["text"]))
        held += len(row["text"])
        if len(block) >= max_items or held >= max_bytes:
            yield pd.DataFrame(block, columns=["item_id", "text"])
            block, held = [], 0
    if block:
        yield pd.DataFrame(block, columns=["item_id", "text"])


def as_items(block: pd.DataFrame, frequency: np.ndarray, common_from: float) -> list[Item]:
    hasher, out = WordHasher(), []
    for text in block["text"]:
        body = text.strip()
        cut = max(body[:-1].rfind(mark) for mark in (". ", "? ", "! ", ".\n", "?\n", "!\n"))
        data = text.encode("utf-8", "surrogatepass").lower()
        hashes, _, _ = hasher(np.frombuffer(data, np.uint8))
        n_answer = len(body[cut + 1:].encode("utf-8", "surrogatepass").split())
        out.append(Item(hashes.tolist(), frequency[terms(hashes)].tolist(), common_from, len(hashes) - n_answer))
    return out


class Needed:
    """Upper bounds of how many of an item's needed words (each as often as the item has
    it) lie in a range of steps."""

    def __init__(self, items: list[Item]):
        pairs = [(w, i, n) for i, x in enumerate(items) for w, n in Counter(x.needed).items()]
        word = np.array([p[0] for p in pairs], np.uint64)
        order = np.argsort(word, kind="stable")
        self.word, self.first, self.many = np.unique(word[order], return_index=True, return_counts=True)
        self.item = np.array([p[1] for p in pairs], np.int64)[order]
        self.times = np.array([p[2] for p in pairs], np.int64)[order]

    def read(self, steps: Steps) -> None:
        at = np.searchsorted(self.word, steps.hashes)
        at[at == len(self.word)] = 0
        known = np.flatnonzero(self.word[at] == steps.hashes)
        entry, many = at[known], self.many[at[known]]
        ends = np.cumsum(many)
        place = np.repeat(self.first[entry] - (ends - many), many) + np.arange(many.sum())
        self.size = len(steps.begin) + 1
        key = self.item[place] * self.size + np.repeat(steps.of_word[known], many)
        order = np.argsort(key)
        self.key, self.total = key[order], np.concatenate(([0], np.cumsum(self.times[place][order])))

    def between(self, item: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each item the count in the steps from ``low`` to before ``high``."""
        return (self.total[np.searchsorted(self.key, item * self.size + high)]
                - self.total[np.searchsorted(self.key, item * self.size + low)])


def least_cosines(items: list[Item], min_cosine: float, part: float) -> np.ndarray:
    """``min_cosine``, or less for an item so short that a window with ``part`` of its words
    and others of equal weight may stay below."""
    size = np.array([min(len(x.words), WINDOW) for x in items], float)
    return np.minimum(min_cosine, SLACK * part * np.sqrt(size / WINDOW))


def find_leaks(texts: list[str | None], basis: np.ndarray, queries: np.ndarray, owner: np.ndarray,
               items: list[Item], common: np.ndarray, min_cosine: float, whole: float, part: float
               ) -> list[list[tuple]]:
    """For each text its leaks (item, cosine, lcs, content and answer ratio)."""
    found: list[list[tuple]] = [[] for _ in texts]
    hasher, needed = WordHasher(), Needed(items)
    least = least_cosines(items, min_cosine, part)[owner].astype(np.float32)
    enough = np.array([part * x.least for x in items]) - 1e-9
    reach = np.array([-(-len(x.words) // STEP) for x in items])
    for offset, block in word_blocks(texts):
        steps = Steps(hasher, block)
        needed.read(steps)
        text, step, vector = steps.windows(steps.sums(basis))
        norm = np.linalg.norm(vector, axis=1)
        vector /= np.maximum(norm, 1e-12)[:, None]
        best: dict[tuple[int, int], list[tuple[float, int]]] = {}
        for at in range(0, len(vector), 4096):
            cosine = vector[at:at + 4096] @ queries.T
            row, q = np.nonzero(cosine >= least)
            item, begin = owner[q], steps.base[text[at + row]]
            first, end = begin + step[at + row], steps.base[text[at + row] + 1]
            some = needed.between(item, np.maximum(begin, first - reach[item]),
                                  np.minimum(end, first + 2 + reach[item])) >= enough[item]
            for w, q in zip(row[some].tolist(), q[some].tolist()):
                best.setdefault((int(text[at + w]), int(owner[q])), []).append((float(cosine[w, q]), int(step[at + w])))
        for (t, i), hits in best.items():
            item = items[i]
            lo, hi = int(steps.first[t]), int(steps.first[t + 1])
            for cosine, s in sorted(hits, reverse=True):
                begin = max(lo, lo + s * STEP - len(item.words))
                around = steps.hashes[begin:min(hi, lo + s * STEP + WINDOW + len(item.words))]
                words = around.tolist()
                lcs = common_length(item.words, words) / len(item.words)
                if lcs < part:
                    continue
                rare = [w for w, c in zip(words, common[terms(around)].tolist()) if not c]
                shares = [ratios(item.rare, item.answer, rare)]
                if item.rarer:
                    shares.append(ratios(item.rarer, item.rarer_answer, words))
                fitting = [(content, answer) for content, answer in shares
                           if content >= part and answer >= part
                           or lcs >= whole and (content >= whole or not item.rare)]
                if fitting:
                    found[offset + t].append((i, cosine, lcs, *fitting[0]))
                    break
    return found


def leak_finders(docs: DataFrame, items: DataFrame, rank: int = 128, min_cosine: float = 0.4, whole: float = 0.85,
                 part: float = 0.6, max_items: int = 4096, max_bytes: int = 8 << 20
                 ) -> list[tuple[list, Callable[[str], Column]]]:
    """One (item_ids, column function) per block of the benchmark: the function gives the
    leaks of a text column, each with the item's place in ``item_ids``."""
    spark = docs.sparkSession
    if items.isEmpty():
        return []
    frequency, n_steps = term_frequencies(docs)
    idf = np.log((n_steps + 1) / (frequency + 1))
    common_from = RARE * max(1, n_steps)
    common = frequency >= common_from
    out = []
    for block in benchmark_blocks(items, max_items, max_bytes):
        rows = stored(passage_rows(spark.createDataFrame(block[["text"]], "text string"), idf), "passages")
        basis = (latent_basis(rows, rank) * idf[:, None]).astype(np.float32)
        queries, owner = query_vectors(block, basis)
        shared = spark.sparkContext.broadcast(
            (basis, queries, owner, [(x.words, x.steps, x.common_from, x.answer_from)
                                      for x in as_items(block, frequency, common_from)], common))
        out.append((block["item_id"].tolist(), _finder(shared, min_cosine, whole, part)))
    return out


def query_vectors(block: pd.DataFrame, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the items' windows and the item of each."""
    hasher, vectors, owner = WordHasher(), [], []
    for first, texts in word_blocks(block["text"].tolist()):
        steps = Steps(hasher, texts)
        text, _, vector = steps.windows(steps.sums(basis))
        norm = np.linalg.norm(vector, axis=1)
        some = norm > 1e-9
        vectors.append(vector[some] / norm[some, None])
        owner.append(first + text[some])
    return np.concatenate(vectors).astype(np.float32), np.concatenate(owner)


def _finder(shared, min_cosine: float, whole: float, part: float) -> Callable[[str], Column]:
    @F.pandas_udf(LEAK_TYPE)
    def leaks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        basis, queries, owner, plain, common = shared.value
        items = [Item(*x) for x in plain]
        for text in parts:
            rows = find_leaks(text.tolist(), basis, queries, owner, items, common, min_cosine, whole, part)
            yield pd.Series([[dict(zip(("item", "cosine", "lcs_ratio", "content_ratio", "answer_ratio"), x))
                              for x in row] for row in rows], dtype=object)

    return leaks


def find_contamination(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """doc_id, item_id, cosine, lcs_ratio, content_ratio, answer_ratio: one row per document
    and benchmark item that it leaks."""
    schema = "doc_id long, item_id long, cosine double, lcs_ratio double, content_ratio double, answer_ratio double"
    out = docs.sparkSession.createDataFrame([], schema)
    for ids, leaks in leak_finders(docs, items, **options):
        known = F.array(*[F.lit(i).cast("long") for i in ids])
        out = out.union(docs.select("doc_id", F.inline(leaks("text")))
                        .select("doc_id", F.get(known, F.col("item")).alias("item_id"), "cosine", "lcs_ratio",
                                "content_ratio", "answer_ratio"))
    return out


def uncontaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) without a leak."""
    for _, leaks in leak_finders(docs, items, **options):
        docs = docs.where(F.size(leaks("text")) == 0)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) leak in ``documents``."""
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
