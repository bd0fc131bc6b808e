"""Exact BM25 top-k over an inverted index, pruned by upper bounds of terms and blocks.

Index: every row is indexed. Tasks turn runs of documents into shards of bounded size, each
one row of a stored table: sorted 64-bit term hashes and postings in (term, document) order.

Search: queries come in blocks of a bounded number of terms. Document frequencies, the
number of documents and the mean length are global, so scores do not depend on shards.
Some shards at a time are taken apart into tiles: blocks of documents that share frequent words, each with
the largest score of every term in it. Queries meet a tile many at a time, those with
similar words together. Queries whose bounds in a tile cannot reach the k-th best score known
pass it by. For the others the rarer terms are summed from their postings; where the bounds of
the frequent terms left cannot lift any document to the k-th best score (the WAND condition), these are not
looked at, else they are added as a product of matrices. Documents that can still be among
the k best are evaluated in full, in double precision and in the order of the terms, so equal texts
have equal scores. The k-th best scores carry over between the tiles and shards of a task
and, as the index is searched in parts of growing size, from each part to all tasks of the next.
The tasks' lists are merged exactly.

A query is the set of distinct words (A-Z lower-cased) of a text; the score is the sum over
them of ln(1 + (N - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len / mean)),
rounded to nine decimals. Only documents that share a word with the query are found. Words
are told apart by 64-bit hashes (odd-base polynomials of their bytes, mixed): two words of a
corpus agree by chance with a probability of about words**2 / 2**65, and words of 1,024 bytes
and more can be made to collide on purpose.

Defined results: ties go to the smaller doc_id, null ids last; null and blank texts are
indexed with length 0 and never found, as queries they find nothing; repeated documents
are each found, repeated queries (same id and text) are asked once; texts are read whole;
other columns are never read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import WordHasher, stored, table, word_blocks

K1, B = 1.2, 0.75
SHARD_TOKENS, TILE_TOKENS = 1_000_000, 4_000_000  # of an index row, and of the rows that are searched together
PIECE = 1 << 16
GROUPS, GROUP_TERMS, GROUP_ROWS = 8, 512, 4096
TILE_DOCS = 4096
CELLS = 1 << 18  # of queries and documents whose scores are summed at once
DENSE, DENSE_CELLS = 0.06, 1 << 21  # share of a tile's documents that makes a term frequent; numbers held for those
SLACK = 1e-6
COLUMNS = ("ids", "lengths", "terms", "offsets", "docs", "tfs")
POSTING = np.dtype([("doc", np.int32), ("score", np.float32)])
TASKS_PER_CORE, FIRST_TASKS_PER_CORE = 8, 1
STEP, LEAST_SHARDS = 8, 8
SLICE = 1 << 13
NO_ID = np.iinfo(np.int64).max
INDEX_TYPE = ("n_docs long, n_tokens long, ids binary, lengths binary, terms binary, offsets binary, docs binary, "
              "tfs binary")


def packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in the smallest type that holds them all."""
    return numbers.astype(np.min_scalar_type(numbers.max(initial=0))).tobytes()


def unpacked(data: pa.Buffer, n: int) -> np.ndarray:
    return np.frombuffer(data, f"u{len(data) // n}") if n else np.zeros(0, np.uint8)


def build_shard(ids: list, words: list[np.ndarray]) -> dict:
    """One index row from the word hashes of the documents."""
    lengths = np.fromiter(map(len, words), np.int32, len(words))
    term = np.concatenate(words) if words else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    order = np.argsort(term, kind="stable")  # documents stay in order within a term
    term, doc = term[order], doc[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(np.append(first, len(term))).astype(np.int32)
    term, doc = term[first], doc[first]
    begins = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
    return {"n_docs": len(ids), "n_tokens": int(lengths.sum()),
            "ids": np.array([NO_ID if i is None or i != i else int(i) for i in ids], np.int64).tobytes(),
            "lengths": lengths.tobytes(), "terms": term[begins].tobytes(),
            "offsets": packed(np.append(begins, len(term))), "docs": packed(doc), "tfs": packed(tf)}


def hashed_texts(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Word hashes of each text."""
    hasher = WordHasher()
    for _, block in word_blocks(texts):
        hashes, start, _ = hasher(np.frombuffer(b"\n".join(block), np.uint8))
        edge = np.cumsum(np.fromiter(map(len, block), np.int64, len(block)) + 1)
        yield from np.split(hashes, np.searchsorted(start, edge[:-1]))


def build_index(docs: DataFrame) -> DataFrame:
    """The index of all rows (columns doc_id, text), one row per shard, stored."""

    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, words, held = [], [], 0
        for frame in frames:
            for doc_id, hashes in zip(frame["doc_id"].tolist(), hashed_texts(frame["text"].tolist())):
                ids.append(doc_id)
                words.append(hashes)
                held += len(hashes) + 1
                if held >= SHARD_TOKENS:
                    yield pd.DataFrame([build_shard(ids, words)])
                    ids, words, held = [], [], 0
        if ids:
            yield pd.DataFrame([build_shard(ids, words)])

    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(build, INDEX_TYPE),
                  "index")


def narrow(numbers: np.ndarray, n: int) -> np.ndarray:
    """Numbers below ``n`` in a type that numpy sorts by radix, if they fit."""
    return numbers.astype(np.uint16) if n <= 1 << 16 else numbers


class Groups:
    """Groups of texts that share frequent words. They only say which documents and which
    queries are worked on together: no result depends on them."""

    def __init__(self, lists: list[np.ndarray], df: np.ndarray, n_docs: int):
        """``lists``: the numbers of each query's terms; ``df``: documents with each term."""
        chosen = np.argsort(-df, kind="stable")[:GROUP_TERMS]
        self.column = np.full(len(df), -1, np.int16)
        self.column[chosen] = np.arange(len(chosen))
        self.weight = np.log(1 + n_docs / np.maximum(1, df[chosen])).astype(np.float32)
        self.center = np.zeros((len(chosen), 1), np.float32)
        rows = self.matrix(len(lists[:GROUP_ROWS]), *self.flat(lists[:GROUP_ROWS]))
        rows /= np.maximum(1e-9, np.linalg.norm(rows, axis=1, keepdims=True))
        if not rows.any():
            return
        picked, near = [int(rows.any(axis=1).argmax())], np.full(len(rows), -1.0, np.float32)
        while len(picked) < GROUPS:
            near = np.maximum(near, rows @ rows[picked[-1]])
            far = np.where(rows.any(axis=1), near, 1.0)
            if far.min() > 0.999:
                break
            picked.append(int(far.argmin()))
        self.center = rows[picked].T
        for _ in range(5):
            label = (rows @ self.center).argmax(axis=1)
            total = np.stack([rows[label == c].sum(axis=0) for c in range(self.center.shape[1])], axis=1)
            size = np.linalg.norm(total, axis=0)
            self.center = np.where(size > 0, total / np.maximum(size, 1e-9), self.center)

    @staticmethod
    def flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return (np.repeat(np.arange(len(lists)), [len(x) for x in lists]),
                np.concatenate(lists) if lists else np.zeros(0, np.int32))

    def matrix(self, n: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        at = self.column[term]
        hit = np.flatnonzero(at >= 0)
        return self.filled(n, row[hit], at[hit])

    def filled(self, n: int, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros((n, len(self.weight)), np.float32)
        out[row, at] = self.weight[at]
        return out

    def of(self, n: int, row: np.ndarray, term: np.ndarray) -> np.ndarray:
        """The group of each of ``n`` texts, of which text ``row[i]`` has ``term[i]``."""
        at, label = self.column[term], np.zeros(n, np.uint8)
        hit = np.flatnonzero(at >= 0)
        row, at = row[hit], at[hit]
        order = np.argsort(narrow(row, n), kind="stable")
        row, at = row[order], at[order]
        for a in range(0, n, GROUP_ROWS):
            b = min(n, a + GROUP_ROWS)
            part = slice(*np.searchsorted(row, (a, b)))
            label[a:b] = (self.filled(b - a, row[part] - a, at[part]) @ self.center).argmax(axis=1)
        return label


class Tile:
    """Documents of one group in a shard: postings of the queries' terms in (term, document)
    order with their scores, the largest score of each term (which bounds it in this tile),
    and rows of scores over all documents for the terms that many documents have."""

    def __init__(self, ids: np.ndarray, docs: np.ndarray, term: np.ndarray, score: np.ndarray):
        self.ids, self.n = ids, len(ids)
        self.posting = np.empty(len(docs), POSTING)  # one read of memory for both
        self.posting["doc"], self.posting["score"] = docs, score
        self.posting = self.posting.view(np.int64)
        new = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        self.terms, self.begin = term[new], new
        self.df = np.diff(np.append(new, len(term)))
        self.most = np.maximum.reduceat(score, new)
        local = np.repeat(np.arange(len(new), dtype=np.int32), self.df)
        order = np.argsort(narrow(docs, self.n), kind="stable").astype(np.int32)
        self.doc_begin = np.concatenate(([0], np.cumsum(np.bincount(docs, minlength=self.n))))
        self.doc_term, self.doc_score = local[order], score[order]
        often = np.flatnonzero(self.df >= max(2, DENSE * self.n))
        often = often[np.argsort(-self.df[often], kind="stable")][:max(1, DENSE_CELLS // self.n)]
        self.row_of = np.full(len(new), -1, np.int32)
        self.row_of[often] = np.arange(len(often))
        self.often_df, self.rows = self.df[often], np.zeros((len(often), self.n), np.float32)
        for i, t in enumerate(often.tolist()):
            part = slice(self.begin[t], self.begin[t] + self.df[t])
            self.rows[i, docs[part]] = score[part]

    def search(self, row: np.ndarray, term: np.ndarray, floor: np.ndarray, k: int
               ) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, documents, scores) that can be among the k best, for queries whose terms
        (numbers in this tile) are ``term[row == query]``, ``row`` ascending; ``floor``: the
        k-th best score known of each query. Every document that reaches ``floor`` and the
        tile's k-th best is there."""
        n_rows = len(floor)
        # MaxScore: queries that the tile's bounds cannot lift to their floor are left out
        bound = np.bincount(row, self.most[term], n_rows)
        open_ = (bound > 0) & (bound * (1 + 1e-9) >= floor - SLACK)
        if not open_.any():
            return
        if not open_.all():
            kept = open_[row]
            row, term = row[kept], term[kept]
        at = self.row_of[term]
        frequent = at >= 0
        often = np.bincount(at[frequent], minlength=len(self.rows)) * self.often_df >= DENSE ** 2 * n_rows * self.n
        frequent[frequent] = often[at[frequent]]
        total = self.gather(row[~frequent], term[~frequent], n_rows)
        # the frequent terms open no candidate where their bounds do not reach the floor
        left = np.bincount(row[frequent], self.most[term[frequent]], n_rows)
        slack = SLACK + 1e-6 * bound + 1e-4 * left  # sums of scores, then products, in single precision
        alive = np.flatnonzero(open_ & (total.max(axis=1) + left >= floor - slack))
        if not len(alive):
            return
        place = np.full(n_rows, -1, np.int32)
        place[alive] = np.arange(len(alive))
        total = total[alive] if len(alive) < n_rows else total
        frequent &= place[row] >= 0
        if frequent.any():
            used = np.flatnonzero(often)
            has = np.zeros((len(alive), len(often)), np.float32)
            has[place[row[frequent]], at[frequent]] = 1
            total += has @ self.rows if 4 * len(used) > 3 * len(often) else has[:, used] @ self.rows[used]
        found = total >= np.maximum(floor[alive] - slack[alive], np.finfo(float).tiny)[:, None]
        number = np.count_nonzero(found, axis=1)
        many = np.flatnonzero(number > k)
        if len(many) and self.n > k:
            kth = np.partition(total[many], self.n - k, axis=1)[:, self.n - k]
            found[many] &= total[many] >= (kth - 2 * slack[alive[many]])[:, None]
        which, docs = np.nonzero(found)
        edges = np.searchsorted(which, np.arange(len(alive) + 1))
        starts = np.searchsorted(row, np.arange(n_rows + 1))
        mark = np.zeros(len(self.terms), bool)
        for i in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            q = int(alive[i])
            own = term[starts[q]:starts[q + 1]]
            mark[own] = True
            some = docs[edges[i]:edges[i + 1]]
            yield q, some, self.evaluate(mark, some)
            mark[own] = False

    def gather(self, row: np.ndarray, term: np.ndarray, n_rows: int) -> np.ndarray:
        """Sums of the scores of all postings of the terms, by query and document."""
        total, n = np.zeros((n_rows, self.n)), self.df[term]
        upto = np.concatenate(([0], np.cumsum(n)))
        edges = np.searchsorted(row, np.arange(n_rows + 1))
        a = 0
        while a < n_rows:  # a few queries at a time: temporaries stay small
            b = max(a + 1, int(np.searchsorted(upto[edges], upto[edges[a]] + PIECE, "right")) - 1)
            part = slice(edges[a], edges[b])
            index = np.repeat(self.begin[term[part]] - upto[part], n[part])
            index += np.arange(upto[edges[a]], upto[edges[b]])
            cell = np.repeat((row[part] - a) * np.int64(self.n), n[part])
            posting = self.posting.take(index).view(POSTING)
            cell += posting["doc"]
            total[a:b] = np.bincount(cell, posting["score"], (b - a) * self.n).reshape(b - a, self.n)
            a = b
        return total

    def evaluate(self, mark: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scores of the documents for the query whose terms are marked."""
        out = np.empty(len(docs))
        for a in range(0, len(docs), 1000):
            begin, end = self.doc_begin[docs[a:a + 1000]], self.doc_begin[docs[a:a + 1000] + 1]
            n = end - begin
            first = np.cumsum(n) - n
            index = np.arange(n.sum()) + np.repeat(begin - first, n)
            out[a:a + 1000] = np.add.reduceat(np.where(mark[self.doc_term[index]], self.doc_score[index], 0.0), first)
        return out


def shards(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[pa.Buffer]]:
    """The named columns of each index row, not copied."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield [batch.column(name)[i].as_buffer() for name in names]


def asked_postings(row: list[pa.Buffer], vocabulary: np.ndarray) -> tuple[np.ndarray, ...]:
    """(ids, lengths, documents, terms, frequencies) of an index row (COLUMNS): of the
    documents, and of the postings of the vocabulary's terms."""
    ids, length, terms = (np.frombuffer(x, t) for x, t in zip(row, (np.int64, np.int32, np.uint64)))
    offsets = unpacked(row[3], len(terms) + 1)
    docs, tf = (unpacked(x, int(offsets[-1])) for x in row[4:])
    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    asked, n = vocabulary[at] == terms, np.diff(offsets)
    kept = np.repeat(asked, n)
    return ids, length, docs[kept].astype(np.int32), np.repeat(at[asked].astype(np.int32), n[asked]), tf[kept]


def tiles(rows: list[tuple[np.ndarray, ...]], mean: float, idf: np.ndarray, groups: Groups) -> Iterator[Tile]:
    """The tiles of the ``asked_postings`` of some rows; documents without any are left out."""
    first = np.cumsum([0, *(len(row[0]) for row in rows)])
    ids, length, docs, term, tf = (np.concatenate(x) for x in zip(*rows))
    docs += np.repeat(first[:-1], [len(row[2]) for row in rows]).astype(np.int32)
    if not len(docs):
        return
    label = groups.of(len(ids), docs, term)
    size = np.bincount(label, minlength=256)
    label[size[label] < len(ids) // 32] = 255  # small groups share a tile
    there = np.zeros(len(ids), bool)
    there[docs] = True
    members = np.flatnonzero(there)
    members = members[np.argsort(label[members], kind="stable")]
    label = label[members]
    place = np.arange(len(members)) - np.searchsorted(label, label)
    edges = np.append(np.flatnonzero(place % TILE_DOCS == 0), len(members))  # a tile's first document
    tile_of, local = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32)
    tile_of[members], local[members] = np.repeat(np.arange(len(edges) - 1), np.diff(edges)), place % TILE_DOCS
    tile_of = narrow(tile_of, len(edges))[docs]
    for c in range(len(edges) - 1):
        part = np.flatnonzero(tile_of == c).astype(np.int32)
        part = part[np.argsort(term[part], kind="stable")]  # merges the rows, each in order
        score = np.empty(len(part))
        for a in range(0, len(part), PIECE):  # a piece at a time: temporaries stay small
            some = part[a:a + PIECE]
            score[a:a + PIECE] = bm25(tf[some], length[docs[some]], mean) * idf[term[some]]
        yield Tile(ids[members[edges[c]:edges[c + 1]]], local[docs[part]], term[part], score)


def bm25(tf: np.ndarray, length: np.ndarray, mean: float) -> np.ndarray:
    """Score of a posting before idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


class Best:
    """The k best documents so far of each query, by score and then id."""

    def __init__(self, edges: np.ndarray, term_of: np.ndarray, n_terms: int, k: int, floor: np.ndarray):
        """Query q asks for the terms ``term_of[edges[q]:edges[q + 1]]``, ascending;
        documents below its ``floor`` are not wanted."""
        self.floor = floor
        self.edges, self.term_of, self.k = edges, term_of, k
        self.ids, self.scores = np.full((len(floor), k), NO_ID, np.int64), np.full((len(floor), k), -1.0)
        self.local = np.full(n_terms, -1, np.int32)

    def take(self, tile: Tile) -> None:
        self.local[tile.terms] = np.arange(len(tile.terms))
        step = max(1, CELLS // tile.n)
        for a in range(0, len(self.ids), step):
            b = min(a + step, len(self.ids))
            term = self.local[self.term_of[self.edges[a]:self.edges[b]]]
            known = np.flatnonzero(term >= 0)
            row = np.repeat(np.arange(b - a, dtype=np.int32), np.diff(self.edges[a:b + 1]))[known]
            floor = np.maximum(self.floor[a:b], self.scores[a:b, -1])
            for q, docs, scores in tile.search(row, term[known], floor, self.k):
                q += a
                docs, scores = docs[scores > 0], np.round(scores[scores > 0], 9)
                ids = np.concatenate((self.ids[q], tile.ids[docs]))
                scores = np.concatenate((self.scores[q], scores))
                order = np.lexsort((ids, -scores))[:self.k]
                self.ids[q], self.scores[q] = ids[order], scores[order]
        self.local[tile.terms] = -1


def query_blocks(queries: DataFrame, block_terms: int) -> Iterator[pd.DataFrame]:
    """(query_id, terms) of the queries, in blocks of about ``block_terms`` terms."""

    def to_terms(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            terms = [np.unique(h) for h in hashed_texts(frame["text"].tolist())]
            yield pd.DataFrame({"query_id": frame["doc_id"].astype("Int64"), "n": [len(t) for t in terms],
                                "terms": [t.tobytes() for t in terms]})

    rows = stored(queries.select(F.col("doc_id").cast("long").alias("doc_id"), "text").distinct()
                  .mapInPandas(to_terms, "query_id long, n long, terms binary").where("n > 0"), "queries")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    blocks = -(-total // block_terms)
    for b in range(blocks):
        # about block_terms terms: the bound on what is collected and broadcast
        yield (rows.where(F.pmod(F.xxhash64("query_id", "terms"), F.lit(blocks)) == b)
               .orderBy("query_id", "terms").toArrow().to_pandas())


def few_tasks(index: DataFrame, per_core: int = TASKS_PER_CORE) -> DataFrame:
    """The index in a number of tasks that depends on the cluster only: what a task gives
    out for each query or term does not grow with the index."""
    return index.coalesce(per_core * index.sparkSession.sparkContext.defaultParallelism)


def document_frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Number of documents with each of the (sorted, distinct) terms."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        total = np.zeros(len(wanted), np.int64)
        for have, offsets in shards(batches, "terms", "offsets"):
            have = np.frombuffer(have, np.uint64)
            offsets = unpacked(offsets, len(have) + 1)
            at = np.searchsorted(wanted, have)
            hit = np.flatnonzero(wanted[np.minimum(at, len(wanted) - 1)] == have)
            total[at[hit]] += np.diff(offsets)[hit]
        for a in range(0, len(total), SLICE):
            yield pa.RecordBatch.from_pydict({"slice": [a // SLICE], "n": [total[a:a + SLICE].tobytes()]})

    def add(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0
        for frame in frames:
            for n in frame["n"]:
                total = total + np.frombuffer(n, np.int64)
        yield pd.DataFrame({"slice": [key[0]], "n": [total.tobytes()]})

    kind = "slice long, n binary"
    found = (few_tasks(index.select("terms", "offsets")).mapInArrow(count, kind).groupBy("slice")
             .applyInPandas(add, kind).orderBy("slice").toArrow())
    return np.concatenate([np.frombuffer(x, np.int64) for x in found["n"].to_pylist()] or [np.zeros_like(terms, np.int64)])


def steps(index: DataFrame, n_shards: int) -> list[DataFrame]:
    """The index in parts, each about STEP times as large as those before it together: the
    k-th best scores of one part are the floors of the next."""
    edges = [0.0]
    while n_shards * STEP ** -len(edges) >= LEAST_SHARDS:
        edges.append(STEP ** -len(edges))
    edges = [0.0, *sorted(edges[1:]), 1.0]
    place = F.pmod(F.xxhash64("ids", "lengths"), F.lit(1 << 20)) / F.lit(1 << 20)
    return [index.where((place >= a) & (place < b)) for a, b in zip(edges, edges[1:])]


def best_of(index: DataFrame, mean: float, k: int, shared, floor: np.ndarray, per_core: int) -> DataFrame:
    """query, id, score: the k best rows of each task, without those below the floors."""
    floors = index.sparkSession.sparkContext.broadcast(floor)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, term_of, vocabulary, idf, groups = shared.value
        top = Best(edges, term_of, len(vocabulary), k, floors.value)
        rows, held = [], 0

        def take() -> None:
            for tile in tiles(rows, mean, idf, groups):
                top.take(tile)

        for row in shards(batches, *COLUMNS):
            rows.append(asked_postings(row, vocabulary))
            held += int(rows[-1][1].sum()) + len(rows[-1][0])
            if held >= TILE_TOKENS:
                take()
                rows, held = [], 0
        if rows:
            take()
        for a in range(0, len(top.ids), 1000):
            query, place = np.nonzero(top.scores[a:a + 1000] >= 0)
            query += a
            yield pa.RecordBatch.from_pydict(
                {"query": query, "id": top.ids[query, place], "score": top.scores[query, place]})

    return few_tasks(index.select(*COLUMNS), per_core).mapInArrow(best, "query long, id long, score double")


def search(index: DataFrame, queries: DataFrame, k: int = 10, block_terms: int = 4_000_000) -> DataFrame:
    """query_id, rank, doc_id, score: the k best rows of the index for each query row."""
    spark = index.sparkSession
    n_docs, n_tokens, n_shards = index.agg(
        F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*")).first()
    mean = max(1e-9, n_tokens / max(1, n_docs))
    out = spark.createDataFrame([], "query_id long, rank int, doc_id long, score double")
    for block in query_blocks(queries, block_terms):
        if not len(block):  # the hashes left this one empty
            continue
        lists = [np.frombuffer(x, np.uint64) for x in block["terms"]]
        vocabulary, term_of = np.unique(np.concatenate(lists), return_inverse=True)
        df = document_frequencies(index, vocabulary)
        lists = np.split(term_of.astype(np.int32), np.cumsum([len(x) for x in lists])[:-1])
        groups = Groups(lists, df, n_docs)
        order = np.argsort(groups.of(len(lists), *groups.flat(lists)), kind="stable")
        lists = [lists[i] for i in order]
        names = [None if pd.isna(x) else int(x) for x in block["query_id"].iloc[order]]
        shared = spark.sparkContext.broadcast((
            np.cumsum([0, *map(len, lists)]), np.concatenate(lists), vocabulary,
            np.log(1 + (n_docs - df + 0.5) / (df + 0.5)), groups))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        found, floor = [], np.zeros(len(lists))
        *first, last = steps(index, n_shards)
        for rows in first:
            found.append(stored(best_of(rows, mean, k, shared, floor, FIRST_TASKS_PER_CORE), "best"))
            known = (functools.reduce(DataFrame.union, found).withColumn("rank", F.row_number().over(order))
                     .where(F.col("rank") == k).select("query", "score").toArrow())
            floor = floor.copy()
            floor[known["query"].to_numpy()] = known["score"].to_numpy()
        found.append(best_of(last, mean, k, shared, floor, TASKS_PER_CORE))
        names = spark.createDataFrame(list(enumerate(names)), "query long, query_id long")
        merged = (functools.reduce(DataFrame.union, found)
                  .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        out = out.union(merged.join(F.broadcast(names), "query").select(
            "query_id", "rank", F.nullif(F.col("id"), F.lit(int(NO_ID))).alias("doc_id"), "score"))
    return out


def op10_topk_search(spark, sf_dir: str) -> DataFrame:
    """The ten best rows of ``documents`` for every row whose doc_id is divisible by 100."""
    docs = table(spark, sf_dir, "documents")
    return search(build_index(docs), docs.where(F.col("doc_id") % 100 == 0))


# doc_id is a key of the given table, so its rows are the distinct queries
ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents),
held AS (SELECT rid, word, count(*) AS tf FROM (SELECT rid, unnest(words) AS word FROM d) AS t GROUP BY rid, word),
rarity AS (
  SELECT word, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf
  FROM held, (SELECT count(*) AS n FROM d) AS size GROUP BY word, n),
lengths AS (
  SELECT rid, doc_id, len(words) / (SELECT sum(len(words)) / count(*) FROM d) AS share FROM d),
found AS (
  SELECT q.doc_id AS query_id, l.doc_id,
         round(sum(idf * tf * ({K1} + 1) / (tf + {K1} * (1 - {B} + {B} * share))), 9) AS score
  FROM (SELECT h.rid, d.doc_id, h.word FROM held h JOIN d USING (rid) WHERE d.doc_id % 100 = 0) AS q
  JOIN held h ON h.word = q.word JOIN rarity r ON r.word = q.word JOIN lengths l ON l.rid = h.rid
  GROUP BY q.rid, q.doc_id, l.rid, l.doc_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
       doc_id, score
FROM found QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10
"""
