"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is its lower-cased (A-Z) words, each followed by a space, the last by the end
byte; every byte is eight binary decisions. For each decision one predictor per context
length in ORDERS looks up the counts of ones and zeros seen after a hash of (context, bits
of the byte so far) and gives their log odds. A mixer adds the log odds with weights from
a set chosen by the longest context known and the bit's place, and an adaptive
probability map, by the byte before, refines the result. The product over all bits is the
model's probability of the text.

The counts cover every training document: tasks count distinct runs of bytes, Spark sums
them, and a second pass adds them up into the tables of 2**TABLE_BITS slots per order (the
bound on what is broadcast). Weights and map are fitted on every training byte: each
distinct run counts as often as it occurs, and its decisions are predicted from the counts
without the occurrence itself, so that they meet contexts as new as a scored text would.
Weights take STEPS Newton steps of the logistic loss, whose sums tasks make and Spark adds
up; a last pass makes the map. Scoring does not change the model: a score does not depend
on the partition or on the other texts. Each task evaluates a run of bytes once and keeps
the result in a fixed-size cache.

``base_score`` is the add-one unigram score of the contract. Counts of the most frequent
words are broadcast (a bounded number); the rest meet their counts in a join. A 64-bit
hash stands for a word.

Defined results: a null text counts as empty (one token, the end); with no training rows
all counts are zero and every bit is even; repeated rows score alike; long texts are read
whole; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import WordHasher, fold, stored, table, word_blocks

ORDERS = (1, 2, 3, 4, 6)
SPAN = max(ORDERS) + 1  # bytes in a run: the context and the byte it precedes
TABLE_BITS = 21
CACHE_BITS = 22
STEP = 8.0  # a table entry is the log odds in steps of 1 / STEP
END = b"\n"
END_WORD = 0
MODULUS, HELD_OUT = 7, 2
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ORDER_SALT = {o: np.uint64(o * int(M3) % (1 << 64)) for o in ORDERS}
SETS, INPUTS = 8 * (len(ORDERS) + 1), len(ORDERS) + 1  # weight sets; log odds and a constant
STEPS = 4  # Newton steps of the weights
FIRM = 20.0  # decisions that the map's starting values weigh as much as
MOST = 1 << 25  # largest count that is added up inside a task
CELLS, REACH = 33, 8.0  # the map's cells over log odds of -REACH to REACH


def runs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(one number per byte holding it and the SPAN - 1 bytes before it, bytes of each text)."""
    streams = [b" ".join(t.split()) + END for t in texts]
    sizes = np.fromiter(map(len, streams), np.int64, len(streams))
    pad = END * (SPAN - 1)
    data = np.frombuffer(pad + pad.join(streams), np.uint8).astype(np.uint64)
    key = data[SPAN - 1:].copy()
    for back in range(1, SPAN):
        key |= data[SPAN - 1 - back:len(data) - back] << np.uint64(8 * back)
    own = np.ones(len(key), bool)
    for end in np.cumsum(sizes[:-1] + SPAN - 1).tolist():
        own[end - SPAN + 1:end] = False
    return key[own], sizes


def order_hashes(key: np.ndarray) -> list[np.ndarray]:
    """A hash of the context of each order."""
    return [((key >> np.uint64(8)) & np.uint64((1 << 8 * o) - 1)) * M1 + ORDER_SALT[o] for o in ORDERS]


def slots(context: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Table slot of (context hash, bits of the byte so far)."""
    return slots_after(context ^ (context >> np.uint64(29)), node)


def slots_after(stirred: np.ndarray, node: np.ndarray) -> np.ndarray:
    """``slots`` for what it makes of the context hash alone, the same for every node."""
    mixed = stirred + node * M3
    mixed ^= mixed >> np.uint64(31)
    mixed *= M2
    mixed >>= np.uint64(64 - TABLE_BITS)
    return mixed.view(np.int64)


def stirred_contexts(key: np.ndarray) -> np.ndarray:
    """(order, run): the context hashes of every order, ready for ``slots_after``."""
    out = np.stack(order_hashes(key))
    out ^= out >> np.uint64(29)
    return out


class Tally:
    """Distinct numbers and how often each was added. Whenever more than ``most`` are held
    they are merged; if more than three quarters of that are left, ``add`` gives them out
    and starts anew, so that memory does not grow with the task's input."""

    def __init__(self, most: int = 1 << 21):
        self.keys, self.counts, self.held, self.most = [], [], 0, most

    def add(self, values: np.ndarray) -> Iterator[pd.DataFrame]:
        key, count = np.unique(values, return_counts=True)
        self.keys.append(key)
        self.counts.append(count)
        self.held += len(key)
        if self.held > self.most:
            self.merge()
            if self.held > self.most * 3 // 4:
                yield from self.given_out()

    def merge(self) -> None:
        key = np.concatenate(self.keys)
        order = np.argsort(key, kind="stable")  # merges the sorted pieces
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.add.reduceat(np.concatenate(self.counts)[order], first)
        self.keys, self.counts, self.held = [key[first]], [count], len(first)

    def given_out(self) -> Iterator[pd.DataFrame]:
        if self.held:
            self.merge()
            (key,), (n,) = self.keys, self.counts
            self.keys, self.counts, self.held = [], [], 0
            for at in range(0, len(key), 100000):
                yield pd.DataFrame({"key": key[at:at + 100000].view(np.int64), "n": n[at:at + 100000]})


def tallied(texts: DataFrame, words: bool) -> DataFrame:
    """(key, n): occurrences of each word hash (and of the end of a text), or of each run
    of bytes, in column text of all rows."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally, hasher = Tally(), WordHasher()
        for frame in frames:
            for _, block in word_blocks(frame["text"].tolist(), 1 << 19):
                if words:
                    yield from tally.add(hasher(np.frombuffer(b"\n".join(block), np.uint8))[0])
                    yield from tally.add(np.full(len(block), END_WORD, np.uint64))
                else:
                    yield from tally.add(runs(block)[0])
        yield from tally.given_out()

    return texts.select("text").mapInPandas(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def predictor_tables(counted: DataFrame) -> np.ndarray:
    """Log odds (int8, orders x slots) of a one after each hashed context and bit prefix."""
    return slot_odds(counted, [(0, 0)])[0]


def slot_odds(counted: DataFrame, less: list[tuple[int, int]]) -> np.ndarray:
    """Log odds (int8, orders x slots) for each (zeros, ones) taken from the counts."""

    def places(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(whether the bit is one, slot) of every run, for each order and bit."""
        byte = key & np.uint64(255)
        for o, context in enumerate(order_hashes(key)):
            for bit in range(8):
                node = (byte | np.uint64(256)) >> np.uint64(8 - bit)
                yield ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64), (o << TABLE_BITS) + slots(context, node)

    def spread(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held = np.zeros((2, len(ORDERS) << TABLE_BITS), np.uint32), 0

        def given_out() -> Iterator[pd.DataFrame]:
            for at in range(0, total.shape[1], 1 << 17):
                part = at + np.flatnonzero(total[:, at:at + (1 << 17)].any(axis=0))
                yield pd.DataFrame({"slot": part.astype(np.int32), "zeros": total[0][part].astype(np.int64),
                                    "ones": total[1][part].astype(np.int64)})

        for frame in frames:
            key, n = frame["key"].to_numpy(np.int64).view(np.uint64), frame["n"].to_numpy(np.int64)
            large = n > MOST
            for one, slot in places(key[large]):  # counts that fit no slot go on by themselves
                yield pd.DataFrame({"slot": slot.astype(np.int32), "zeros": n[large] * (1 - one), "ones": n[large] * one})
            key, n = key[~large], n[~large]
            for at in range(0, len(key), 64):  # 64 counts of MOST stay below 2**32
                if held + int(n[at:].sum()) < 1 << 32:  # all the rest fits
                    for one, slot in places(key[at:]):
                        np.add.at(total, (one, slot), n[at:].astype(np.uint32))
                    held += int(n[at:].sum())
                    break
                if held + int(n[at:at + 64].sum()) >= 1 << 32:
                    yield from given_out()
                    total[:], held = 0, 0
                for one, slot in places(key[at:at + 64]):
                    np.add.at(total, (one, slot), n[at:at + 64].astype(np.uint32))
                held += int(n[at:at + 64].sum())
        yield from given_out()

    def odds(zeros: int, ones: int) -> Column:
        left = [F.greatest(F.col(c) - k, F.lit(0)) + 0.4 for c, k in (("ones", ones), ("zeros", zeros))]
        return F.greatest(F.lit(-127), F.least(F.lit(127), F.round(F.log(left[0] / left[1]) * STEP))).cast("tinyint")

    found = (counted.mapInPandas(spread, "slot int, zeros long, ones long").groupBy("slot")
             .agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
             .select("slot", *[odds(*k).alias(f"odds_{i}") for i, k in enumerate(less)])
             .toArrow())  # at most len(ORDERS) * 2**TABLE_BITS rows of a few bytes
    out = np.zeros((len(less), len(ORDERS) << TABLE_BITS), np.int8)
    for i in range(len(less)):
        out[i, found["slot"].to_numpy()] = found[f"odds_{i}"].to_numpy()
    return out.reshape(len(less), len(ORDERS), -1)


def inputs(odds: np.ndarray, contexts: np.ndarray, node: np.ndarray, bit: int,
           one: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(log odds of every predictor and a constant, weight set) of one decision. With ``one``,
    the bits decided, ``odds`` holds the tables without a zero and without a one."""
    place = slots_after(contexts, node)
    place += np.arange(len(ORDERS))[:, None] << TABLE_BITS
    if one is not None:
        place += one * (len(ORDERS) << TABLE_BITS)
    found = odds.reshape(-1).take(place)
    x = np.empty((len(node), len(ORDERS) + 1), np.float32)
    x[:, :-1] = found.T
    x[:, -1] = 0.3 * STEP
    x *= 1 / STEP
    gate = np.full(len(node), bit)
    for o in range(len(ORDERS)):
        np.copyto(gate, 8 * (o + 1) + bit, where=found[o] != 0)
    return x, gate


def cells(logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower cell of the map, weight of the upper one)."""
    place = (np.clip(logit, -REACH + 1e-3, REACH - 1e-3) + REACH) * ((CELLS - 1) / (2 * REACH))
    low = place.astype(np.int64)
    return low, place - low


def refined(chance: np.ndarray, logit: np.ndarray, before: np.ndarray, refine: np.ndarray) -> np.ndarray:
    """The mixer's probability averaged with the adaptive map's."""
    low, up = cells(logit)
    low += before * refine.shape[1]
    refine = refine.reshape(-1)
    return 0.5 * chance + 0.5 * (refine.take(low) * (1 - up) + refine.take(low + 1) * up)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def decisions(left: np.ndarray, weights: np.ndarray, key: np.ndarray
              ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(inputs, weight set, mixed log odds, bit) of the runs' eight decisions."""
    byte, contexts = key & np.uint64(255), stirred_contexts(key)
    for bit in range(8):
        one = ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)
        x, gate = inputs(left, contexts, (byte | np.uint64(256)) >> np.uint64(8 - bit), bit, one)
        yield x, gate, np.einsum("ij,ij->i", x, weights.take(gate, axis=0)), one


def slopes(left: np.ndarray, weights: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Gradient and curvature of the log likelihood for every weight set, runs counted n times."""
    out = np.zeros((SETS, INPUTS, INPUTS + 1))
    for x, gate, logit, one in decisions(left, weights, key):
        chance = sigmoid(logit)
        err, curve = n * (one - chance), n * chance * (1 - chance)
        for g in np.flatnonzero(np.bincount(gate, minlength=SETS)):
            of = np.flatnonzero(gate == g)
            mine = x.take(of, axis=0).astype(np.float64)
            out[g, :, :-1] += mine.T @ (mine * curve[of, None])
            out[g, :, -1] += mine.T @ err[of]
    return out.ravel()


def cell_counts(left: np.ndarray, weights: np.ndarray, key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Decisions and ones in every cell of the map, runs counted n times."""
    out = np.zeros((2, 256 * CELLS))
    before = ((key >> np.uint64(8)) & np.uint64(255)).astype(np.int64) * CELLS
    for _, _, logit, one in decisions(left, weights, key):
        low, up = cells(logit)
        for cell, share in ((low, 1 - up), (low + 1, up)):
            out[0] += np.bincount(before + cell, n * share, out.shape[1])
            out[1] += np.bincount(before + cell, n * share * one, out.shape[1])
    return out.ravel()


def learned(total: Callable[[Callable, np.ndarray, int], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(mixing weights, adaptive map) from sums over all runs: ``total`` gives those of a
    function under given weights. Rounding keeps the order of adding out of the model."""
    weights = np.full((SETS, INPUTS), 0.3, np.float32)
    for _ in range(STEPS):
        sums = total(slopes, weights, SETS * INPUTS * (INPUTS + 1)).reshape(SETS, INPUTS, INPUTS + 1)
        curve = np.tril(sums[:, :, :-1])
        curve = curve + np.tril(curve, -1).transpose(0, 2, 1) + np.eye(INPUTS)  # drawn to 0.3 where little is known
        step = np.linalg.solve(curve, (sums[:, :, -1] - (weights - 0.3))[:, :, None])[:, :, 0]
        weights = np.round(weights + np.clip(step, -1, 1), 4).astype(np.float32)
    decided, ones = total(cell_counts, weights, 2 * 256 * CELLS).reshape(2, 256, CELLS)
    refine = (ones + FIRM * sigmoid(np.linspace(-REACH, REACH, CELLS))) / (decided + FIRM)
    return weights, np.clip(np.round(refine, 6), 1e-5, 1 - 1e-5)


def fit(odds: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(mixing weights, adaptive map) for tables that do not hold the texts' own counts."""
    key, n = np.unique(np.concatenate([runs(block)[0] for _, block in word_blocks(texts)]), return_counts=True)
    left = np.stack([odds, odds])
    return learned(lambda of, weights, _: of(left, weights, key, n))


def fit_counted(left: np.ndarray, counted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(mixing weights, adaptive map) over all counted runs, for tables without a zero and
    without a one."""
    context = counted.sparkSession.sparkContext
    tables = context.broadcast(left)

    def total(of: Callable, weights: np.ndarray, size: int) -> np.ndarray:
        def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            sums = np.zeros(size)
            for frame in frames:
                sums += of(tables.value, weights, frame["key"].to_numpy(np.int64).view(np.uint64),
                           frame["n"].to_numpy(np.int64))
            at = np.flatnonzero(sums)
            yield pd.DataFrame({"place": at.astype(np.int32), "value": sums[at]})

        found = (counted.mapInPandas(add, "place int, value double").groupBy("place")
                 .agg(F.sum("value").alias("value")).toArrow())  # at most ``size`` rows
        out = np.zeros(size)
        out[found["place"].to_numpy()] = found["value"].to_numpy()
        return out

    found = learned(total)
    tables.unpersist()
    return found


class Scorer:
    """log10 probability of runs of bytes, with a direct-mapped cache of fixed size."""

    def __init__(self, odds: np.ndarray, weights: np.ndarray, refine: np.ndarray):
        self.odds, self.weights, self.refine = odds, weights, refine
        self.keys = np.full(1 << CACHE_BITS, ~np.uint64(0))  # no run: a run has seven bytes
        self.values = np.zeros(1 << CACHE_BITS)

    def evaluate(self, key: np.ndarray) -> np.ndarray:
        out = np.ones(len(key))  # eight factors of 5e-6 or more: no underflow
        byte, before = key & np.uint64(255), ((key >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
        contexts = stirred_contexts(key)
        for bit in range(8):
            node = (byte | np.uint64(256)) >> np.uint64(8 - bit)
            x, gate = inputs(self.odds, contexts, node, bit)
            logit = np.einsum("ij,ij->i", x, self.weights.take(gate, axis=0))
            chance = refined(sigmoid(logit), logit, before, self.refine)
            out *= np.where((byte >> np.uint64(7 - bit)) & np.uint64(1), chance, 1 - chance)
        return np.log10(out)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        at = ((key * M1) >> np.uint64(64 - CACHE_BITS)).view(np.int64)
        out = self.values.take(at)
        missing = np.flatnonzero(self.keys.take(at) != key)
        if len(missing):
            new, place = np.unique(key[missing], return_inverse=True)
            value = np.concatenate([self.evaluate(new[i:i + 16384]) for i in range(0, len(new), 16384)])
            out[missing] = value[place]
            where = ((new * M1) >> np.uint64(64 - CACHE_BITS)).view(np.int64)
            kept = np.unique(where, return_index=True)[1]  # one key a slot
            self.keys[where[kept]], self.values[where[kept]] = new[kept], value[kept]
        return out


def trained(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(predictor tables, mixing weights, adaptive map) from all training rows of ``docs``."""
    learn = docs.where(fold(F.col("doc_id"), MODULUS) != HELD_OUT)
    counted = stored(tallied(learn, words=False), "runs")
    odds = slot_odds(counted, [(0, 0), (1, 0), (0, 1)])
    weights, refine = fit_counted(odds[1:], counted)
    return odds[0], weights, refine


def scored(docs: DataFrame, frequent: int = 1 << 18) -> DataFrame:
    """The contract's columns and n_bytes, bits_per_byte for every row of ``docs``."""
    context = docs.sparkSession.sparkContext
    train = docs.where(fold(F.col("doc_id"), MODULUS) != HELD_OUT)
    vocabulary = stored(tallied(train, words=True), "words")
    tokens, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    head = vocabulary.orderBy(F.desc("n"), "key").limit(frequent).toArrow()
    key = head["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    model = context.broadcast((*trained(docs), key[order], head["n"].to_numpy()[order]))

    @F.pandas_udf("n_tokens long, n_known long, logs double, score double, n_bytes long, "
                  "rare array<long>, times array<long>")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        odds, weights, refine, known, count = model.value
        scorer, hasher = Scorer(odds, weights, refine), WordHasher()
        logs = np.log10(count + 1.0)
        for texts in parts:
            rows = []
            for _, block in word_blocks(texts.tolist()):
                runs_of, sizes = runs(block)
                sums = np.add.reduceat(scorer(runs_of), np.cumsum(sizes) - sizes)
                hashes, start, _ = hasher(np.frombuffer(b"\n".join(block), np.uint8))
                edge = np.cumsum(np.fromiter(map(len, block), np.int64, len(block)) + 1)
                first = np.searchsorted(start, np.concatenate(([0], edge)))
                at = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
                value = np.where(hit, logs[at], 0.0) if len(known) else np.zeros(len(hashes))
                ends = np.searchsorted(known, np.uint64(END_WORD))
                has_end = ends < len(known) and known[ends] == END_WORD
                for t in range(len(block)):
                    mine = slice(first[t], first[t + 1])
                    rare, times = np.unique(hashes[mine][~hit[mine]], return_counts=True)
                    if not has_end:  # the end's count is then looked up like a rare word's
                        rare, times = np.append(rare, np.uint64(END_WORD)), np.append(times, 1)
                    rows.append((first[t + 1] - first[t] + 1, int(hit[mine].sum()) + int(has_end),
                                 value[mine].sum() + (logs[ends] if has_end else 0.0), sums[t], int(sizes[t]),
                                 rare.view(np.int64), times))
            yield pd.DataFrame(rows, columns=["n_tokens", "n_known", "logs", "score", "n_bytes", "rare", "times"])

    rows = stored(docs.select("doc_id", score("text").alias("s")).select("doc_id", "s.*")
                  .withColumn("row_id", F.monotonically_increasing_id()), "scores")
    met = (rows.select("row_id", F.inline(F.arrays_zip("rare", "times"))).withColumnRenamed("rare", "key")
           .join(vocabulary, "key").groupBy("row_id")
           .agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("more_logs"), F.sum("times").alias("more_known")))
    each = F.log10(F.lit(float(tokens + distinct + 1)))
    return (rows.drop("rare", "times").join(met, "row_id", "left")
            .select("doc_id", (fold(F.col("doc_id"), MODULUS) == HELD_OUT).alias("held_out"), "n_tokens",
                    (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
                    F.lit(tokens).cast("long").alias("train_tokens"),
                    (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * each).alias("base_score"),
                    "score", "n_bytes", (-F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes")).alias("bits_per_byte")))


def op3_lm_score(spark, sf_dir: str) -> DataFrame:
    """Scores of every row of ``documents``."""
    return scored(table(spark, sf_dir, "documents"))
