"""Faults found in earlier rounds: bounded samples, word bounds of IBANs, blank benchmark items,
fingerprints dealt out before their balls."""

from __future__ import annotations

import math
import os
import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import common, decontaminate, langid, lm, pii, simhash, toxicity

from .conftest import documents


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("per_class", [5, 2000, 10_000])
def test_sample_is_the_rows_of_least_hash(spark, per_class):
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 50 == 0, 1).when(F.col("id") % 50 == 1, F.lit(None))
                                      .otherwise(0).alias("label"))
    sample = common.sample_per_class(rows, "label", per_class, F.col("id"))
    got = sample.collect()
    hashed = rows.select("id", "label", F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string")), 11).alias("h")).collect()
    for label in (0, 1, None):
        want = sorted((r.h, str(r.id)) for r in hashed if r.label == label)[:per_class]
        assert sorted(str(r.id) for r in got if r.label == label) == sorted(i for _, i in want)


def test_no_task_ranks_a_class(spark):
    """At a bound of 10,000 the windows see slots and the rows of one slot, not the class."""
    rows = spark.range(400_000).select("id", F.lit(0).alias("label"))
    sample = common.sample_per_class(rows, "label", 10_000, F.col("id"))
    text = sample._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [i for i, x in enumerate(text) if "Window [" in x]
    assert windows
    for i in windows:
        below = next(x for x in text[i + 1:] if "Aggregate [" in x or "Join Inner" in x)
        # either the counts of the slots, or the rows joined to the slot at the border
        assert "_slot" in below, below
    assert sample.count() == 10_000


def test_sample_keeps_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([], "id long, label int")
    assert common.sample_per_class(rows, "label", 3, F.col("id")).columns == ["id", "label"]
    assert common.sample_per_class(rows, "label", 3, F.col("id")).count() == 0


IBANS = {
    "GB82 WEST 1234 5698 7654 32 PLEASE PAY": (0, 27), "pay DE89370400440532013000 NOW": (4, 26),
    "XDE89370400440532013000": None, "DE89370400440532013000X": None, "DE89370400440532013001": None,
    "bank: NO93 8601 1117 947": (6, 24), "DE8937040044053201300": None, "ZZ89370400440532013000": None,
}


def test_iban_ends_where_its_country_says(spark):
    got = {r.doc_id: r.spans for r in pii.personal_data(documents(spark, list(IBANS))).collect()}
    for i, (text, span) in enumerate(IBANS.items()):
        found = [s for s in got[i].split(",") if s.startswith("iban")]
        assert found == ([f"iban:{span[0]}:{span[1]}"] if span else []), text


def test_context_words_are_whole_words(spark):
    iban = "DE89370400440532013000"
    got = [r.scored for r in pii.personal_data(documents(spark, [f"apartment {iban}", f"part {iban}", f"bank {iban}"]))
           .orderBy("doc_id").collect()]
    assert [s.rsplit(":", 1)[-1] if "iban" in s else None for s in got] == ["70", None, "80"]


def test_many_matches_in_one_text(spark):
    text = " ".join(f"10.0.{i % 200}.{i % 250}" for i in range(30_000))
    row = pii.personal_data(documents(spark, [text])).collect()[0]
    assert row.n_ip == 30_000
    last = row.spans.rsplit(",", 1)[-1].split(":")
    assert int(last[2]) == len(text) and text[int(last[1]):] == "10.0.199.249"


def test_blank_benchmark_items_are_never_found(spark):
    items = spark.createDataFrame([(1, "\n\t"), (2, ""), (3, None), (4, " \x0b ")], "item_id long, text string")
    docs = documents(spark, ["some words of a text " * 20, None, "\n\t"])
    assert decontaminate.uncontaminated(docs, items).count() == 3


def test_fingerprints_are_dealt_out_before_their_balls(spark):
    marked = documents(spark, ["a"]).select(F.xxhash64("doc_id").alias("fp")).groupBy("fp").agg(F.count("*").alias("n"))
    assert "RoundRobinPartitioning" in plan(simhash.colliding_pairs(marked.select("fp"), 2))


@pytest.mark.parametrize("most", [1 << 25, 3])
def test_predictor_counts_are_whole_numbers(spark, monkeypatch, most):
    """Counts beyond what a slot of a task holds, and many small ones, against exact sums."""
    monkeypatch.setattr(lm, "MOST", most)
    monkeypatch.setattr(lm, "TABLE_BITS", 10)
    rng = random.Random(1)
    rows = [(rng.randrange(1 << 56), rng.choice([1, 2, 1 << 24, (1 << 25) - 1, 1 << 33])) for _ in range(700)]
    odds = lm.predictor_tables(spark.createDataFrame(rows, "key long, n long").coalesce(1))
    key, n = np.array([k for k, _ in rows], np.uint64), [c for _, c in rows]
    byte = key & np.uint64(255)
    for o, context in enumerate(lm.order_hashes(key)):
        sums = [[0, 0] for _ in range(1 << 10)]
        for bit in range(8):
            node = (byte | np.uint64(256)) >> np.uint64(8 - bit)
            for slot, b, c in zip(lm.slots(context, node).tolist(), byte.tolist(), n):
                sums[slot][b >> (7 - bit) & 1] += c
        for slot, (zeros, ones) in enumerate(sums):
            want = max(-127, min(127, round(math.log((ones + 0.4) / (zeros + 0.4)) * lm.STEP))) if zeros + ones else 0
            assert abs(int(odds[o][slot]) - want) <= (abs(math.log((ones + 0.4) / (zeros + 0.4)) * lm.STEP % 1 - 0.5) < 1e-6)


def test_languages_learned_are_bounded(spark):
    rows = [(i, f"wort wort{i % 3} satz", f"l{i % 7}" if i % 2 else "de") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, max_languages=3, max_rows=30)
    assert len(model.languages) == 3 and "de" in model.languages
    assert langid.train(docs, per_language=5).languages == sorted({r[2] for r in rows})


@pytest.mark.parametrize("seed", [1, 2])
def test_codeword_decoding_against_brute_force(spark, seed):
    """Each bit's loss weighted by its trust; the least sum wins, its share is the score."""
    rng = np.random.default_rng(seed)
    n = 3 + seed * 3
    code = langid.codewords(n)
    bits = code.shape[1]
    model = langid.LanguageModel([f"l{i}" for i in range(n)], code, rng.normal(0, 40, (bits, 1 << langid.BITS)).astype(np.float32),
                                 rng.normal(0, 1, bits).astype(np.float32), rng.dirichlet(np.ones(bits), n).astype(np.float32))
    texts = ["ein kurzer satz", "Another ONE", "x", "é" * 30, "le chat noir " * 40]
    best, score, doubt = langid.identify(model, texts)
    for t, text in enumerate(texts):
        margin, total = np.zeros(bits), 0
        for block in common.char_blocks([text.lower()], max(langid.SIZES)):
            for _, bucket, valid in block.ngrams(langid.SIZES, langid.BITS, inside_words=False):
                for b in bucket[valid].tolist():
                    margin += model.weight[:, b]
                    total += 1
        margin = margin / total + model.bias
        loss = [sum(float(model.trust[k][b]) * math.log1p(math.exp(-float(margin[b] * code[k][b]))) if margin[b] * code[k][b] > -500
                    else float(model.trust[k][b]) * -float(margin[b] * code[k][b]) for b in range(bits)) for k in range(n)]
        power = [math.exp(-2.0 * bits * (x - min(loss))) for x in loss]
        assert best[t] == int(np.argmin(loss))
        assert abs(score[t] - max(power) / sum(power)) < 1e-3
        assert doubt[t] == (sorted(power)[-1] - sorted(power)[-2] < 0.2 * sum(power)) or abs(
            (sorted(power)[-1] - sorted(power)[-2]) / sum(power) - 0.2) < 1e-3


def test_toxicity_score_against_brute_force():
    rng = np.random.default_rng(3)
    size = 1 << toxicity.BITS
    model = toxicity.ToxicityModel(rng.normal(0, 1, size).astype(np.float32), rng.random(size).astype(np.float32), -0.3, 10.0)
    texts = ["you vile creature", "a", "", None, "many plain words " * 30]
    for text, got in zip(texts, toxicity.score_texts(model, texts)):
        top = weight = 0.0
        for block in common.char_blocks([text], max(toxicity.SIZES)):
            for _, bucket, valid in block.ngrams(toxicity.SIZES, toxicity.BITS, inside_words=True):
                for b in bucket[valid].tolist():
                    top, weight = top + float(model.top[b]), weight + float(model.weight[b])
        assert abs(got - 1 / (1 + math.exp(-(model.bias + top / (weight + model.pad))))) < 1e-6


def test_ngram_buckets_against_brute_force():
    """Rolling hash, mixing and the rule for spaces, one n-gram at a time."""
    text, bits = "ab cé d", 12
    padded = f" {text} "
    (block,) = common.char_blocks([text], 3)
    for n, bucket, valid in block.ngrams((1, 2, 3), bits, inside_words=True):
        for at in range(len(padded)):
            part = padded[at:at + n]
            inner = any(c <= " " for c in part[1:-1])
            assert bool(valid[at]) == (len(part) == n and not inner)
            if len(part) == n:
                rolled = 0
                for c in part:
                    rolled = (rolled * int(common.ROLL32) + ord(c)) % (1 << 32)
                mixed = (rolled + n) * int(common.MIX32) % (1 << 32)
                mixed ^= mixed >> 15
                assert bucket[at] == (mixed * (int(common.ROLL32) * int(common.MIX32) % (1 << 32)) % (1 << 32)) >> (32 - bits)


def test_stored_folders_can_be_dropped(spark):
    kept = common.stored(spark.range(5), "kept")
    folder = os.path.dirname(common._folders[-1]).removeprefix("file:")
    assert kept.count() == 5 and os.path.isdir(common._folders[-1].removeprefix("file:"))
    before = list(common._folders)
    assert common.drop_stored(spark) == len(before) > 0
    assert not any(os.path.exists(f.removeprefix("file:")) for f in before) and os.path.isdir(folder)
    assert common.drop_stored(spark) == 0


def test_language_model_learns_from_every_training_row(spark, monkeypatch):
    """Counts, weights and map against sums over all training texts, long ones too; with the
    sample, rows outside it (or longer than its bound) did not reach weights and map."""
    monkeypatch.setattr(lm, "TABLE_BITS", 12)
    rng = random.Random(5)
    texts = ["".join(rng.choice("abc  ") for _ in range(rng.choice([3, 50, 400]))) for _ in range(60)] + ["abab " * 5000, "", None]
    docs = documents(spark, texts).repartition(7)
    odds, weights, refine = lm.trained(docs)
    mine = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2]
    key, n = np.unique(np.concatenate([lm.runs(block)[0] for _, block in lm.word_blocks(mine)]), return_counts=True)
    counted = spark.createDataFrame([(int(k), int(c)) for k, c in zip(key, n)], "key long, n long")
    assert np.array_equal(odds, lm.predictor_tables(counted))
    left = lm.slot_odds(counted, [(1, 0), (0, 1)])
    want_weights, want_refine = lm.learned(lambda of, w, _: of(left, w, key, n))
    assert np.allclose(weights, want_weights, atol=2e-4) and np.allclose(refine, want_refine, atol=2e-3)
    for count in (lm.slopes, lm.cell_counts):  # counting a run n times is the same as repeating it
        assert np.allclose(count(left, weights, key, n), count(left, weights, np.repeat(key, n), np.ones(n.sum(), np.int64)))


def test_toxicity_training_holds_its_bags_once():
    """The caller's frame kept every bag while the filtered copies were trained on."""
    rng = np.random.default_rng(5)
    size = rng.integers(1, 4000, 3000)
    bucket, count = (rng.integers(1, high, size.sum()).astype(np.int32) for high in (1 << toxicity.BITS, 5))
    label = np.arange(3000) % 2
    args = (label, size, bucket.copy(), count.copy())
    tracemalloc.start()
    model = toxicity.fit(*args, {0: 1500, 1: 1500}, epochs=1, steps=1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < bucket.nbytes + count.nbytes  # the copies alone were as much
    kept = np.bincount(bucket, minlength=1 << toxicity.BITS) > 0
    assert not model.weight[~kept].any() and np.abs(model.top).sum() > 0


def test_language_model_evaluates_frequent_runs_once():
    """A task met 1.5 million distinct runs again and again; a cache of 2**20 forgot most of them."""
    odds = np.zeros((len(lm.ORDERS), 1 << lm.TABLE_BITS), np.int8)
    scorer = lm.Scorer(odds, *lm.fit(odds, ["a text"]))
    asked = []
    scorer.evaluate = lambda key: asked.append(len(key)) or key.astype(np.float64)
    key = np.random.default_rng(3).integers(0, 1 << 56, 1_500_000).astype(np.uint64)
    for _ in range(2):
        assert np.array_equal(np.concatenate([scorer(k) for k in np.split(key, 10)]), key.astype(np.float64))
    assert sum(asked) < 2_000_000


def test_run_of_zero_bytes_is_no_empty_cache_slot():
    odds = np.zeros((len(lm.ORDERS), 1 << lm.TABLE_BITS), np.int8)
    scorer = lm.Scorer(odds, *lm.fit(odds, ["a text"]))
    zero = np.zeros(1, np.uint64)
    assert scorer(zero)[0] == scorer.evaluate(zero)[0] < 0


def test_tally_gives_out_few_rows_more_than_it_has_numbers():
    """Pieces that share most of their numbers were given out each by itself."""
    rng = np.random.default_rng(4)
    pieces = [rng.integers(0, 1 << 20, 400_000).astype(np.uint64) for _ in range(12)]
    tally = lm.Tally()
    rows = pd.concat([f for p in pieces for f in tally.add(p)] + list(tally.given_out()))
    key, n = np.unique(np.concatenate(pieces), return_counts=True)
    assert len(rows) < 2 * len(key)
    assert rows.groupby("key")["n"].sum().to_dict() == dict(zip(key.tolist(), n.tolist()))


def test_slopes_against_plain_sums(monkeypatch):
    monkeypatch.setattr(lm, "TABLE_BITS", 12)
    rng = np.random.default_rng(6)
    left = rng.integers(-20, 20, (2, len(lm.ORDERS), 1 << 12)).astype(np.int8) * (rng.random((2, len(lm.ORDERS), 1 << 12)) < 0.6)
    left = left.astype(np.int8)
    weights = rng.normal(0.3, 0.2, (lm.SETS, lm.INPUTS)).astype(np.float32)
    key, n = rng.integers(0, 1 << 56, 500).astype(np.uint64), rng.integers(1, 9, 500)
    want = np.zeros((lm.SETS, lm.INPUTS, lm.INPUTS + 1))
    for k, times in zip(key, n):
        byte = int(k) & 255
        for bit in range(8):
            node, one = (byte | 256) >> 8 - bit, byte >> 7 - bit & 1
            x, longest = [], 0
            for o, context in enumerate(lm.order_hashes(np.array([k]))):
                odds = int(left[one, o, lm.slots(context, np.array([node], np.uint64))[0]])
                x, longest = x + [odds / lm.STEP], o + 1 if odds else longest
            x = np.array(x + [0.3])
            chance = 1 / (1 + np.exp(-(x @ weights[longest * 8 + bit])))
            want[longest * 8 + bit, :, :-1] += times * chance * (1 - chance) * np.outer(x, x)
            want[longest * 8 + bit, :, -1] += times * (one - chance) * x
    got = lm.slopes(left, weights, key, n).reshape(want.shape)
    assert np.allclose(np.tril(got[:, :, :-1]), np.tril(want[:, :, :-1]), atol=1e-4) and np.allclose(got[:, :, -1], want[:, :, -1], atol=1e-4)
