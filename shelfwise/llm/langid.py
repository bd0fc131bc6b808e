"""Language identification by error-correcting output coding.

Every language has a codeword of +1 / -1 bits. One binary logistic classifier on hashed
character n-grams predicts each bit; all read the same n-gram averages. A text gets the
language whose codeword has the least loss, each bit's logistic loss weighted by how often
its classifier was right on that language (loss-weighted decoding). The score is the
share of the best codeword in exp(-loss); a small lead over the second flags the text as
ambiguous. Up to seven languages use the exhaustive code, more use a seeded random code
of 10 * log2(languages) bits with the widest distance of several drawn.

Defined results: a null text and a text without a letter give ``und`` with score 0.0, as
does everything if no labelled row exists. Texts are read whole, long ones in parts. Ties
go to the language first in the alphabet. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import char_blocks, first_per_class, fold, table

SIZES = (1, 2, 3)
BITS = 14
HELD_OUT_FOLDS = 5
RESULT = "struct<lang:string,score:double,ambiguous:boolean>"


@dataclass
class LanguageModel:
    """Codewords (languages x bits), bit classifiers (bits x buckets, bits) and the weight
    of each bit for each language."""

    languages: list[str]
    code: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n distinct codewords of +1 / -1 bits, no bit the same for all when n > 1."""
    if n <= 7:
        bits = max(1, 2 ** (n - 1) - 1)
        rows = [[1] * bits] + [[1 if (b + 1) >> (n - 1 - r) & 1 else -1 for b in range(bits)] for r in range(1, n)]
        # the first word is all +1; the others run through every split of the languages
        return np.array([rows[0]] + [[-x for x in row] for row in rows[1:]], dtype=np.float32)
    rng, best, widest = np.random.default_rng(seed), None, -1
    for _ in range(20):
        code = rng.choice([-1.0, 1.0], size=(n, int(np.ceil(10 * np.log2(n))))).astype(np.float32)
        apart = code.shape[1] - code @ code.T
        np.fill_diagonal(apart, np.inf)
        if apart.min() > widest:
            best, widest = code, apart.min()
    return best


def bags(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, share of the n-grams) of each text."""
    counts = np.zeros((len(texts), 1 << BITS), np.float32)
    for block in char_blocks([(t or "").lower() for t in texts], max(SIZES)):
        for _, bucket, valid in block.ngrams(SIZES, BITS, inside_words=False):
            for p, (s, e) in enumerate(zip(block.start.tolist(), block.end.tolist())):
                counts[block.doc[p]] += np.bincount(bucket[s:e][valid[s:e]], minlength=1 << BITS)
    for row in counts:
        some = np.flatnonzero(row)
        yield some, row[some] / max(1.0, row.sum())


def train(docs: DataFrame, per_language: int = 500, max_languages: int = 200, max_rows: int = 10_000,
          epochs: int = 40, rate: float = 2.0) -> LanguageModel | None:
    """Fit on at most ``per_language`` training rows of each of the ``max_languages`` most
    frequent languages, ``max_rows`` in all (the documented bounds); bags are made on the
    executors, the joint fit of all bits is numpy."""

    def to_bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at:at + 256]
                found = list(bags(part["text"].tolist()))
                yield pd.DataFrame({"lang": part["lang"].tolist(),
                                    "bucket": [b.astype(np.int32).tobytes() for b, _ in found],
                                    "share": [s.astype(np.float32).tobytes() for _, s in found]})

    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
                          & (fold(F.col("doc_id"), HELD_OUT_FOLDS) != 0)).select("doc_id", "lang", "text")
    # at most max_languages short values: small enough to send to every task
    frequent = (docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), HELD_OUT_FOLDS) != 0))
                .groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).select("lang"))
    names = [r["lang"] for r in frequent.collect()]
    labelled = labelled.where(F.col("lang").isin(names))
    per_language = min(per_language, max(1, max_rows // max(1, len(names))))
    # the sample is drawn on short rows; the texts of the chosen rows follow
    chosen = first_per_class(labelled.select("doc_id", "lang"), "lang", per_language, F.col("doc_id"))
    texts = labelled.join(F.broadcast(chosen.distinct()), ["doc_id", "lang"])
    rows = (first_per_class(texts, "lang", per_language, F.concat_ws(" ", "doc_id", F.xxhash64("text")))
            .select("lang", "text").mapInPandas(to_bags, "lang string, bucket binary, share binary").toArrow().to_pandas())
    if rows.empty:
        return None
    rows = rows.sort_values(["lang", "bucket", "share"], kind="stable")
    languages = sorted(rows["lang"].unique())
    truth = np.searchsorted(languages, rows["lang"].to_numpy().astype(str))
    bucket = [np.frombuffer(x, np.int32) for x in rows["bucket"]]
    at_bucket, a = np.concatenate(bucket), np.concatenate([np.frombuffer(x, np.float32) for x in rows["share"]])
    row = np.repeat(np.arange(len(rows)), [len(b) for b in bucket])
    code = codewords(len(languages))
    target = code[truth]
    even = (len(rows) / (len(languages) * np.bincount(truth, minlength=len(languages))))[truth] / len(rows)
    weight, bias = np.zeros((code.shape[1], 1 << BITS), np.float32), np.zeros(code.shape[1], np.float32)
    margin = np.zeros_like(target)
    for b in range(code.shape[1]):
        seen, seen_bias = np.full(1 << BITS, 1e-8, np.float32), 1e-8
        for step in range(epochs + 1):
            margin[:, b] = np.bincount(row, weight[b][at_bucket] * a, len(rows)) + bias[b]
            if step == epochs:
                break
            err = -target[:, b] * even / (1 + np.exp(np.clip(target[:, b] * margin[:, b], -50, 50)))
            grad = np.bincount(at_bucket, err[row] * a, 1 << BITS).astype(np.float32)
            seen += grad ** 2
            weight[b] -= rate * grad / np.sqrt(seen)
            seen_bias += float(err.sum()) ** 2
            bias[b] -= 0.1 * float(err.sum()) / np.sqrt(seen_bias)
    right = margin * target > 0
    trust = np.stack([right[truth == k].mean(axis=0) for k in range(len(languages))]) + 1e-3
    return LanguageModel(languages, code, weight, bias, (trust / trust.sum(axis=1, keepdims=True)).astype(np.float32))


def identify(model: LanguageModel, texts: list[str | None], sharpness: float = 2.0, lead: float = 0.2
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, score, ambiguous) of each text."""
    bits = len(model.bias)
    total, margin = np.zeros(len(texts)), np.zeros((bits, len(texts)))
    for block in char_blocks([(t or "").lower() for t in texts], max(SIZES)):
        for _, bucket, valid in block.ngrams(SIZES, BITS, inside_words=False):
            block.sums(valid, total)
            for b in range(bits):
                block.sums(model.weight[b][bucket] * valid, margin[b])
    margin = (margin / np.maximum(total, 1.0)).T + model.bias
    loss = np.logaddexp(0, -margin[:, None, :] * model.code[None]) * model.trust[None]
    power = -sharpness * bits * loss.sum(axis=2)
    power = np.exp(power - power.max(axis=1, keepdims=True))
    share = power / power.sum(axis=1, keepdims=True)
    best = share.argmax(axis=1)
    ranked = np.sort(share, axis=1)
    second = ranked[:, -2] if share.shape[1] > 1 else np.zeros(len(texts))
    return best, ranked[:, -1], ranked[:, -1] - second < lead


def identifier(docs: DataFrame, model: LanguageModel | None) -> Callable[[str], Column]:
    """Column function: struct of lang, score and ambiguous for a text column."""
    unknown = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    if model is None:
        return lambda text: unknown
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.languages, model.code, model.weight, model.bias, model.trust))

    @F.pandas_udf(RESULT)
    def language(text: pd.Series) -> pd.DataFrame:
        model = LanguageModel(*shared.value)
        best, score, doubt = identify(model, text.tolist())
        return pd.DataFrame({"lang": np.array(model.languages, dtype=object)[best], "score": score, "ambiguous": doubt})

    return lambda text: F.when(F.coalesce(F.col(text), F.lit("")).rlike(r"\p{L}"), language(text)).otherwise(unknown)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous for every row of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    found = identifier(docs, train(docs))("text")
    return (docs.select("doc_id", (fold(F.col("doc_id"), HELD_OUT_FOLDS) == 0).alias("held_out"), found.alias("found"))
            .select("doc_id", "held_out", F.col("found.lang").alias("lang_pred"), "found.score", "found.ambiguous"))
