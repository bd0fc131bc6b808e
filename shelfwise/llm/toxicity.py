"""Toxicity: character n-gram embeddings, averaged, under a linear softmax.

A text is a bag of character n-grams of its words (word edges included). Each n-gram has
a row in one hashed embedding table; the rows are averaged with smooth-inverse-frequency
weights a / (a + p), and a linear softmax reads the average. Table and softmax are trained
jointly in numpy on a bounded sample of labelled rows. A misspelling that was never seen
shares most n-grams with the right spelling, so it lands near it. For scoring, the product
of table and softmax is one number per n-gram, so a text costs two table reads per n-gram.

N-grams in fewer than ``least`` sampled texts have no weight: their rows would be noise.
An all-zero padding row of weight ``pad`` belongs to every bag, so one odd n-gram cannot
decide a text of a few characters, and the bias follows the class shares of all labelled
training rows, not those of the sample.

Defined results: a null text counts as empty; an empty text scores as the prior (the
softmax bias); without labelled rows every score is 0.0. Very long texts are read whole,
in parts. Repeated rows score alike; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import char_blocks, fold, sample_per_class, table

SIZES = (3, 4, 5)
BITS = 17
HELD_OUT_FOLDS = 5


@dataclass
class ToxicityModel:
    """``top[b]`` = weight * (logit of class 1 minus class 0) of bucket b, ``weight[b]``
    its smooth-inverse-frequency weight, ``bias`` the difference of the biases."""

    top: np.ndarray
    weight: np.ndarray
    bias: float
    pad: float = 0.0


def bags(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, counts) of each text, in order."""
    parts: dict[int, list[np.ndarray]] = {i: [] for i in range(len(texts))}
    for block in char_blocks(texts, max(SIZES)):
        found = list(block.ngrams(SIZES, BITS, inside_words=True))
        for p, (s, e) in enumerate(zip(block.start.tolist(), block.end.tolist())):
            parts[int(block.doc[p])] += [bucket[s:e][valid[s:e]] for _, bucket, valid in found]
    for i in range(len(texts)):
        yield np.unique(np.concatenate(parts.pop(i)), return_counts=True)


def training_labels(labels: DataFrame) -> DataFrame:
    """One (doc_id, label) per labelled document outside the held-out fold; a document with
    both labels counts as toxic."""
    return (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
            .where(fold(F.col("doc_id"), HELD_OUT_FOLDS) != 0)
            .groupBy("doc_id").agg(F.max("toxic").alias("label")))


def labelled_sample(docs: DataFrame, marked: DataFrame, per_class: int) -> DataFrame:
    """At most ``per_class`` rows (text, label) of each class of ``marked``; of several rows with
    one doc_id the least text stands for it."""
    chosen = sample_per_class(marked, "label", per_class, F.col("doc_id"))
    # at most 2 * per_class rows of two numbers: small enough to send to every task
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("one")).select("one.text", "one.label")


def train(docs: DataFrame, labels: DataFrame, per_class: int = 4000, **options) -> ToxicityModel:
    """Fit on at most ``per_class`` rows of each class (the documented bound). The n-gram
    bags are made on all executors; one task trains on the bounded sample, so the driver
    only gets the model."""

    def to_bags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = list(bags(frame["text"].tolist()))
            yield pd.DataFrame({"label": frame["label"], "bucket": [b.astype(np.int32).tobytes() for b, _ in found],
                                "n": [c.astype(np.int32).tobytes() for _, c in found]})

    marked = training_labels(labels)
    shares = {r["label"]: r["count"] for r in marked.groupBy("label").count().collect()}  # two rows

    def to_model(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        label, size, bucket, n = [], [], [], []
        for frame in frames:  # every batch's bags become a few arrays at once
            label.append(frame["label"].to_numpy())
            size.append(frame["bucket"].map(len).to_numpy(np.int64) // 4)
            bucket.append(np.frombuffer(b"".join(frame["bucket"]), np.int32))
            n.append(np.frombuffer(b"".join(frame["n"]), np.int32))
        if sum(map(len, label)):
            model = fit(*map(joined, (label, size, bucket, n)), shares, **options)
            yield pd.DataFrame({"top": [model.top.tobytes()], "weight": [model.weight.tobytes()],
                                "bias": [model.bias], "pad": [model.pad]})

    found = (labelled_sample(docs, marked, per_class).mapInPandas(to_bags, "label int, bucket binary, n binary")
             .repartition(1).sortWithinPartitions("label", "bucket", "n")
             .mapInPandas(to_model, "top binary, weight binary, bias double, pad double").collect())
    if not found:
        return ToxicityModel(np.zeros(1 << BITS, np.float32), np.ones(1 << BITS, np.float32), -np.inf)
    return ToxicityModel(np.frombuffer(found[0]["top"], np.float32), np.frombuffer(found[0]["weight"], np.float32),
                         found[0]["bias"], found[0]["pad"])


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """The arrays as one; the list is emptied, so that they are not held twice."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def fit(label: np.ndarray, size: np.ndarray, bucket: np.ndarray, count: np.ndarray, shares: dict[int, int], dim: int = 8, epochs: int = 10, steps: int = 400, batch: int = 64,
        rate: float = 0.5, smooth: float = 1e-4, pad: float = 10.0, least: int = 3, seed: int = 7) -> ToxicityModel:
    """Train table and softmax jointly on bags, ``epochs`` times and for ``steps`` batches at
    least: bag i has ``label[i]`` and the next ``size[i]`` entries of ``bucket`` and ``count``,
    which are overwritten. ``shares`` counts the labelled rows of each class."""
    ends = np.cumsum(size)
    total, in_docs = np.zeros(1 << BITS), np.zeros(1 << BITS, np.int64)
    for lo, hi in zip((ends - size).tolist(), ends.tolist()):
        total[bucket[lo:hi]] += count[lo:hi]
        in_docs[bucket[lo:hi]] += 1
    weight = (smooth / (smooth + total / max(1.0, total.sum())) * (in_docs >= least)).astype(np.float32)
    share, edge = count.view(np.float32), [0]  # in the counts' place
    for lo, hi in zip((ends - size).tolist(), ends.tolist()):
        b = bucket[lo:hi]
        kept = weight[b] > 0
        b = b[kept]
        w = weight[b] * count[lo:hi][kept].astype(np.float32)
        edge.append(edge[-1] + len(b))
        bucket[edge[-2]:edge[-1]], share[edge[-2]:edge[-1]] = b, w / (w.sum() + np.float32(pad))
    edge = np.array(edge)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (dim, 1 << BITS)).astype(np.float32)
    out = rng.normal(0, 0.5, (dim, 2)).astype(np.float32)
    bias = np.log(np.maximum(np.bincount(label, minlength=2), 1) / len(label)).astype(np.float32)
    seen_e, seen_o = np.full_like(emb, 1e-6), np.full_like(out, 1e-6)
    for _ in range(max(epochs, -(-steps * batch // len(label)))):  # a small sample is read more often
        order = rng.permutation(len(label))
        for at in range(0, len(order), batch):
            ids = order[at:at + batch]
            at_bucket = np.concatenate([bucket[edge[i]:edge[i + 1]] for i in ids])
            a = np.concatenate([share[edge[i]:edge[i + 1]] for i in ids])
            sizes = edge[ids + 1] - edge[ids]
            row = np.repeat(np.arange(len(ids)), sizes)
            doc = np.stack([np.bincount(row, emb[d][at_bucket] * a, len(ids)) for d in range(dim)], axis=1)
            logits = doc @ out + bias
            prob = np.exp(logits - logits.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            err = prob - np.eye(2)[label[ids]]
            back = err @ out.T
            grad_o = (doc.T @ err).astype(np.float32)
            seen_o += grad_o ** 2
            out -= 0.1 * grad_o / np.sqrt(seen_o)
            bias -= np.float32(0.02) * err.mean(0).astype(np.float32)
            for d in range(dim):
                grad = np.bincount(at_bucket, back[row, d] * a, 1 << BITS).astype(np.float32)
                seen_e[d] += grad ** 2
                emb[d] -= rate * grad / np.sqrt(seen_e[d])
    top = weight * ((out[:, 1] - out[:, 0]) @ emb)
    sampled = np.maximum(np.bincount(label, minlength=2), 1)
    prior = np.log(shares.get(1, 0) + 1) - np.log(shares.get(0, 0) + 1) - np.log(sampled[1] / sampled[0])
    return ToxicityModel(top.astype(np.float32), weight, float(bias[1] - bias[0] + prior), pad)


def score_texts(model: ToxicityModel, texts: list[str | None]) -> np.ndarray:
    """Probability of class 1 for each text."""
    top, weight = np.zeros(len(texts)), np.zeros(len(texts))
    for block in char_blocks(texts, max(SIZES)):
        for _, bucket, valid in block.ngrams(SIZES, BITS, inside_words=True):
            block.sums(model.top[bucket] * valid, top)
            block.sums(model.weight[bucket] * valid, weight)
    logit = model.bias + top / (weight + max(model.pad, 1e-12))
    return np.exp(-np.logaddexp(0.0, -logit))


def scorer(docs: DataFrame, model: ToxicityModel) -> Callable[[str], Column]:
    """Column function: toxicity score of a text column, evaluated in Arrow batches."""
    # 2 * 2**BITS numbers; a plain tuple, so workers need not import this module to read it
    shared = docs.sparkSession.sparkContext.broadcast((model.top, model.weight, model.bias, model.pad))

    @F.pandas_udf("double")
    def toxicity(text: pd.Series) -> pd.Series:
        return pd.Series(score_texts(ToxicityModel(*shared.value), text.tolist()))

    return toxicity


def without_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns) that score below ``threshold``."""
    return docs.where(scorer(docs, model)("text") < threshold)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    score = scorer(docs, train(docs, table(spark, sf_dir, "labels")))
    return (docs.select("doc_id", (fold(F.col("doc_id"), HELD_OUT_FOLDS) == 0).alias("held_out"),
                        score("text").alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
