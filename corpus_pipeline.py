"""A training corpus from ``documents``: toxic documents go, one document of each
near-duplicate group stays, documents that leak benchmark items go, personal data is
masked, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the result
is written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm.common import DOCUMENT_COLUMNS, stored, table
from shelfwise.llm.decontaminate import uncontaminated
from shelfwise.llm.packing import packed
from shelfwise.llm.pii import redacted
from shelfwise.llm.simhash import one_of_each
from shelfwise.llm.toxicity import train, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model (fitted on the labelled training rows of the
    given tables) accepts."""
    model = train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return without_toxic(docs, model).select(*DOCUMENT_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the smallest doc_id."""
    return one_of_each(docs).select(*DOCUMENT_COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return uncontaminated(docs, table(spark, sf_dir, "benchmark")).select(*DOCUMENT_COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with personal data masked."""
    return redacted(docs).select(*DOCUMENT_COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and the bins they are packed into."""
    return packed(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontamination", decontamination),
          ("pii", pii), ("packing", packing)]
# Trained scores, fingerprints of XXH64 and greedy packing have no SQL counterpart;
# tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the given ``documents`` on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
