"""Every registered query and the pipeline over empty tables, over a table of odd rows, and with
extra columns whose names clash."""

from __future__ import annotations

import pytest

import corpus_pipeline
from shelfwise.llm.queries import ORACLE_SQL, QUERIES

from .conftest import ODD_TEXTS

EXTRA = ", fp string, row string, block long, at int, words string, rank string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long" + EXTRA
LABELS = "doc_id long, quality int, toxic int" + EXTRA
BENCHMARK = "item_id long, text string" + EXTRA
EVERY = {**QUERIES, "pipeline": corpus_pipeline.run}


def written(spark, path, documents=(), labels=(), benchmark=()):
    more = ("x", "y", 1, 2, "z", "r")
    for name, rows, schema in (("documents", documents, DOCUMENTS), ("labels", labels, LABELS),
                               ("benchmark", benchmark, BENCHMARK)):
        spark.createDataFrame([(*r, *more) for r in rows], schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def test_all_queries_are_registered():
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return written(spark, tmp_path_factory.mktemp("empty"))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    texts = ODD_TEXTS + ["mail me at a@b.org or 4111 1111 1111 1111", "une phrase en plus"] * 3
    rows = [(i * 5, t, [None, "en", "fr", ""][i % 4], [None, "s"][i % 2], None if t is None else len(t))
            for i, t in enumerate(texts)]
    rows += [rows[4], (None, None, None, None, None), (None, "no id here", "en", "s", 10)]
    return written(spark, tmp_path_factory.mktemp("odd"), rows,
                   [(0, 1, 1), (5, 0, 0), (20, None, 1), (None, 1, 1), (25, 1, 0), (30, 0, None)],
                   [(1, None), (2, " \n\t"), (3, "an item of a few plain words. The answer")])


@pytest.mark.parametrize("name", sorted(EVERY))
def test_empty_tables_give_no_rows(spark, empty, name):
    assert EVERY[name](spark, empty).count() == 0


ONE_ROW_EACH = ("op2", "op3", "op4", "op5", "op6", "op8", "op9", "op12", "op13")


@pytest.mark.parametrize("name", sorted(EVERY))
def test_odd_rows_give_defined_results(spark, odd, name):
    n = EVERY[name](spark, odd).count()
    if name.split("_")[0] in ONE_ROW_EACH:
        assert n == spark.read.parquet(f"{odd}/documents.parquet").count()
