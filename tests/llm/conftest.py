from __future__ import annotations

import pytest

from shelfwise.conf import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4, app="shelfwise-llm-tests")
    yield session


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, row string, score double"


def documents(spark, texts, lang="en"):
    """A documents table with extra columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, lang, "s", None if t is None else len(t), "x", "y", 1.0)
                                  for i, t in enumerate(texts)], SCHEMA)


ODD_TEXTS = [None, "", " \n\t ", "a", "one two", "word " * 30000, "same text here", "same text here", "é" * 500]
