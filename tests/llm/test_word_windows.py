"""Removal of repeated windows of words against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest

from shelfwise.llm import word_windows

from .conftest import ODD_TEXTS, SCHEMA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    """rows of (doc_id, text) in their order; the n_words, n_removed, digest of each"""
    words = [WORD.findall(t or "") for _, t in rows]
    seen, out = set(), []
    for i in sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i)):
        gone = [False] * len(words[i])
        for at in range(len(words[i]) - size + 1):
            window = tuple(words[i][at:at + size])
            if window in seen:
                gone[at:at + size] = [True] * size
            seen.add(window)
        kept = " ".join(w for w, g in zip(words[i], gone) if not g)
        out.append((rows[i][0], len(words[i]), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def answer(spark, rows, **parameters):
    docs = spark.createDataFrame([(i, t, "en", "s", None, "x", "y", 1.0) for i, t in rows], SCHEMA).repartition(4)
    got = word_windows.without_repeated_windows(docs, **parameters)
    return sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=str)


def cases(n):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcDEé.") for _ in range(rng.randint(1, 5))) for _ in range(40)] + ["a", "b"]

    def prose(k):
        return [rng.choice(vocabulary) for _ in range(k)]

    shared = [prose(k) for k in (19, 20, 21, 39, 40, 41, 90)]
    texts = list(ODD_TEXTS)
    for _ in range(n):
        parts = [prose(rng.randint(0, 30))]
        if rng.random() < .6:
            parts += [rng.choice(shared), prose(rng.randint(0, 30))]
        if rng.random() < .2:
            parts += [["a"] * rng.randint(15, 50), rng.choice(shared)]
        if rng.random() < .1:
            parts += [["a", "b"] * 25]
        texts.append(rng.choice([" ", "\n", "\t \x0b\x0c\r", "   "]).join(w for p in parts for w in p))
    texts += texts[-20:]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts)) + [(None, texts[-1])]


@pytest.mark.parametrize("parameters", [{}, {"block_bytes": 300, "bucket_bytes": 2000}, {"window": 7, "first": 2}])
def test_windows_against_brute_force(spark, parameters):
    rows = cases(250)
    assert answer(spark, rows, **parameters) == brute(rows, parameters.get("window", 20))


def test_windows_of_repeated_rows(spark):
    """Of equal rows one keeps its words; other texts of one doc_id are in the order of their digest."""
    rng = random.Random(8)
    text = " ".join(str(rng.random()) for _ in range(60))
    got = answer(spark, [(5, text)] * 3 + [(6, text)] * 2, block_bytes=100)
    assert [r[:3] for r in got] == [(5, 60, 0), (5, 60, 60), (5, 60, 60), (6, 60, 60), (6, 60, 60)]
    half = " ".join(text.split()[:30])
    runs = [answer(spark, rows, block_bytes=100) for rows in ([(5, text), (5, half)], [(5, half), (5, text)])]
    assert runs[0] == runs[1] and sum(r[2] for r in runs[0]) == 30


def test_windows_when_nothing_repeats(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(str(rng.random()) for _ in range(30))) for i in range(20)]
    assert answer(spark, rows) == brute(rows, 20)


def test_windows_empty(spark):
    assert answer(spark, []) == []


def test_texts_are_not_shuffled(spark, monkeypatch):
    """Blocks are read where they lie: only questions and answers are exchanged."""
    plans = []
    keep = word_windows.stored

    def watched(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, tag)

    monkeypatch.setattr(word_windows, "stored", watched)
    out = word_windows.without_repeated_windows(spark.createDataFrame([(i, "a " * 30, "en", "s", 1, "x", "y", 1.0)
                                                                       for i in range(50)], SCHEMA))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    for plan in plans:
        lines = plan.splitlines()
        assert not any("Exchange" in a and "parquet" in b and "text" in b for a, b in zip(lines, lines[1:])), plan
    assert sum("Bucketed: true" in plan for plan in plans) == len(plans)


def test_windows_oracle_against_brute_force():
    rows = cases(250)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.sql(word_windows.ORACLE).fetchall(), key=str) == brute(rows, 20)
