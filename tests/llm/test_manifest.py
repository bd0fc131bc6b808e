"""The Merkle manifest against trees built in plain Python."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import manifest

from .conftest import ODD_TEXTS, SCHEMA

ROW = "doc_id long, text string, lang string, source string, n_chars long, digest string, rank long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """(root, proof segments (left, right) of each node)"""
    path = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, above = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at:at + 8]
            for j in range(len(run)):
                for i in under[at + j]:
                    path[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            up.append(H(*run))
            above.append(sum(under[at:at + 8], []))
        nodes, under = up, above
    return nodes[0], path


def brute(rows):
    """rows of (doc_id, text, lang, source, n_chars)"""
    def low(t):
        return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    by_lang, subroots, steps = {}, {}, {}
    for r in rows:
        doc_id, text, lang, source, n = r
        a = leaf(doc_id, source, lang, n, text)
        hit = zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 0
        b = leaf(doc_id, source, lang, n, low(text)) if hit else a
        by_lang.setdefault(lang, []).append(((doc_id is not None, doc_id or 0), a, b, doc_id))
    order = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    for lang in order:
        by_lang[lang].sort(key=lambda v: v[:2])
        subroots[lang], steps[lang] = tree([v[1] for v in by_lang[lang]])
    root, top = tree([subroots[lang] for lang in order])
    out = []
    for at, lang in enumerate(order):
        for (_, a, b, doc_id), path in zip(by_lang[lang], steps[lang]):
            way = path + top[at]
            got = b
            for left, right in way:
                got = H(left, got, right)
            out.append((doc_id, a, subroots[lang], root, H(*[x + y for x, y in way]), got, got == root))
    return sorted(out, key=str)


def cases():
    rng = random.Random(4)
    mixed = [(i * 7 % 90, t, rng.choice(["en", "de", None, "", "é"]), rng.choice(["s", None, ""]), len(t or ""))
             for i, t in enumerate(ODD_TEXTS * 9)]
    # ids that repeat, a repeated row, no id, one language that holds most rows, many languages
    mixed += [mixed[0], (mixed[0][0], "other", mixed[0][2], "s", None), (None, "A", "en", "s", 1), (None, "B", "en", "s", 1)]
    mixed += [(1000 + i, f"Text {i}", "en", "hot", i) for i in range(600)]
    langs = [(i, "Ab", f"l{i}", "s", 2) for i in range(70)]
    return {"mixed": mixed, "many languages": langs, "eight": langs[:1] * 8, "nine": [(i, "X", "en", "s", 1) for i in range(9)],
            "one": [(5, "Hello", "en", "s", 5)], "none": []}


def answer(spark, rows):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], ROW)
    found = F.when(manifest.fold(F.col("doc_id"), 3) == 0,
                   F.translate("text", manifest.UPPER, manifest.LOWER)).otherwise(F.col("text"))
    got = manifest.proofs(docs, found).withColumn("proof_sha256", F.sha2("proof", 256))
    return sorted((tuple(r) for r in got.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
                                                 "verified").collect()), key=str)


@pytest.mark.parametrize("name", cases())
def test_manifest_against_brute_force(spark, name):
    rows = cases()[name]
    assert answer(spark, rows) == (brute(rows) if rows else [])


@pytest.mark.parametrize("name", ["mixed", "many languages", "one"])
def test_manifest_oracle_against_brute_force(name):
    rows = cases()[name]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.sql(manifest.ORACLE).fetchall(), key=str) == brute(rows)


def test_manifest_of_one_changed_row(spark):
    """Any change of one row changes the root, and the other rows' proofs say so."""
    rows = [(i, f"t{i}", "en", "s", 2) for i in range(100)]
    other = rows[:40] + [(40, "t4O", "en", "s", 2)] + rows[41:]
    assert {r[3] for r in answer(spark, rows)}.isdisjoint(r[3] for r in answer(spark, other))


def test_ranks_of_a_hot_key_come_from_several_pieces(spark):
    rows = spark.range(5000).select(F.lit("a").alias("tree"), (F.col("id") * 31 % 5000).alias("k"), F.lit(0).alias("z"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = manifest.numbered(rows, ["tree"], ["z", "k"], "t").select("k", "rank", "n").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert all(r.k == r.rank and r.n == 5000 for r in got) and len(got) == 5000
