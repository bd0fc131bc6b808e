"""Source divergence against plain Python over all kept terms."""

from __future__ import annotations

import collections
import random
import re

import duckdb
import numpy as np
import pytest

from shelfwise.llm import divergence

from .conftest import ODD_TEXTS, SCHEMA

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute(rows, min_documents):
    """rows of (lang, source, text)"""
    rows = [tuple(v or "" for v in r) for r in rows]
    found = [(lang, source, TERM.findall(lower(text))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        docs = collections.Counter(t for a, _, terms in found if a == lang for t in set(terms))
        kept = {t for t, d in docs.items() if d >= min_documents}
        counts = {s: collections.Counter() for a, s, _ in found if a == lang}
        for a, s, terms in found:
            if a == lang:
                counts[s].update(t for t in terms if t in kept)
        whole = sum(counts.values(), collections.Counter())

        def p(counter, t):
            return 1 + 10**9 * (counter[t] + 5) // (sum(counter.values()) + 5 * len(kept))

        def add(source, part, items, top):
            order = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out.update((lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(order[:top]))

        share = {s: {t: p(c, t) for t in kept} for s, c in counts.items()}
        for s in counts:
            add(s, "pair", [(o, sum(abs(share[s][t] - share[o][t]) for t in kept)) for o in counts if o != s], None)
            add(s, "term", [(t, share[s][t] - p(whole, t)) for t in kept
                            if counts[s][t] and share[s][t] > p(whole, t)], 50)
    return out


def answer(spark, rows, **parameters):
    docs = spark.createDataFrame([(i, t, a, s, None, "x", "y", 1.0) for i, (a, s, t) in enumerate(rows)], SCHEMA)
    got = [tuple(r) for r in divergence.divergence(docs, **parameters).collect()]
    assert len(got) == len(set(got))
    return set(got)


def cases(n_docs):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeÉéß") for _ in range(rng.randint(1, 3))) for _ in range(150)] + ["The", "the"]
    rows = []
    for _ in range(n_docs):
        source = rng.choice(["hot"] * 5 + [None, "", "B", "a", "é", "z1", "z2"])
        lang = rng.choice(["en"] * 4 + ["de", None, "xx"])
        if lang == "xx":
            rows.append((lang, source, "12 34 ;" if rng.random() < .5 else None))
        else:
            mine = words[:rng.choice([20, 150])]
            rows.append((lang, source, rng.choice([" ", "-", "\n", "_9@["]).join(rng.choices(mine, k=rng.randint(0, 40)))))
    return rows + [("en", "hot", t) for t in ODD_TEXTS] + [("solo", "one", "a b")] * 40 + rows[:3]


@pytest.mark.parametrize("block_terms,tile_groups", [(1024, 32), (7, 2)])
def test_divergence_against_brute_force(spark, block_terms, tile_groups):
    rows = cases(500)
    got = answer(spark, rows, min_documents=5, block_terms=block_terms, tile_groups=tile_groups)
    assert got == brute(rows, 5)


def test_divergence_in_small_parts(spark, monkeypatch):
    """Counts sent on early, and one that no double holds exactly."""
    rows = cases(120) + [("big", "s", "x y " * 200_000)] + [("big", "t", "x")] * 6 + [("big", "u", "x y")] * 6
    monkeypatch.setattr(divergence, "HELD_TERMS", 50)
    assert answer(spark, rows, min_documents=5) == brute(rows, 5)


def test_divergence_empty(spark):
    assert answer(spark, []) == set()
    assert answer(spark, [(None, None, None)]) == set()


def test_shares_are_exact():
    counts = np.array([0, 1, 10**12, 9 * 10**17])
    assert divergence.shares(counts, 9 * 10**17 + 10**12 + 1, 3).tolist() == [
        1 + 10**9 * (c + 5) // (9 * 10**17 + 10**12 + 1 + 15) for c in counts.tolist()]


def test_joint_cells_in_steps():
    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 1 << 63, (50, 4)).astype(np.uint64), rng.integers(0, 1 << 63, (30, 3)).astype(np.uint64)
    want = [[sum(int(x & y).bit_count() for x, y in zip(r, s)) for s in b] for r in a]
    assert divergence.joint_cells(a, b, 100).tolist() == want == divergence.joint_cells(a, b).tolist()


def test_divergence_oracle_against_brute_force():
    rows = cases(500)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (lang VARCHAR, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert set(con.sql(divergence.ORACLE).fetchall()) == brute(rows, divergence.MIN_DOCUMENTS)
