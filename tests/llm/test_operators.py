"""The operators against brute force on small rows, with nulls, empty and long texts, ties,
repeated rows, empty tables and extra columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from shelfwise.llm import decontaminate, exact_substrings, langid, lm, packing, pii, quality, search, simhash, toxicity

from .conftest import ODD_TEXTS, SCHEMA, documents


def words(text):
    return (text or "").encode().lower().split()


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


# --- op9 -----------------------------------------------------------------------------

def fingerprint(text):
    w = words(text)
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_simhash_against_brute_force(spark):
    rng = random.Random(1)
    base = [prose(rng, 60) for _ in range(20)]
    texts = ODD_TEXTS + base + [b + " end" for b in base] + [b.upper() for b in base]
    got = {r.doc_id: r for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    prints = [fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(prints):
            root[i] = min(root[j] for j, b in enumerate(prints) if (a ^ b).bit_count() <= 2)
    for i, p in enumerate(prints):
        assert got[i].fp % (1 << 64) == p
        assert got[i].component_id == root[i]
    kept = simhash.one_of_each(documents(spark, texts))
    assert kept.columns == documents(spark, []).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_simhash_odd_radius_links_all(spark):
    values = spark.createDataFrame([(0,), (1,), (3,), (7,), (1 << 40,)], "fp long")
    pairs = {(r.a, r.b) for r in simhash.colliding_pairs(values, 1).collect()}
    assert pairs == {(0, 1), (1, 3), (3, 7), (0, 1 << 40)}


def test_simhash_empty(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


# --- op5 -----------------------------------------------------------------------------

def test_suffix_order_is_the_suffix_array():
    rng = random.Random(2)
    for _ in range(500):
        s = [rng.randint(0, rng.choice([1, 2, 5, 30])) for _ in range(rng.randint(0, 40))]
        assert exact_substrings.suffix_order(s) == sorted(range(len(s)), key=lambda i: s[i:])


def kept_bytes(texts, size=exact_substrings.LENGTH):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i:i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if seen[b[i:i + size]] > 1:
                gone[i:i + size] = True
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()),
                    hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


def test_exact_substrings_against_brute_force(spark):
    rng = random.Random(3)
    shared = prose(rng, 200)
    texts = ["a" * 900, "ab" * 600, None, "", "short", shared, shared]
    for n in (399, 400, 401, 450, 700):
        texts += [prose(rng, 40) + shared[:n] + prose(rng, 40), prose(rng, 3) + "é" + shared[50:50 + n]]
    got = exact_substrings.without_repeats(documents(spark, texts)).collect()
    want = kept_bytes(texts)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(want))


def test_exact_substrings_of_a_hot_passage_do_not_meet_in_a_task(spark, monkeypatch):
    rng = random.Random(16)
    shared = prose(rng, 200)
    texts = [prose(rng, 40) + shared[:n] + prose(rng, 40) for n in (399, 400, 401, 430, 470, 527) * 5] + [shared] * 2
    met, decide = [], exact_substrings.starts_of_segments

    def watched(distinct, tasks):
        met.extend(r["count"] for r in distinct.groupBy("key").count().collect())
        return decide(distinct, tasks)

    monkeypatch.setattr(exact_substrings, "BATCH_SEGMENTS", 4)
    monkeypatch.setattr(exact_substrings, "starts_of_segments", watched)
    got = exact_substrings.without_repeats(documents(spark, texts)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(kept_bytes(texts)))
    assert max(met, default=0) <= 4


def test_hot_passages_in_blocks_against_brute_force(spark, monkeypatch):
    """Neighbours that agree for some bytes on either side, copies, texts that begin or end in
    the passage; a row for every string was made before."""
    rng = random.Random(21)
    shared = prose(rng, 120)[:500]
    left, right = (["".join(rng.choice("abc ") for _ in range(140)) for _ in range(4)] for _ in range(2))
    texts = []
    for _ in range(140):
        a, b, n = rng.randint(0, 140), rng.randint(0, 140), rng.choice([280, 300, 380, 400, 430])
        begin = rng.randint(0, 60)
        texts.append(prose(rng, rng.choice([0, 20])) + rng.choice(left)[140 - a:] + shared[begin:begin + n]
                     + rng.choice(right)[:b] + prose(rng, rng.choice([0, 20])))
    texts += texts[:9] + [texts[0] + texts[1], shared * 2]
    made, widths, cut = [], [], exact_substrings.blocks_of

    def counted(hot, width):
        made.append((cut(hot, width).count(), hot.count()))
        widths.append(width)
        return cut(hot, width)

    monkeypatch.setattr(exact_substrings, "BATCH_SEGMENTS", 3)
    monkeypatch.setattr(exact_substrings, "blocks_of", counted)
    got = exact_substrings.without_repeats(documents(spark, texts)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == dict(enumerate(kept_bytes(texts)))
    assert widths[:2] == [32, 8] and widths[-1] <= 2
    assert all(0 < rows <= 4 * segments for rows, segments in made)


# --- op4 -----------------------------------------------------------------------------

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
         ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for k, (_, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if (k == 0 or k == 1 and all(int(x) <= 255 for x in m.group().split("."))
                    or k == 2 and 14 <= len(d) <= 19 and luhn(d) or k == 3 and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_pii_against_brute_force(spark):
    rng = random.Random(4)
    alphabet = "0123456789" * 2 + "..-- ()+@aZ_%\nA"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.choice([5, 40, 300]))) for _ in range(800)]
    texts += ODD_TEXTS + ["a@b.c" * 3000 + "_x@d.e", "1 " * 100000 + "2", "9" * 50000, "1.2.3." * 20000,
                          "GB82 WEST 1234 5698 7654 32 bank 4111 1111 1111 1111 héé x@y.zz\n+1 (555) 123-4567"]
    rows = {r.doc_id: r for r in pii.personal_data(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        spans = base_spans(t)
        joined = ",".join(f"{KINDS[k][0]}:{s}:{e}" for s, k, e in spans)
        assert rows[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), t
        assert [rows[i][f"n_{n}"] for n, _ in KINDS] == [sum(k == j for _, k, _ in spans) for j in range(4)]
    assert rows[len(texts) - 1].spans == "iban:0:27,card:33:52,email:57:63,phone:64:81"
    masked = pii.redacted(documents(spark, texts))
    assert masked.columns == documents(spark, []).columns
    masked = {r.doc_id: r.text for r in masked.collect()}
    assert masked[len(texts) - 1] == "[IBAN] bank [CARD] héé [EMAIL]\n[PHONE]"
    assert masked[800] is None


# --- op7 -----------------------------------------------------------------------------

def test_packing_is_whole_and_fits(spark):
    rng = random.Random(5)
    texts = ODD_TEXTS + [prose(rng, rng.randint(1, 900)) for _ in range(200)]
    rows = packing.packed(documents(spark, texts), shard_rows=60).collect()
    size = collections.Counter()
    bins = collections.defaultdict(list)
    for r in rows:
        size[r.doc_id] += r.n_tokens
        if r.n_tokens:
            bins[r.bin_id].append(r)
        else:
            assert r.bin_id is None
    assert size == {i: len(words(t)) for i, t in enumerate(texts)}
    for members in bins.values():
        held = 0
        for r in sorted(members, key=lambda r: r.bin_offset):
            assert r.bin_offset == held
            held += r.n_tokens
        capacity = members[0].bin_capacity
        assert held == members[0].bin_tokens <= capacity
        assert all(c < held for c in packing.CAPACITIES if c < capacity)


def test_packing_picks_the_cheapest_plan():
    where, held, final = packing.pack([500, 500, 12, 12], packing.CAPACITIES)
    assert sum(held) == 1024 and set(final) <= set(packing.CAPACITIES)
    assert packing.pack([], packing.CAPACITIES) == ([], [], [])


# --- op1 -----------------------------------------------------------------------------

def test_decontamination_finds_verbatim_and_paraphrase(spark):
    rng = random.Random(6)
    clean = [prose(rng, 120) for _ in range(60)]
    item = prose(rng, 30) + ". " + prose(rng, 12) + "."
    changed = item.split()
    changed[4] = "changed"
    changed.insert(9, "added")
    docs = documents(spark, ODD_TEXTS + clean + [clean[0] + " " + item + " " + clean[1], " ".join(changed)])
    items = spark.createDataFrame([(7, item), (8, None), (9, " "), (10, prose(rng, 25))], "item_id long, text string")
    n = len(ODD_TEXTS) + len(clean)
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, items).collect()}
    assert found == {(n, 7), (n + 1, 7)}
    left = decontaminate.uncontaminated(docs, items)
    assert left.columns == docs.columns and left.count() == n
    assert decontaminate.find_contamination(docs, items.where("false")).count() == 0
    assert decontaminate.find_contamination(docs.where("false"), items).count() == 0


def seldom(rng, n):
    """Words that hardly ever come twice."""
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(n))


def test_decontamination_finds_paraphrases_of_short_items_in_long_texts(spark):
    rng = random.Random(13)
    items = [seldom(rng, rng.randint(15, 20)) for _ in range(40)]
    texts = []
    for item in items:
        changed = item.split()
        for at in rng.sample(range(len(changed)), len(changed) // 3):
            changed[at] = seldom(rng, 1)
        around = rng.sample([x for x in items if x != item], 16)  # weigh as much as the item
        texts.append(" ".join(around[:8] + changed + around[8:]))
    given = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = documents(spark, texts + [seldom(rng, 300) for _ in range(400)])
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, given).collect()}
    assert {(i, i) for i in range(40)} <= found


def test_decontamination_counts_repeated_words(spark):
    rng = random.Random(14)
    item = ("garden " * 8 + seldom(rng, 6)).split()
    changed = item[:8] + seldom(rng, 5).split() + item[13:]
    docs = documents(spark, [" ".join(changed)] + [prose(rng, 120) for _ in range(60)])
    given = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [r.doc_id for r in decontaminate.find_contamination(docs, given).collect()] == [0]


def test_decontamination_finds_changed_copies_of_a_hot_item(spark):
    rng = random.Random(15)
    item = seldom(rng, 30) + ". " + seldom(rng, 10) + "."
    changed = item.split()
    for at in range(0, len(changed), 4):
        changed[at] = seldom(rng, 1)
    clean = [seldom(rng, 240) for _ in range(60)]
    texts = clean + [seldom(rng, 100) + " " + item + " " + seldom(rng, 100) for _ in range(30)]
    texts.append(seldom(rng, 100) + " " + " ".join(changed) + " " + seldom(rng, 100))
    given = spark.createDataFrame([(3, item)], "item_id long, text string")
    found = {r.doc_id for r in decontaminate.find_contamination(documents(spark, texts), given).collect()}
    assert found == set(range(60, 91))


def test_common_length():
    assert decontaminate.common_length([1, 2, 3, 4], [9, 1, 3, 3, 4, 2]) == 3


# --- op2, op6, op8 ------------------------------------------------------------------

@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 40])
def test_codewords_are_distinct(n):
    code = langid.codewords(n)
    assert len(set(map(tuple, code))) == n
    assert n == 1 or (abs(code.sum(axis=0)) < n).all() or n > 7


def test_language_of_held_out_and_odd_texts(spark):
    rng = random.Random(7)
    two = {"xx": "aeiouaeioubcd", "yy": "qwrtpsdfgzz"}
    rows = [(i, " ".join("".join(rng.choice(two[l]) for _ in range(5)) for _ in range(30)), l)
            for i, l in enumerate(["xx", "yy"] * 60)]
    rows += [(200, None, "xx"), (201, "12 34", "yy"), (None, "aeiou aeiou", None), (202, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    got = docs.select("doc_id", "lang", langid.identifier(docs, model)("text").alias("f")).collect()
    for r in got:
        if r.doc_id is not None and r.doc_id < 200:
            assert r.f.lang == r.lang and 0 <= r.f.score <= 1
        elif r.doc_id is not None:
            assert (r.f.lang, r.f.score) == ("und", 0.0)
    assert langid.train(docs.where("false")) is None
    assert docs.select(langid.identifier(docs, None)("text").alias("f")).first().f.lang == "und"


def test_toxicity_learns_and_ignores_held_out_labels(spark):
    rng = random.Random(8)
    vocabulary = prose(rng, 150).split()

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    texts = [text(40) + (" vilezzo" if i % 4 == 0 else "") for i in range(400)]
    docs = documents(spark, texts + ["vilezo " + text(30)] + ODD_TEXTS)
    labels = [(i, int(i % 4 == 0)) for i in range(400)]
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    score = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.scorer(docs, model)("text").alias("s")).collect()}
    assert np.mean([(score[i] >= 0.5) == (i % 4 == 0) for i in range(400)]) > 0.97
    assert score[400] > np.median([score[i] for i in range(400) if i % 4])  # a misspelling
    assert all(0 <= s <= 1 for s in score.values())
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    again = toxicity.train(docs, spark.createDataFrame(flipped, "doc_id long, toxic int"))
    assert np.allclose(model.top, again.top)
    none = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score_texts(none, ["x", None]).tolist() == [0.0, 0.0]


def test_quality_prefers_the_target_and_selects_exactly(spark):
    rng = random.Random(9)
    texts = [prose(rng, 40) if i % 4 else prose(rng, 40).upper().replace(" ", "!! ") for i in range(200)]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(100)], "doc_id long, quality int")
    rows = quality.resampled(docs, labels, keep_share=0.7).collect()
    assert sum(r.selected for r in rows) == 140
    assert sum(r.selected for r in rows if r.doc_id % 4 == 0) < 5
    keys = sorted((r.gumbel_key for r in rows), reverse=True)
    assert min(r.gumbel_key for r in rows if r.selected) == keys[139]
    odd = quality.resampled(documents(spark, ODD_TEXTS), labels.where("false")).collect()
    assert len(odd) == len(ODD_TEXTS) and all(r.log_weight == 0 for r in odd)
    assert quality.resampled(documents(spark, []), labels).count() == 0


# --- op3 -----------------------------------------------------------------------------

def test_base_score_against_brute_force(spark):
    rng = random.Random(10)
    texts = ODD_TEXTS + [prose(rng, rng.randint(1, 60)).title() for _ in range(150)]
    rows = {r.doc_id: r for r in lm.scored(documents(spark, texts), frequent=50).collect()}
    count = collections.Counter()
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(words(t) + [None])
    n, v = sum(count.values()), len(count)
    for i, t in enumerate(texts):
        tokens = words(t) + [None]
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (rows[i].n_tokens, rows[i].train_tokens) == (len(tokens), n)
        assert rows[i].n_known == sum(count[x] > 0 for x in tokens)
        assert math.isclose(rows[i].base_score, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in tokens))
        assert rows[i].score < 0 and math.isfinite(rows[i].score)
    assert lm.scored(documents(spark, [])).count() == 0


def test_every_byte_has_a_distribution():
    rng = np.random.default_rng(11)
    odds = rng.integers(-20, 20, (len(lm.ORDERS), 1 << lm.TABLE_BITS)).astype(np.int8)
    weights, refine = lm.fit(odds, ["some text to learn from " * 3])
    scorer = lm.Scorer(odds, weights, refine)
    key = (np.uint64(0x616263646566) << np.uint64(8)) + np.arange(256, dtype=np.uint64)
    assert math.isclose((10 ** scorer(key)).sum(), 1.0)
    assert np.array_equal(scorer(key), scorer(key))  # from the cache


# --- op10 ----------------------------------------------------------------------------

def test_search_against_brute_force(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = [prose(rng, 1) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary[:rng.choice([20, 300])]) for _ in range(rng.randint(1, 80)))
             for _ in range(300)] + ODD_TEXTS + ["same text here"]
    docs = documents(spark, texts)
    index = search.build_index(docs.repartition(5))
    rows = collections.defaultdict(list)
    for r in search.search(index, docs.where("doc_id % 3 = 0"), k=7, block_terms=900).collect():
        rows[r.query_id].append((r["rank"], r.doc_id, r.score))
    bags = [collections.Counter(words(t)) for t in texts]
    size = [sum(b.values()) for b in bags]
    mean, n = sum(size) / len(size), len(size)
    df = collections.Counter(w for b in bags for w in b)
    for q in range(0, len(texts), 3):
        score = {}
        for d, b in enumerate(bags):
            s = sum(math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * b[w] * 2.2 / (b[w] + 1.2 * (.25 + .75 * size[d] / mean))
                    for w in bags[q] if w in b)
            if s > 0:
                score[d] = round(s, 9)
        best = sorted(score, key=lambda d: (-score[d], d))[:7]
        got = sorted(rows.get(q, []))
        assert [d for _, d, _ in got] == best
        assert np.allclose([s for _, _, s in got], [score[d] for d in best], atol=1e-8)


def shard_rows(texts, per_row):
    """Index rows as their tasks read them, the documents numbered from 0."""
    hashes = list(search.hashed_texts(texts))
    rows = [search.build_shard(list(range(a, min(a + per_row, len(texts)))), hashes[a:a + per_row])
            for a in range(0, len(texts), per_row)]
    return hashes, [[row[c] for c in search.COLUMNS] for row in rows]


def tiled_search(texts, asked, k, per_row=40, together=2, passes=1):
    """(ids, scores, floors, documents evaluated in each pass) of the tiles of all rows; each
    pass starts with the floors that the one before found."""
    hashes, rows = shard_rows(texts, per_row)
    lists = [np.unique(hashes[q]) for q in asked]
    vocabulary, term_of = np.unique(np.concatenate(lists), return_inverse=True)
    df = np.bincount(np.searchsorted(vocabulary, np.concatenate(
        [u[np.isin(u, vocabulary)] for u in map(np.unique, hashes)])), minlength=len(vocabulary))
    mean, n = max(1e-9, sum(map(len, hashes)) / len(texts)), len(texts)
    edges = np.cumsum([0, *map(len, lists)])
    lists = np.split(term_of.astype(np.int32), edges[1:-1])
    groups, idf = search.Groups(lists, df, n), np.log(1 + (n - df + 0.5) / (df + 0.5))
    floor, evaluated = np.zeros(len(asked)), []
    for _ in range(passes):
        best, done = search.Best(edges, np.concatenate(lists), len(vocabulary), k, floor), []
        for a in range(0, len(rows), together):
            held = [search.asked_postings(row, vocabulary) for row in rows[a:a + together]]
            for tile in search.tiles(held, mean, idf, groups):
                full = tile.evaluate
                tile.evaluate = lambda mark, docs, full=full: (done.append(len(docs)), full(mark, docs))[1]
                best.take(tile)
        floor = np.maximum(floor, best.scores[:, -1])
        evaluated.append(sum(done))
    return best.ids, best.scores, evaluated


def bm25_best(texts, q, k):
    bags = [collections.Counter(words(t)) for t in texts]
    size = [sum(b.values()) for b in bags]
    mean, n = sum(size) / len(size), len(size)
    df = collections.Counter(w for b in bags for w in b)
    score = {d: round(sum(math.log(1 + (n - df[w] + .5) / (df[w] + .5)) * b[w] * 2.2
                          / (b[w] + 1.2 * (.25 + .75 * size[d] / mean)) for w in bags[q] if w in b), 9)
             for d, b in enumerate(bags)}
    return sorted(((-s, d) for d, s in score.items() if s > 0))[:k]


@pytest.mark.parametrize("tile_docs, cells, dense", [(4096, 1 << 18, 0.06), (16, 64, 0.3), (7, 1, 1e9), (50, 999, 0.0)])
def test_search_tiles_against_brute_force(monkeypatch, tile_docs, cells, dense):
    for name, value in (("TILE_DOCS", tile_docs), ("CELLS", cells), ("DENSE", dense), ("PIECE", 100)):
        monkeypatch.setattr(search, name, value)
    rng = random.Random(5)
    tongues = [[prose(rng, 1) + str(t) for _ in range(150)] for t in range(3)]
    texts = [" ".join(rng.choice(tongues[i % 3][:rng.choice([8, 150])]) for _ in range(rng.randint(1, 60)))
             for i in range(200)]
    texts += texts[:30] + ["", None, "  "] + texts[:5] + ODD_TEXTS
    asked = [q for q in range(0, len(texts), 4) if words(texts[q])]
    ids, scores, _ = tiled_search(texts, asked, k=6, passes=2)
    for i, q in enumerate(asked):
        best = bm25_best(texts, q, 6)
        found = scores[i] >= 0
        assert ids[i][found].tolist() == [d for _, d in best]
        assert np.allclose(scores[i][found], [-s for s, _ in best], atol=1e-8)


def test_search_evaluates_few_documents_once_the_best_are_known():
    """Frequent words alone open no document: with the floors of a first part of the index
    each query looks in full at little more than its k best, however many rows there are."""
    rng = random.Random(6)
    common, rare = [prose(rng, 1) + "c" for _ in range(40)], [f"r{i}" for i in range(4000)]
    texts = [" ".join(rng.choices(common, k=40) + rng.choices(rare, k=20)) for _ in range(1000)]
    asked = range(0, 1000, 50)
    _, _, (first, second) = tiled_search(texts, asked, k=3, per_row=50, together=1, passes=2)
    assert second <= 2 * 3 * len(asked) < first


def test_search_with_blocks_that_hold_no_query(spark):
    """One long query makes several blocks, and its hash leaves all others empty."""
    docs = documents(spark, ["a b c d e f g h", "a b", "c"])
    found = search.search(search.build_index(docs), docs.where("doc_id = 0"), k=2, block_terms=2).collect()
    assert sorted((r["rank"], r.doc_id) for r in found) == [(1, 0), (2, 1)]
