"""Merkle manifest of a table of documents: one digest vouches for every row, and a proof
of a few hundred bytes shows that a row belongs to it.

Each row is a leaf, the SHA-256 of its framed columns. Per language the leaves ascend by
doc_id, every RUN neighbours become their hash, level by level, up to one subroot; the
subroots, by language, likewise give the root.

1. ``numbered`` gives rows consecutive ranks without a global window: a range shuffle, a
   number inside each sorted piece and the running count of the pieces before it.
2. ``climb`` builds the levels and stores, for each, the records digest -> children. A
   record is found by its content alone; equal nodes share one.
3. ``descend`` answers requests for leaves: from the root, the base-RUN digits of a leaf's
   rank choose a child in each record; the children not chosen become one segment of the
   proof. Requests with the same digits so far are one row (they are counted together
   before each step), so no key is hot at the root. A proof is the segments in reverse.

All work is joins and groupings of at most RUN rows; the last step stays at runs of leaves,
so the long segments move once for RUN documents. No Python runs on rows.

Defined results: a null column is framed ``-`` and an empty one ``0:``, so they differ;
rows of one doc_id are ordered by leaf digest, repeated rows are separate leaves; a null
doc_id comes first, and its decimal form is the empty text in the choice of tampered rows; a
null lang is a language of its own, before all others. A lone leaf is its language's subroot
and a lone subroot the root, with an empty proof. An empty table gives no rows. Texts are
hashed whole, whatever their length; columns not named below are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import fold, stored, table

RUN = 8
FRAMED = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def framed(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(text: Column) -> Column:
    return F.sha2(F.concat(*[framed(text if name == "text" else F.col(name)) for name in FRAMED]), 256)


def numbered(rows: DataFrame, part: list[str], order: list[str], tag: str) -> DataFrame:
    """``rows`` with ``rank`` (from 0 in each ``part``, by ``order``) and ``n``, the rows of
    the part. Columns of ``part`` must not be null."""
    pieces = (rows.repartitionByRange(*part, *order).sortWithinPartitions(*part, *order)
              .withColumn("_at", F.monotonically_increasing_id()))
    pieces = stored(pieces.withColumn("_piece", F.shiftright("_at", 33)), tag)
    counts = pieces.groupBy(*part, "_piece").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*part)  # over one row for each piece of the range shuffle
    before = whole.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = (counts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
              .withColumn("n", F.sum("_rows").over(whole)))
    return (pieces.join(counts, [*part, "_piece"])
            .withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_at", "_piece", "_first", "_before", "_rows"))


def climb(nodes: DataFrame, tag: str) -> tuple[list[DataFrame], DataFrame]:
    """From leaves (tree, rank, digest, n): the stored levels (tree, rank, digest, n,
    children), lowest first, and the top of each tree (tree, digest, height)."""
    columns = ["tree", "rank", "digest", "n"]
    levels: list[DataFrame] = []
    tops = nodes.where("n = 1").select("tree", "digest", F.lit(0).alias("height"))
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        children = F.transform(F.array_sort(F.collect_list(F.struct("rank", "digest"))), lambda c: c["digest"])
        level = (nodes.where("n > 1").groupBy("tree", "n", F.expr(f"rank div {RUN}").alias("run"))
                 .agg(children.alias("children"))
                 .select("tree", F.col("run").alias("rank"), F.sha2(F.concat_ws("", "children"), 256).alias("digest"),
                         F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"), "children"))
        levels.append(stored(level, f"{tag}-{len(levels) + 1}"))
        nodes = levels[-1].select(*columns)
        tops = tops.union(nodes.where("n = 1").select("tree", "digest", F.lit(len(levels))))
        most = -(-most // RUN)
    return levels, tops


def beside(children: Column, digit: Column) -> Column:
    """The children to the left and to the right of the chosen one."""
    return F.struct(F.concat_ws("", F.slice(children, F.lit(1), digit)).alias("left"),
                    F.concat_ws("", F.slice(children, digit + 2, F.lit(RUN))).alias("right"))


def descend(tops: DataFrame, levels: list[DataFrame], requests: DataFrame, stop: int) -> DataFrame:
    """(tree, at, digest, path, other columns of ``tops``): the nodes of level ``stop`` that
    lie on the way from the tops (tree, digest, height, path, ...) to the requested nodes
    (tree, at) of that level, each with the segments passed, highest first. Trees that are
    lower than ``stop`` stay at their top."""
    kept = [c for c in tops.columns if c != "height"]

    def begin(height: Column) -> DataFrame:
        return tops.where(height).select(*kept, F.lit(0).cast("long").alias("at"))

    state = begin(F.col("height") <= stop)
    for height in range(len(levels), stop, -1):
        here = begin(F.col("height") == height)
        above = here if height == len(levels) else above.unionByName(here)
        asked = (requests.select("tree", F.expr(f"at div {RUN ** (height - 1 - stop)}").alias("below")).distinct()
                 .withColumn("at", F.expr(f"below div {RUN}")))
        records = levels[height - 1].select("digest", "children").dropDuplicates(["digest"])
        digit = F.expr(f"cast(below % {RUN} as int)")
        above = (above.join(records, "digest").join(asked, ["tree", "at"])
                 .withColumn("path", F.concat("path", F.array(beside(F.col("children"), digit))))
                 .withColumn("digest", F.element_at("children", digit + 1))
                 .withColumn("at", F.col("below")).select(*kept, "at"))
    return state if not levels[stop:] else state.unionByName(above)


def proofs(docs: DataFrame, tampered_text: Column) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (siblings from the leaf up, in hex),
    folded_root and verified for every row. ``tampered_text`` is the text as a reader would
    find it; the proof is folded with the leaf that gives."""
    lang = F.coalesce(F.concat(F.lit("="), "lang"), F.lit("-"))  # null first, then by bytes of lang
    leaves = docs.select("doc_id", lang.alias("tree"), leaf_digest(F.col("text")).alias("digest"),
                         leaf_digest(tampered_text).alias("found"))
    # the number only tells repeated rows apart, so that a range shuffle can divide them
    leaves = stored(leaves.withColumn("same", F.monotonically_increasing_id()), "leaves")
    leaves = stored(numbered(leaves, ["tree"], ["doc_id", "digest", "same"], "ordered").drop("same"), "ranked")
    levels, subroots = climb(leaves.select("tree", "rank", "digest", "n"), "level")
    subroots = stored(subroots, "subroots")
    langs = numbered(subroots.withColumn("of", F.col("tree")).withColumn("tree", F.lit("")), ["tree"], ["of"], "langs")
    langs = stored(langs, "langs-ranked")
    tops, root = climb(langs.select("tree", "rank", "digest", "n"), "top")
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    root = root.withColumn("path", nothing).withColumn("root", F.col("digest"))
    ways = (descend(root, tops, langs.select("tree", F.col("rank").alias("at")), 0)
            .join(langs.select("tree", F.col("rank").alias("at"), "of", "height"), ["tree", "at"])
            .select(F.col("of").alias("tree"), "digest", "height", "path", "root", F.col("digest").alias("subroot")))
    runs = stored(leaves.groupBy("tree", F.expr(f"rank div {RUN}").alias("at"))
                  .agg(F.collect_list(F.struct(F.expr(f"cast(rank % {RUN} as int)").alias("digit"),
                                               "doc_id", "digest", "found")).alias("asked")), "runs")  # at most RUN
    state = descend(stored(ways, "ways"), levels, runs.select("tree", "at"), 1)
    if levels:
        records = levels[0].select("digest", "children").dropDuplicates(["digest"])
        state = state.join(records, "digest", "left")  # a lone leaf has none
    else:
        state = state.withColumn("children", F.lit(None).cast("array<string>"))
    rows = state.join(runs, ["tree", "at"]).select("root", "subroot", "path", "children", F.explode("asked").alias("of"))
    last = F.when(F.col("children").isNull(), nothing).otherwise(F.array(beside(F.col("children"), F.col("of.digit"))))
    rows = rows.select("root", "subroot", F.col("of.doc_id").alias("doc_id"), F.col("of.digest").alias("leaf"),
                       F.col("of.found").alias("found"), F.reverse(F.concat("path", last)).alias("segments"))
    folded = F.aggregate("segments", F.col("found"),
                         lambda digest, s: F.sha2(F.concat(s["left"], digest, s["right"]), 256))
    return (rows.withColumn("proof", F.concat_ws("", F.transform("segments", lambda s: F.concat(s["left"], s["right"]))))
            .withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root"))
            .select("doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, roots, digest of the proof and the root folded from the row as found, for every
    row of ``documents``; a third of the rows are found with A-Z of the text lower-cased."""
    docs = table(spark, sf_dir, "documents").select(*FRAMED)
    found = F.when(fold(F.col("doc_id"), 3) == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return (proofs(docs, found).withColumn("proof_sha256", F.sha2("proof", 256))
            .select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"))


def _framed_sql(value: str) -> str:
    return f"coalesce(strlen(({value})::varchar) || ':' || ({value})::varchar, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_framed_sql(text if name == "text" else name) for name in FRAMED) + ")"


_CRC32_SQL = """CASE WHEN doc_id IS NULL THEN 0 ELSE xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::BIGINT)),
      lambda crc, c: list_reduce([xor(crc, c), 0, 0, 0, 0, 0, 0, 0, 0],
                              lambda x, bit: xor(x >> 1, 3988292384 * (x & 1))))) END"""

ORACLE = f"""
WITH RECURSIVE given AS (
  SELECT doc_id, lang, {_leaf_sql('text')} AS leaf,
         CASE WHEN ({_CRC32_SQL}) % 3 = 0 THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")}
              ELSE {_leaf_sql('text')} END AS found
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, found) - 1 AS rank,
         count(*) OVER (PARTITION BY lang) AS n FROM given),
low AS (
  SELECT 0 AS level, lang, rank, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT level + 1, lang, rank // {RUN}, sha256(string_agg(digest, '' ORDER BY rank)), (n + {RUN - 1}) // {RUN}
  FROM low WHERE n > 1 GROUP BY level, lang, rank // {RUN}, n),
langs AS (
  SELECT lang, digest AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank,
         count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, rank, subroot AS digest, n FROM langs
  UNION ALL
  SELECT level + 1, rank // {RUN}, sha256(string_agg(digest, '' ORDER BY rank)), (n + {RUN - 1}) // {RUN}
  FROM high WHERE n > 1 GROUP BY level, rank // {RUN}, n),
root AS (SELECT digest AS root FROM high WHERE n = 1),
steps AS (  -- per node below a top: what stands left and right of it in its run
  SELECT a.lang, a.level, a.rank,
         coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (b.rank < a.rank), '') AS lhs,
         coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (b.rank > a.rank), '') AS rhs
  FROM low a JOIN low b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level
       AND a.rank // {RUN} = b.rank // {RUN} AND a.n > 1
  GROUP BY a.lang, a.level, a.rank
  UNION ALL
  SELECT l.lang, l.height + a.level, -1,
         coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (b.rank < a.rank), ''),
         coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (b.rank > a.rank), '')
  FROM langs l JOIN high a ON a.rank = l.rank // CAST({RUN} ** a.level AS BIGINT)
  JOIN high b ON a.level = b.level AND a.rank // {RUN} = b.rank // {RUN} AND a.n > 1
  GROUP BY l.lang, l.height, a.level),
folding AS (
  SELECT lang, rank, doc_id, leaf, 0 AS level, found AS digest, '' AS proof FROM leaves
  UNION ALL
  SELECT f.lang, f.rank, f.doc_id, f.leaf, f.level + 1, sha256(s.lhs || f.digest || s.rhs), f.proof || s.lhs || s.rhs
  FROM folding f JOIN steps s ON f.lang IS NOT DISTINCT FROM s.lang AND f.level = s.level
       AND s.rank IN (-1, f.rank // CAST({RUN} ** f.level AS BIGINT))),
folded AS (SELECT * FROM folding QUALIFY level = max(level) OVER (PARTITION BY lang, rank))
SELECT f.doc_id, f.leaf, l.subroot, r.root, sha256(f.proof) AS proof_sha256, f.digest AS folded_root,
       f.digest = r.root AS verified
FROM folded f JOIN langs l ON f.lang IS NOT DISTINCT FROM l.lang, root r
"""
