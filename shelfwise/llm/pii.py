"""Personal data with DataFrame functions only: regular expressions propose spans, checks
(octet range, Luhn, digit count, mod-97) confirm them, nearby words adjust a score.

Every kind is matched left to right without overlap inside the kind; a match that fails
its check is dropped and not tried again from another start. Spans are positions in code
points, the end exclusive. They come from one split of the text at the matches: a match
starts where the pieces and matches before it end, so no Python and no shuffle is needed
and every row is worked on where it was read. The patterns use possessive loops, which
match the same text as plain ones here and need no stack on very long texts.

Base kinds (email, ip, card, phone) always stay. Added kinds (iban, with its mod-97
check, as long as its country has them, no letter or digit next to it) are reported if the score after the context words reaches ``min_score``.

Defined results: a null text counts as empty and has no spans; kinds may overlap each
other and are all reported; repeated rows are reported alike; other columns are kept apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.common import table

BLOCK = 128  # matches per block of the two-level running sum
NEAR = 40  # characters on either side that count as context


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str  # Java form
    gate: str  # a text without a match of this (cheap) pattern has no span
    base: bool
    score: float
    likely: str  # context words that raise the score
    unlikely: str  # context words that lower it


# Characters of an IBAN by its country (public registry).
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "|".join(f"(?:{'|'.join(names.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{size - 4}}}" for size, names in IBAN_LENGTHS.items())

# Patterns of the base kinds.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++", "@", True, 0.9,
         "e?mail|contact|write|reply", "example|noreply"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", True, 0.6,
         "ip|address|host|server|login", "version|release|section"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][0-9\x20-]{12}", True, 0.8,
         "card|visa|credit|pay|amex", "order|tracking|isbn|invoice"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", True, 0.8,
         "phone|tel|call|mobile|fax", "score|math"),
    Kind("iban", rf"(?<![A-Za-z0-9])(?:{IBAN})(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}", False, 0.7,
         "iban|bank|account|transfer|konto", "serial|part"),
)
BASE = [k.name for k in KINDS if k.base]


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    size = F.length(digits)

    def weighed(i: Column) -> Column:
        digit = F.substring(digits, i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when((size - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda a, i: a + weighed(i)) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an IBAN's remainder modulo 97 is 1 (first four characters moved to the end,
    letters as 10 to 35)."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def add(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code <= 57, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), add) == 1


def confirmed(kind: Kind, value: Column) -> Column:
    """The kind's check of a match."""
    if kind.name == "ip":
        def octet(part: Column) -> Column:
            short = F.ltrim(part, F.lit("0"))
            return (F.length(short) <= 3) & (F.lpad(short, 3, "0") <= "255")
        return F.forall(F.split(value, r"\."), octet)
    if kind.name == "card":
        digits = digits_of(value)
        return F.length(digits).between(14, 19) & luhn(digits)
    if kind.name == "phone":
        return F.length(digits_of(value)).between(10, 15)
    if kind.name == "iban":
        return mod97(value)  # the pattern has the length
    return F.lit(True)


def adjusted(kind: Kind, before: Column, after: Column) -> Column:
    """Score of a confirmed span from the words around it, as whole percents."""
    near = F.lower(F.concat(F.right(before, F.lit(NEAR)), F.lit(" "), F.left(after, F.lit(NEAR))))
    return (F.lit(round(kind.score * 100)) + F.when(near.rlike(rf"\b(?:{kind.likely})\b"), 10).otherwise(0)
            - F.when(near.rlike(rf"\b(?:{kind.unlikely})\b"), 30).otherwise(0))


def staged(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with columns computed once per row: a generator of one row keeps the
    optimizer from pasting them into every later use (also inside lambda functions)."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def matched(df: DataFrame, kinds: tuple[Kind, ...]) -> DataFrame:
    """Per kind k the matches ``m_k`` and the pieces between them ``p_k`` of column body."""
    none = F.array().cast("array<string>")
    return staged(df, *[c for k in kinds for c in (
        F.when(F.col("body").rlike(k.gate), F.regexp_extract_all("body", F.lit(k.pattern), F.lit(0)))
        .otherwise(none).alias(f"m_{k.name}"),
        F.when(F.col("body").rlike(k.gate), F.split("body", k.pattern, -1)).otherwise(none).alias(f"p_{k.name}"))])


def span_arrays(df: DataFrame, min_score: float) -> DataFrame:
    """``df`` (with column body) plus ``found``: all spans (start, kind number, end, score)
    in order of start, then kind."""
    df = matched(df, KINDS)

    def sizes(name: str) -> Column:  # of each match and the piece before it
        return F.transform(f"m_{name}", lambda m, i: F.length(F.get(f"p_{name}", i)).cast("long") + F.length(m))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)

    def before_blocks(name: str) -> Column:  # the running sum at each block's first match
        size = F.size(f"s_{name}")
        blocks = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / BLOCK).cast("int"))
                        ).otherwise(F.array().cast("array<int>"))
        return F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda sums, b: F.concat(sums, F.array(
            F.element_at(sums, -1) + total(F.slice(f"s_{name}", b * BLOCK + 1, F.lit(BLOCK))))))

    df = staged(df, *[sizes(k.name).alias(f"s_{k.name}") for k in KINDS])
    df = staged(df, *[before_blocks(k.name).alias(f"b_{k.name}") for k in KINDS])

    def spans(number: int, kind: Kind) -> Column:
        name = kind.name

        def span(match: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            start = (F.get(f"b_{name}", block) + total(F.slice(f"s_{name}", block * BLOCK + 1, i - block * BLOCK))
                     + F.length(F.get(f"p_{name}", i)))
            return F.when(confirmed(kind, match), F.struct(
                start.alias("start"), F.lit(number).alias("kind"), (start + F.length(match)).alias("end"),
                adjusted(kind, F.get(f"p_{name}", i), F.get(f"p_{name}", i + 1)).alias("score")))

        kept = F.filter(F.transform(f"m_{name}", span), lambda s: s.isNotNull())
        return kept if kind.base else F.filter(kept, lambda s: s["score"] >= round(min_score * 100))

    return staged(df, F.array_sort(F.concat(*[spans(i, k) for i, k in enumerate(KINDS)])).alias("found"))


def listed(spans: Column, with_score: bool = False) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"], s["end"], *([s["score"]] if with_score else []))), ",")


def personal_data(docs: DataFrame, min_score: float = 0.6) -> DataFrame:
    """doc_id, counts per kind, base_sha256, spans and scored spans of every row."""
    df = span_arrays(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("body")), min_score)
    base = F.filter("found", lambda s: s["kind"] < len(BASE))

    def count(number: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == number)).cast("long")

    counts = [count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"),
                     listed(F.col("found")).alias("spans"), listed(F.col("found"), True).alias("scored"))


def _masked(kind: Kind, min_score: float) -> Column:
    """The pieces between the matches of ``kind``, each with what stands for the match after it."""

    def part(piece: Column, i: Column) -> Column:
        match = F.get(f"m_{kind.name}", i)
        good = confirmed(kind, match)
        if not kind.base:
            good &= adjusted(kind, piece, F.get(f"p_{kind.name}", i + 1)) >= round(min_score * 100)
        return F.concat(piece, F.when(match.isNull(), "").when(good, f"[{kind.name.upper()}]").otherwise(match))

    return F.transform(f"p_{kind.name}", part)


def redacted(docs: DataFrame, min_score: float = 0.6) -> DataFrame:
    """``docs`` (all columns) with every confirmed span of ``text`` replaced by its kind in
    brackets, kind after kind; a null text stays null. ``n_chars`` follows the new text if
    the table has it."""
    columns = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    df = docs.select(row, F.coalesce("text", F.lit("")).alias("body"))
    for kind in KINDS:
        df = matched(df, (kind,))
        df = staged(df, F.when(F.size(f"m_{kind.name}") > 0, F.array_join(_masked(kind, min_score), ""))
                    .otherwise(F.col("body")).alias("masked")).select("row", F.col("masked").alias("body"))
    text = F.when(F.col("row.text").isNotNull(), F.col("body"))
    new = {"text": text, "n_chars": F.when(text.isNotNull(), F.length(text).cast("long")).otherwise(
        F.col("row.n_chars")) if "n_chars" in columns else None}
    return df.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in columns])


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """Spans of personal data in every row of ``documents``."""
    return personal_data(table(spark, sf_dir, "documents"))
