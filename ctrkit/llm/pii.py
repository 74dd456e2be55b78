"""Operator 11: personal data, in DataFrame functions only.

Regular expressions propose spans, kind by kind, leftmost and without overlap; validators confirm
them (digit counts, parts of addresses, the Luhn sum of card numbers, the mod-97 remainder of
IBANs, ranges of social security numbers); words near a span raise or lower its score.
The kinds of ``BASE`` are found whatever their score; those of ``ADDED`` need ``LEAST`` points.

A text is cut by each pattern, so a span's place follows from the lengths of the pieces before it;
running sums go in runs of ``RUN`` pieces, which keeps texts with very many matches near linear.
Patterns are written so that a failed start never rescans what an earlier one read, and with
possessive groups, which the regular-expression engine repeats without recursion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
#: Proposals by kind, in the order of kinds. Card numbers are whole chains of 14 to 19 digits.
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?<![0-9][0-9])(?<![0-9][ -][0-9])(?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9_])",
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
}
BASE = "email", "ip", "card", "phone"
ADDED = "iban", "ssn"
KINDS = (*BASE, *ADDED)
#: A character that every proposal of the kind holds.
NEEDS = {"email": "@", "phone": "+"}

#: Points of a confirmed span, of a word near it that speaks for its kind or against it, and those that
#: an added span needs.
POINTS = {"email": 80, "ip": 50, "card": 70, "phone": 60, "iban": 80, "ssn": 30}
CONTEXT_POINTS, LEAST = 25, 50
#: Code points looked at on either side of a span, up to the next proposal of its kind.
NEAR = 40
WORDS = {
    "email": "mail|email|contact|write|address|courriel|correo",
    "ip": "ip|server|host|client|login|address",
    "card": "card|credit|debit|visa|mastercard|amex|payment|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|cell|fax|telefon|telefono",
    "iban": "iban|bank|account|transfer|konto|compte|cuenta",
    "ssn": "ssn|social security",
}
AGAINST = "example|sample|test|version|order|invoice|isbn|serial"
RUN = 128

SPAN = "struct<start: bigint, rank: int, kind: string, end: bigint, value: string, score: int>"


def near_words(words: str) -> str:
    """Pattern of a context that holds one of the words."""
    return f"(?i)(?:^|[^A-Za-z])(?:{words})(?:[^A-Za-z]|$)"


def running(steps: Column) -> Column:
    """Sums of an array's entries up to and with each."""
    zero = F.lit(0).cast("long")

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, lambda a, x: a + x)

    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / RUN).cast("int")),
                       lambda c: F.slice(steps, c * RUN + 1, F.lit(RUN)))
    bases = F.aggregate(F.transform(runs, total), F.array(zero), lambda a, t: F.concat(a, F.array(F.element_at(a, -1) + t)))
    sums = F.zip_with(runs, bases, lambda part, base: F.transform(
        part, lambda x, i: base + total(F.slice(part, 1, i + 1))))
    return F.when(F.size(steps) > 0, F.flatten(F.filter(sums, lambda part: part.isNotNull())))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """The remainder of an IBAN: its first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))

    def add(rest: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code < 58, (rest * 10 + code - 48) % 97).otherwise((rest * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, sign: F.when(sign == "", rest).otherwise(add(rest, sign)))


def confirmed(kind: str, value: Column) -> Column:
    """Whether a proposal passes its kind's validators."""
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.substring(p, 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.call_function("luhn_check", digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    if kind == "iban":
        return mod97(value) == 1
    if kind == "ssn":
        area = F.substring(value, 1, 3)
        return ~area.isin("000", "666") & ~area.startswith("9") & (F.substring(value, 5, 2) != "00") & (
            F.substring(value, 8, 4) != "0000")
    return F.lit(True)


def score(kind: str, before: Column, after: Column) -> Column:
    def found(words: str) -> Column:
        return before.rlike(near_words(words)) | after.rlike(near_words(words))

    points = (F.lit(POINTS[kind]) + F.when(found(WORDS[kind]), CONTEXT_POINTS).otherwise(0)
              - F.when(found(AGAINST), CONTEXT_POINTS).otherwise(0))
    return F.greatest(F.lit(0), F.least(F.lit(100), points))


def spans_of(kind: str) -> Column:
    """Confirmed spans of a kind, from its matches, the pieces around them and their ends."""
    matches, pieces, ends = F.col(f"_m_{kind}"), F.col(f"_p_{kind}"), F.col(f"_e_{kind}")
    rank = KINDS.index(kind)

    def span(value: Column, i: Column) -> Column:
        end = F.get(ends, i)
        return F.struct((end - F.length(value)).cast("long").alias("start"), F.lit(rank).alias("rank"),
                        F.lit(kind).alias("kind"), end.cast("long").alias("end"), value.alias("value"),
                        score(kind, F.get(pieces, i)["tail"], F.get(pieces, i + 1)["head"]).alias("score"))

    kept = F.filter(F.transform(matches, span), lambda s: confirmed(kind, s["value"]))
    if kind in ADDED:
        kept = F.filter(kept, lambda s: s["score"] >= LEAST)
    return F.when(F.size(matches) > 0, kept).otherwise(F.array().cast(f"array<{SPAN}>"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) with one row per document; spans by start, then in the order of ``KINDS``.

    A span has its kind, start and end in code points (end exclusive), the text in it and its
    score. Null and empty texts have none; ids are passed through, null and repeated ones too;
    an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    text = F.col("_text")

    def matches(kind: str) -> Column:
        hits = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        return F.when(F.contains(text, F.lit(NEEDS[kind])), hits).otherwise(F.array().cast("array<string>")) if kind in NEEDS else hits

    def pieces(kind: str) -> Column:
        return F.when(F.size(f"_m_{kind}") > 0, F.transform(F.split(text, PATTERNS[kind], -1), lambda p: F.struct(
            F.length(p).alias("n"), F.substring(p, 1, NEAR).alias("head"), F.right(p, F.lit(NEAR)).alias("tail"))))

    def steps(kind: str) -> Column:
        return F.zip_with(F.slice(F.col(f"_p_{kind}"), F.lit(1), F.size(f"_m_{kind}")), f"_m_{kind}",
                          lambda p, m: (p["n"] + F.length(m)).cast("long"))

    for prefix, made in (("_m_", matches), ("_p_", pieces), ("_s_", steps), ("_e_", lambda k: running(F.col(f"_s_{k}"))),
                         ("_f_", spans_of)):
        rows = rows.withColumns({f"{prefix}{kind}": made(kind) for kind in KINDS})
    every = reduce(F.concat, [F.col(f"_f_{kind}") for kind in KINDS])
    return rows.select("doc_id", F.array_sort(every).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as comma-joined ``kind:start:end``."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans, and all spans with their scores as text."""
    def of(kind: str) -> Column:
        return F.filter("spans", lambda s: s["kind"] == kind)

    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))
