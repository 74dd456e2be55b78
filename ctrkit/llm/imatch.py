"""Operator 4: I-Match fingerprints, in DataFrame functions only.

A term is a word's 64-bit hash. The lexicon keeps the terms whose share of documents lies within a
band (an inverse-document-frequency band). The band's lower edge bounds it: a document has a term once,
so at most (distinct terms of a document on average) / (least share) terms are in it, however large the
corpus. It is shipped as its hashes in buckets, with the buckets' offsets. Of each text the distinct terms in the lexicon
are sorted; then, for several randomised subsets of the lexicon, the terms in the subset are
hashed in that order. The subsets come in ``REPLICAS`` nested series that halve at each of
``LEVELS`` levels, so that texts of any length have subsets that hold a few of their terms.
A fingerprint is the row of those hashes; likeness is the share of subsets where both agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctrkit.llm.common import partitions

#: Shares of documents between which a term is in the lexicon, and its least document count.
BAND = 0.005, 0.5
LEAST_DOCS = 2
#: Bits of a hash that name its bucket in the lexicon.
BUCKET_BITS = 14
LEVELS, REPLICAS = 8, 8
#: Window groups per shuffle partition.
SLICES = 4
NULL_ID = -(1 << 63)


def terms(text: Column) -> Column:
    """Distinct hashes of the lower-case words of a text."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def bucket(term: Column) -> Column:
    return term.bitwiseAND(F.lit((1 << BUCKET_BITS) - 1).cast("long"))


def numbers(values: list[int], kind: str) -> Column:
    """A constant array, written as one string that the optimizer reads once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>") if values else F.array().cast(f"array<{kind}>")


def lexicon(texts: DataFrame, band: tuple[float, float] = BAND) -> tuple[Column, Column]:
    """(the hashes of the terms in the band, by bucket; where each bucket begins), as constants.

    What comes to the driver is bounded by the band, not by the corpus.
    """
    n = texts.count()
    counts = texts.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    inside = counts.where(F.col("docs").between(max(LEAST_DOCS, band[0] * n), max(LEAST_DOCS, band[1] * n)))
    found = sorted((r["term"] & (1 << BUCKET_BITS) - 1, r["term"]) for r in inside.select("term").collect())
    starts = [0] * ((1 << BUCKET_BITS) + 1)
    for at, _ in found:
        starts[at + 1] += 1
    for i in range(1 << BUCKET_BITS):
        starts[i + 1] += starts[i]
    return numbers([t for _, t in found], "long"), numbers(starts, "int")


def in_lexicon(found: Column, held: tuple[Column, Column]) -> Column:
    """The terms that the lexicon has, sorted."""
    hashes, starts = held

    def known(t: Column) -> Column:
        at = bucket(t).cast("int")
        first = F.element_at(starts, at + 1)
        return F.array_contains(F.slice(hashes, first + 1, F.element_at(starts, at + 2) - first), t)

    return F.array_sort(F.filter(found, known))


def halved(level: int):
    """The terms of a replica's subset that stay at a level: those with one more zero bit in its hash."""
    def stay(ts: Column, replica: Column) -> Column:
        return F.filter(ts, lambda t: F.xxhash64(t, replica.cast("long")).bitwiseAND(F.lit(1 << level)) == 0)
    return stay


def with_fingerprint(df: DataFrame, kept: str, whole: str, out: str) -> DataFrame:
    """Adds ``out``, the subset hashes of the terms in ``kept``.

    0 stands for a subset without terms; if all are, the hash ``whole`` of the text stands in
    every place, so texts that the lexicon says nothing of are alike only if they are equal.
    """
    df = df.withColumn("_set", F.array_repeat(F.col(kept), REPLICAS))
    for level in range(LEVELS):
        df = df.withColumn("_set", F.transform("_set", halved(level)))
        df = df.withColumn(f"_h{level}", F.transform("_set", lambda ts: F.when(F.size(ts) == 0, 0).otherwise(
            F.xxhash64(ts).bitwiseAND(F.lit((1 << 32) - 1)))))
    hashes = F.concat(*[F.col(f"_h{level}") for level in range(LEVELS)])
    df = df.withColumn(out, hashes).drop("_set", *[f"_h{level}" for level in range(LEVELS)])
    alone = F.array_repeat(F.col(whole).bitwiseAND(F.lit((1 << 32) - 1)), LEVELS * REPLICAS)
    return df.withColumn(out, F.when(F.array_max(out) == 0, alone).otherwise(F.col(out)))


def text_of(fingerprint: Column) -> Column:
    return F.lower(F.concat_ws("", F.transform(fingerprint, lambda h: F.lpad(F.hex(h), 8, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """Share of the subsets with terms in either text where both have the same hash."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(None)).otherwise((x == y).cast("int")))
    return F.aggregate(F.filter(both, lambda m: m.isNotNull()), F.lit(0), lambda n, m: n + m) / F.size(
        F.filter(both, lambda m: m.isNotNull()))


def in_slices_with_next(rows: DataFrame, slices: int) -> DataFrame:
    """Rows (key, text, ...) with ``slice`` and ``helper``.

    Slices are runs of keys at approximate quantiles. The first document of every slice, in
    descending order of keys, is repeated as a helper after the last of the slice above it (the
    very first one after the lowest), so every document meets its next one in its own slice.
    """
    cuts = rows.agg(F.percentile_approx("key", [i / slices for i in range(1, slices)], 10_000)).first()[0] if slices > 1 else []
    bounds = sorted(set(cuts or []))
    # Two steps of about the root of the slices each: which run of bounds, which bound in it.
    step = max(1, int(len(bounds) ** 0.5))
    runs = [bounds[i:i + step] for i in range(0, len(bounds), step)]
    key = F.col("key")

    def numbers(values: list[int]) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values])

    if runs:
        run = F.size(F.filter(numbers([r[0] for r in runs]), lambda b: b <= key))
        inner = F.size(F.filter(F.element_at(F.array(*map(numbers, runs)), F.greatest(run, F.lit(1))), lambda b: b <= key))
        where = F.greatest(run - 1, F.lit(0)) * step + inner
    else:
        where = F.lit(0)
    placed = rows.withColumn("slice", where.cast("int"))
    tops = {r["slice"]: r["top"] for r in placed.groupBy("slice").agg(F.max("key").alias("top")).collect()}  # one row a slice
    if not tops:
        return placed.withColumn("helper", F.lit(False))
    filled = sorted(tops)
    above = dict(zip(filled, [*filled[1:], filled[0]]))
    n = max(filled) + 1
    top = F.element_at(numbers([tops.get(s, 0) for s in range(n)]), F.col("slice") + 1)
    target = F.element_at(F.array(*[F.lit(above.get(s, 0)) for s in range(n)]), F.col("slice") + 1)
    own = F.struct(F.col("slice"), F.lit(False).alias("helper"))
    homes = F.when(key == top, F.array(own, F.struct(target.alias("slice"), F.lit(True).alias("helper")))).otherwise(F.array(own))
    return placed.withColumn("home", F.explode(homes)).drop("slice").select("*", "home.*").drop("home")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 band: tuple[float, float] = BAND) -> DataFrame:
    """One row per document: fingerprints of its text and of its edited text, and likenesses.

    The edited text is the text with its last half (rounded down) of code points replaced by as
    many first ones, or all, of the next document in descending order of ids; after the last comes
    the first. Null texts are empty; null ids come last; rows with the same id follow the order
    of their texts' hash; a single document is its own next one; an empty table gives no rows;
    other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn(
        "key", F.coalesce("doc_id", F.lit(NULL_ID)))
    placed = in_slices_with_next(rows, SLICES * partitions(spark)).withColumn("tie", F.xxhash64("text"))
    order = Window.partitionBy("slice").orderBy("helper", F.desc("key"), "tie")
    half = F.floor(F.length("text") / 2).cast("int")
    held = lexicon(rows.select("text"), band)
    seen = (placed.withColumn("next", F.coalesce(F.lead("text").over(order), F.lit("")))
            .withColumn("n_chars", F.length("text").cast("long"))
            .withColumn("edited", F.concat(F.col("text").substr(F.lit(1), F.length("text") - half),
                                           F.col("next").substr(F.lit(1), half)))
            .select("slice", "helper", "key", "tie", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                    F.xxhash64("edited").alias("edited_tie"), in_lexicon(terms(F.col("text")), held).alias("kept"),
                    in_lexicon(terms(F.col("edited")), held).alias("edited_kept")))
    marked = reduce(lambda df, x: with_fingerprint(df, *x), [("kept", "tie", "print"), ("edited_kept", "edited_tie", "edited_print")],
                    seen).drop("kept", "edited_kept")
    return (marked.withColumn("next_print", F.lead("print").over(order)).where("not helper")
            .select("doc_id", "n_chars", "edited_sha256", text_of(F.col("print")).alias("fingerprint"),
                    text_of(F.col("edited_print")).alias("edited_fingerprint"),
                    likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
                    likeness(F.col("print"), F.col("next_print")).alias("near_next")))
