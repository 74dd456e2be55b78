"""Operator 10: packing token sequences by cutting-stock column generation.

1. Every document is encoded once. Its blocks of ``size`` tokens are sequences of their own;
   the rest (under ``size``) is an item.
2. Spark counts the items by length class (``size / unit`` classes, whatever the input), and
   the driver solves the cutting-stock program on that histogram (``cutting_stock``).
3. Items are ranked within their class by counts per (class, slice) and their prefix sums; the
   rounded patterns own runs of ranks, so a document finds its sequence from its rank alone.
4. What rounding leaves over (fewer bins than there are classes) is laid end to end and cut at
   every ``size`` tokens, the last stretch into powers of two, so it needs no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctrkit.llm import cutting_stock
from ctrkit.llm.bpe import UnitEncoder
from ctrkit.llm.common import in_slices, partitions, texts_of, written

SIZE = 2048
#: Tokens by which length classes step; an item counts as its class's largest length.
UNIT = 8
#: The part of all tokens that rounding up to units may waste; lengths that are classes of their own among the
#: fine ones, which are taken where it wastes more.
WASTE, EXACT = 0.005, 32
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int, size: int,
            id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, doc_tokens, crcs): token count with the end id, crc32 of each block in turn."""
    def encode(batches):
        encoder = UnitEncoder(tokenizer_path)
        for batch in in_slices(batches, "text"):
            flat, offsets = encoder.encode(texts_of(batch, "text"))
            sizes, crcs = [], []
            for a, b in zip(offsets, offsets[1:]):
                ids = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                sizes.append(len(ids))
                crcs.append([zlib.crc32(ids[i:i + size].tobytes()) for i in range(0, len(ids), size)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))],
                ["doc_id", "doc_tokens", "crcs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, doc_tokens long, crcs array<long>")


def rest_ids(docs: DataFrame, tokenizer_path: str, end_id: int, size: int,
             id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, doc_tokens, crc, ids): the ids after the last whole block, little-endian."""
    def encode(batches):
        encoder = UnitEncoder(tokenizer_path)
        for batch in in_slices(batches, "text"):
            flat, offsets = encoder.encode(texts_of(batch, "text"))
            sizes, crcs, rests = [], [], []
            for a, b in zip(offsets, offsets[1:]):
                ids = np.append(flat[a:b], np.uint32(end_id)).astype("<u4")
                rest = ids[len(ids) // size * size:].tobytes()
                sizes.append(len(ids))
                crcs.append(zlib.crc32(rest))
                rests.append(rest)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()),
                 pa.array(rests, pa.binary())], ["doc_id", "doc_tokens", "crc", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, doc_tokens long, crc long, ids binary").distinct()


def ranked(rows: DataFrame, group: str, amount, slices: int) -> DataFrame:
    """Adds ``before``: the sum of ``amount`` over the rows ahead of a row in its group.

    Order: slice (a hash of the id), then id. Windows run within (group, slice), and the
    slices' totals are summed up in turn, so a hot group is split over all slices.
    """
    cut = rows.withColumn("slice", F.pmod(F.xxhash64("doc_id", "doc_tokens"), F.lit(slices)))
    own = Window.partitionBy(group, "slice").orderBy("doc_id", "doc_tokens", "crcs")
    local = cut.withColumn("within", F.sum(amount).over(own.rowsBetween(Window.unboundedPreceding, 0)) - amount)
    turn = Window.partitionBy(group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ahead = (cut.groupBy(group, "slice").agg(F.sum(amount).alias("total"))
             .select(group, "slice", F.coalesce(F.sum("total").over(turn), F.lit(0)).alias("ahead")))
    return (local.join(ahead, [group, "slice"])
            .withColumn("before", (F.col("ahead") + F.col("within")).cast("long"))
            .drop("slice", "within", "ahead"))


def fine(length: int) -> int:
    """The class of a length among the fine ones: itself up to ``EXACT``, above a step of at most a part in
    ``EXACT`` more."""
    step = 1 << max(0, (length // EXACT).bit_length() - 1)
    return -(-length // step) * step


def class_sizes(lengths: dict[int, int], tokens: int, unit: int, size: int) -> dict[int, int]:
    """The class, in tokens, that every length is rounded up to.

    Multiples of ``unit`` if they waste at most ``WASTE`` of all tokens, as with long documents;
    else the lengths themselves, if there are few, or the fine classes.
    """
    coarse = {n: -(-n // unit) * unit for n in lengths}
    if sum((coarse[n] - n) * k for n, k in lengths.items()) <= WASTE * tokens:
        return coarse
    return {n: n if len(lengths) <= size // unit else min(size, fine(n)) for n in lengths}


def plan_patterns(histogram: dict[int, int], size: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs of ranks (class, first rank, rank after the last, first sequence, places) and the
    number of sequences, from the counts by class."""
    sizes = np.array(sorted(histogram), np.int64)
    demands = np.array([histogram[int(s)] for s in sizes], np.int64)
    # The knapsack runs over multiples of what all classes have in common.
    unit = int(np.gcd.reduce([*sizes.tolist(), size])) if len(sizes) else 1
    patterns, x = cutting_stock.solve(sizes // unit, demands, size // unit)
    times = cutting_stock.rounded(patterns, x, demands)
    runs, taken, sequence = [], np.zeros(len(sizes), np.int64), 0
    for pattern, n in zip(patterns, times):
        if n == 0:
            continue
        for i in np.flatnonzero(pattern):
            upto = min(int(demands[i]), int(taken[i] + n * pattern[i]))
            if upto > taken[i]:
                runs.append((int(sizes[i]), int(taken[i]), upto, sequence, int(pattern[i])))
            taken[i] = upto
        sequence += int(n)
    return runs, sequence


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, size: int = SIZE, unit: int = UNIT,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, in ``COLUMNS``: which ids of which document lie where in which sequence.

    Every sequence holds at most ``size`` tokens, offsets are gapless from 0, and each id,
    the end id of every document included, lies in one piece. Null and empty texts are the
    end id alone; repeated rows are packed each; rows with a null id too; an empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    slices = partitions(spark)
    args = tokenizer_path, end_id, size, id_col, text_col
    lengths = written(encoded(docs, *args), "packing-lengths")
    whole = F.floor(F.col("doc_tokens") / size).cast("long")
    rest = F.col("doc_tokens") - whole * size
    items = lengths.where(rest > 0).select("doc_id", "doc_tokens", "crcs", (whole * size).alias("start"), rest.alias("length"))
    # At most ``size`` lengths.
    counts = {r["length"]: (r["n"], r["tokens"]) for r in items.groupBy("length").agg(
        F.count(F.lit(1)).alias("n"), F.sum("doc_tokens").alias("tokens")).collect()}
    classes = class_sizes({k: n for k, (n, _) in counts.items()}, sum(t for _, t in counts.values()), unit, size)
    of_length = F.broadcast(spark.createDataFrame(list(classes.items()), "length long, class int"))
    items = items.join(of_length, "length").select("doc_id", "doc_tokens", "crcs", "start", "length", "class")
    histogram: dict[int, int] = {}
    for length, (n, _) in counts.items():
        histogram[classes[length]] = histogram.get(classes[length], 0) + n
    runs, sequences = plan_patterns(histogram, size)

    # At most a run for each class of each pattern in the basis: bounded by size and unit.
    table = F.broadcast(spark.createDataFrame(
        runs, "class int, lo long, hi long, first long, places long"))
    placed = written(
        ranked(items, "class", F.lit(1), slices).alias("i").join(
            table.alias("t"), (F.col("i.class") == F.col("t.class")) & (F.col("before") >= F.col("lo"))
            & (F.col("before") < F.col("hi")), "left")
        .select("doc_id", "start", "length", "doc_tokens", F.element_at("crcs", -1).alias("ids_crc32"),
                "i.class", "before",
                (F.col("first") + F.floor((F.col("before") - F.col("lo")) / F.col("places"))).alias("sequence_id")),
        "packing-items")
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "before")
    packed = placed.where("sequence_id is not null").withColumn(
        "offset", F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))

    blocks = (ranked(lengths.where(whole > 0).withColumn("all", F.lit(0)), "all", whole, slices)
              .select("doc_id", "doc_tokens", "before", F.posexplode(F.slice("crcs", 1, whole.cast("int"))))
              .select("doc_id", (F.col("pos") * F.lit(size).cast("long")).alias("start"),
                      F.lit(size).cast("long").alias("length"), F.col("col").alias("ids_crc32"), "doc_tokens",
                      (F.col("before") + F.col("pos") + F.lit(sequences)).alias("sequence_id"),
                      F.lit(0).cast("long").alias("offset")))
    n_blocks = lengths.agg(F.sum(whole)).first()[0] or 0

    loose = cut_rest(placed.where("sequence_id is null"), docs, args, sequences + n_blocks)
    return packed.select(*COLUMNS).unionByName(blocks.select(*COLUMNS)).unionByName(loose.select(*COLUMNS))


def cut_rest(left: DataFrame, docs: DataFrame, args: tuple, first: int) -> DataFrame:
    """Lay the left-over items end to end and cut them; their number is bounded by the classes."""
    tokenizer_path, end_id, size, id_col, text_col = args
    line = Window.orderBy("class", "before")
    laid = left.withColumn("from", F.sum("length").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length"))
    total = left.agg(F.sum("length")).first()[0] or 0
    tail = total - total % size
    cuts = [(i, size * i, size * (i + 1)) for i in range(tail // size)]
    for power in range(size.bit_length() - 1, -1, -1):
        if total % size >> power & 1:
            cuts.append((len(cuts), tail, tail + (1 << power)))
            tail += 1 << power
    table = F.broadcast(docs.sparkSession.createDataFrame(cuts, "bin long, lo long, hi long"))  # as bounded
    pieces = laid.join(table, (F.col("from") < F.col("hi")) & (F.col("from") + F.col("length") > F.col("lo"))).select(
        "doc_id", "doc_tokens", F.col("ids_crc32").alias("crc"), "start",
        F.greatest("from", "lo").alias("a"), F.least(F.col("from") + F.col("length"), "hi").alias("b"), "from", "lo",
        (F.col("bin") + F.lit(first)).alias("sequence_id"))
    wanted = F.broadcast(left.select(F.col("doc_id").alias("want")).distinct())
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    texts = rest_ids(rows.join(wanted, F.col("id").eqNullSafe(F.col("want")), "left_semi"), tokenizer_path, end_id, size,
                     "id", "text")
    at = (F.col("a") - F.col("from")).cast("int")
    n = (F.col("b") - F.col("a")).cast("int")
    return pieces.alias("p").join(
        texts.alias("t"), F.col("p.doc_id").eqNullSafe(F.col("t.doc_id"))
        & (F.col("p.doc_tokens") == F.col("t.doc_tokens")) & (F.col("p.crc") == F.col("t.crc"))).select(
        "p.doc_id", (F.col("start") + at).alias("start"), n.cast("long").alias("length"),
        F.crc32(F.col("ids").substr(at * 4 + 1, n * 4)).alias("ids_crc32"), "p.doc_tokens", "sequence_id",
        (F.col("a") - F.col("lo")).alias("offset"))
