"""Operator 7: SimHash near-duplicates with pivot distance tables.

1. A fingerprint per document (64 bits, majority over the hashes of its word shingles).
2. Equal fingerprints are one class; only classes go on, so copies never meet pairwise.
3. Fingerprints at most ``radius`` bits apart agree in at least ``parts - radius`` of
   ``parts`` bit blocks. Each class is filed under every choice of that many blocks: two linked
   classes share a file, and a file is an equi-join key that Spark can partition by.
4. In a file, the Hamming distances of all members to the reference fingerprints (the pivots)
   are tabled. By the triangle inequality a pair whose coordinates differ by more than the
   radius anywhere cannot link; survivors are verified bit by bit. Only a spanning forest of
   the links leaves the task, so a dense group of n classes gives under n edges.
5. A file of more than ``CELL`` classes is cut into chunks and every pair of chunks is a task
   of its own: no group of any size sits in one task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctrkit.llm.common import in_slices, written
from ctrkit.llm.components import connected

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 3
#: Bit blocks of a fingerprint and how many must agree: 20 files of at least 31 bits each.
PARTS = 6
#: Number of reference fingerprints, and the most classes of one file that a task compares.
PIVOTS = 24
CELL = 4096
#: Rows of a pair table that are held at a time.
PAIRS_AT_ONCE = 1 << 20


def fingerprint(words: list[bytes], shingle: int = SHINGLE_WORDS) -> int:
    """Majority of the bits of XXH64 over all shingles; fewer words are one shingle, none give 0."""
    from xxhash import xxh64_intdigest as xxh
    if not words:
        return 0
    if len(words) <= shingle:
        return xxh(b" ".join(words), SEED)
    runs = zip(*(words[i:] for i in range(shingle)))
    hashes = np.fromiter((xxh(b" ".join(run), SEED) for run in runs), np.uint64, len(words) - shingle + 1)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes.

    Bit k of every byte is one lane of an 8-lane counter; blocks of 255 cannot overflow a lane.
    """
    lanes = np.uint64(0x0101010101010101)
    cuts = np.arange(0, len(hashes), 255)
    result = 0
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lanes, cuts)
        counts = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
        for byte in np.flatnonzero(counts * 2 > len(hashes)):
            result |= 1 << (8 * int(byte) + k)
    return result


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE_WORDS) -> DataFrame:
    """Rows (id, fp): the fingerprint, as a signed 64-bit integer, of every whole text.

    Words are runs other than ASCII white space, A-Z lower-cased; a null or wordless text
    has fingerprint zero. Rows are kept as they are, repeated ids too.
    """
    def score(batches):
        for batch in in_slices(batches, "text"):
            raw = pc.fill_null(batch.column("text").cast(pa.binary()), b"")
            fps = [fingerprint(text.lower().split(), shingle) for text in raw.to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, "id long, fp long")


def bit_blocks(parts: int) -> list[tuple[int, int]]:
    """(first bit, width) of each block; widths differ by one at most."""
    edges = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def files_of(fp, parts: int = PARTS, radius: int = RADIUS):
    """Column: the file keys of a fingerprint, one per choice of blocks that must agree."""
    keys = []
    for n, choice in enumerate(combinations(bit_blocks(parts), parts - radius)):
        mask = sum(((1 << width) - 1) << first for first, width in choice)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(n).alias("file"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*keys)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def pivot_table(fps: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Hamming distances of every fingerprint to the reference fingerprints (fixed by the seed)."""
    from xxhash import xxh64_intdigest as xxh
    refs = np.array([xxh(str(i).encode(), SEED) for i in range(pivots)], np.uint64)
    return popcount(fps[:, None] ^ refs[None, :])


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Spanning forest, as index pairs, of the links between distinct fingerprints.

    Members are ordered by their distance to the first pivot, so that a member meets only
    those whose first coordinate is at most ``radius`` further; the other coordinates discard
    pairs next, and the survivors' own distance decides.
    """
    n = len(fps)
    table = pivot_table(fps)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    reach = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    edges = []
    i = 0
    while i < n:
        # A run of members whose pairs fit the bound.
        stop = i + 1
        total = reach[i] - i
        while stop < n and total + reach[stop] - stop <= PAIRS_AT_ONCE // table.shape[1]:
            total += reach[stop] - stop
            stop += 1
        mine = np.arange(i, stop)
        counts = reach[i:stop] - mine - 1
        a = np.repeat(mine, counts)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(counts) - counts, counts)
        keep = np.abs(table[a] - table[b]).max(axis=1, initial=0) <= radius
        a, b = a[keep], b[keep]
        keep = popcount(fps[a] ^ fps[b]) <= radius
        for x, y in zip(a[keep].tolist(), b[keep].tolist()):
            rx, ry = root(x), root(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                edges.append((int(order[x]), int(order[y])))
        i = stop
    return edges


def links(classes: DataFrame, parts: int = PARTS, radius: int = RADIUS, cell: int = CELL) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that connect what links connect."""
    key = ["file", "bits"]
    filed = classes.select("fp", F.explode(files_of(F.col("fp"), parts, radius)).alias("k")).select("fp", "k.*")
    own = Window.partitionBy(*key)
    placed = (filed
              .withColumn("n", F.count(F.lit(1)).over(own)).where("n > 1")
              .withColumn("chunk", F.floor((F.row_number().over(own.orderBy("fp")) - 1) / cell).cast("int"))
              .withColumn("chunks", F.ceil(F.col("n") / cell).cast("int")))
    cells = placed.select(
        "fp", *key, "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")).select(
        "fp", *key, F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    spark = classes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = [*key, "lo", "hi"]
    dealt = cells.repartition(n, *cut).sortWithinPartitions(*cut)

    def compare(batches):
        from itertools import chain
        held = None
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows == 0:
                continue
            rows = held
            if batch is not None:
                cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*cut, "fp")]
                rows = [np.concatenate(x) for x in zip(held, cols)] if held else cols
            if rows is None:
                continue
            n_rows = len(rows[0])
            new = np.ones(n_rows, bool)
            new[1:] = np.any([c[1:] != c[:-1] for c in rows[:-1]], axis=0)
            starts = np.append(np.flatnonzero(new), n_rows)
            # The last group may go on in the next batch.
            done = len(starts) - 1 if batch is None else len(starts) - 2
            fps = rows[-1].astype(np.int64)
            out = []
            for a, b in zip(starts[:done], starts[1:done + 1]):
                if b - a > 1:
                    group = fps[a:b]
                    out += [(int(group[x]), int(group[y])) for x, y in forest(group.view(np.uint64), radius)]
            if out:
                u, v = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
            held = None if batch is None else [c[starts[done]:] for c in rows]

    return dealt.mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    radius: int = RADIUS) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one per input row.

    ``fingerprint`` is the 64-bit integer; ``component_id`` the least id reachable over links
    of at most ``radius`` differing bits, the row itself included. A null or wordless text has
    fingerprint zero and links like any other; rows with a null id take part, but a component
    of null ids alone has a null component_id; repeated ids keep a row each; an empty table
    gives no rows; other columns are ignored.
    """
    prints = written(fingerprints(docs, id_col, text_col), "simhash")
    classes = prints.groupBy("fp").agg(F.min("id").alias("least"))
    edges = links(classes.select("fp"), radius=radius)
    roots = connected(edges)
    grouped = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(grouped.join(least, "root").select("fp", "component_id"), "simhash-classes")
    return prints.join(named, "fp").select(
        F.col("id").alias("doc_id"), F.col("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs``, all columns, with one document of each group: the one of the least id.

    Rows that share an id count as one document, and one of them stays; rows without an id cannot
    be told apart and all stay.
    """
    found = near_duplicates(docs, id_col, text_col, radius)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return (docs.join(keep, id_col, "left_semi").dropDuplicates([id_col])
            .unionByName(docs.where(F.col(id_col).isNull())))
