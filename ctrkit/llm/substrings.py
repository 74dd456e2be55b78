"""Operator 9: repeated passages by seed and extend on winnowed anchors.

A window is ``window`` consecutive words; a word goes if a window over it also starts earlier.

1. Seeds: winnowing. Of the ``window - gram + 1`` word grams in a window the one with the least
   hash is its anchor, so equal windows have equal anchors at equal places. The windows of a
   document fall into runs that share an anchor.
2. Extend: the words of such a run, all its windows' words to the left and right of the anchor,
   are hashed as one segment. Rows meet on the anchor; equal segments repeat each other in full,
   and all but the earliest are removed.
3. Segments that share the anchor but differ somewhere may still share single windows: the
   earliest of each is extended window by window, and windows meet on their own hashes.

Rows with equal keys are cut down to the earliest one before each shuffle, so a passage in a
third of all documents leaves a task once per batch of texts. Keys are pairs of 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ctrkit.llm.common import in_slices, written

WINDOW = 20
#: Words of an anchor gram.
GRAM = 6
#: Odd bases of the two polynomial hashes, and the id that stands for a null one.
BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
NULL_ID = -(1 << 63)
ROWS = "k1 long, k2 long, doc long, at long, later boolean"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words in turn, offsets of the texts in them); words are runs of other than ASCII white space."""
    split = pc.ascii_split_whitespace(texts)
    flat = split.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    starts = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    return flat.filter(pa.array(full)), np.concatenate([[0], np.cumsum(full)])[starts]


class Hashes:
    """Hashes of any stretch of the words in constant time, from prefix sums of a polynomial."""

    def __init__(self, words: pa.Array, base: int):
        from xxhash import xxh3_64_intdigest as xxh
        coded = pc.dictionary_encode(words)
        own = np.fromiter((xxh(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
        n = len(words)
        powers = np.full(n + 1, base, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(own[coded.indices.to_numpy()] * powers[:n], out=self.prefix[1:])
        back = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        back[0] = 1
        self.back = np.cumprod(back)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.back[start])


def window_starts(offsets: np.ndarray, window: int) -> np.ndarray:
    """Where a whole window of one document starts."""
    n = np.maximum(np.diff(offsets) - window + 1, 0)
    return np.repeat(offsets[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def anchors(hashes: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each window start the first place of the least of the next ``width`` gram hashes."""
    place = np.arange(len(hashes))
    reach = 1
    while reach < width:
        step = min(reach, width - reach)
        other = np.minimum(np.arange(len(hashes)) + step, len(hashes) - 1)
        other = place[other]
        place = np.where(hashes[other] < hashes[place], other, place)
        reach += step
    return place[starts]


def earliest(k1, k2, doc, at) -> pa.RecordBatch:
    """Rows for the shuffle: of equal keys the earliest (document, place); the others are later ones."""
    order = np.lexsort((at, doc, k2, k1))
    k1, k2, doc, at = k1[order], k2[order], doc[order], at[order]
    head = np.ones(len(k1), bool)
    head[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(head) else np.zeros(0, int)
    later = (doc != doc[first]) | (at != at[first])
    use = head | later  # a repeated row adds nothing
    # Later ones only pass through: their keys spread them.
    spread = mix(np.arange(len(k1), dtype=np.uint64) ^ mix(doc.view(np.uint64)))
    k1 = np.where(later, spread, k1)
    columns = [pa.array(k1[use].view(np.int64)), pa.array(np.where(later, np.uint64(0), k2)[use].view(np.int64)),
               pa.array(doc[use]), pa.array(at[use]), pa.array(later[use])]
    return pa.RecordBatch.from_arrays(columns, ["k1", "k2", "doc", "at", "later"])


def packed(start: np.ndarray, n: np.ndarray, window: int) -> np.ndarray:
    """One long for ``n`` (1 to ``window``) window starts in a row from ``start``."""
    return start * window + (n - 1)


def segment_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Seeds with their segments: key 1 the anchor's hash, key 2 the segment's."""
    def seed(batches):
        for batch in in_slices(batches, "text"):
            words, offsets = words_of(batch.column("text"))
            starts = window_starts(offsets, window)
            if not len(starts):
                continue
            hashes = Hashes(words, BASES[0])
            grams = np.arange(max(0, len(words) - gram + 1))
            place = anchors(hashes.of(grams, grams + gram), starts, window - gram + 1)
            row = np.searchsorted(offsets, starts, side="right") - 1
            cut = np.ones(len(starts), bool)
            cut[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
            a = np.flatnonzero(cut)
            b = np.append(a[1:], len(starts)) - 1
            first, last, anchor, row = starts[a], starts[b], place[a], row[a]
            shape = ((anchor - first) * 4 * window + (last - first)).astype(np.uint64)
            segment = mix(hashes.of(first, last + window) ^ mix(shape))
            doc = batch.column("doc").to_numpy()[row]
            at = packed(first - offsets[row], last - first + 1, window)
            yield earliest(hashes.of(anchor, anchor + gram), segment, doc, at)

    return docs.mapInArrow(seed, ROWS)


def window_rows(docs: DataFrame, window: int) -> DataFrame:
    """The windows at the packed places ``ats`` of each document; the keys are two hashes of one."""
    def extend(batches):
        for batch in in_slices(batches, "text", 4 << 20):
            words, offsets = words_of(batch.column("text"))
            lists = batch.column("ats")
            per = pc.list_value_length(lists).to_numpy()
            ats = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), per)
            first, n = ats // window, ats % window + 1
            start = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            row = np.repeat(row, n)
            # Rows that share an id also share places, which a shorter one may not have.
            keep = start + window <= np.diff(offsets)[row]
            start, row = start[keep], row[keep]
            if not len(start):
                continue
            at = offsets[row] + start
            keys = [Hashes(words, base).of(at, at + window) for base in BASES]
            yield earliest(*keys, batch.column("doc").to_numpy()[row], packed(start, np.ones_like(start), window))

    return docs.mapInArrow(extend, ROWS)


def kept_words(docs: DataFrame, window: int) -> DataFrame:
    """What is left of each document without the windows at ``ats``."""
    def cut(batches):
        for batch in in_slices(batches, "text"):
            out = {c: [] for c in ("n_words", "n_removed", "kept_sha256", "kept")}
            for text, ats in zip(batch.column("text").to_pylist(), batch.column("ats")):
                words = text.encode().split()
                n = len(words)
                if ats.is_valid and len(ats.values):
                    ats = ats.values.to_numpy()
                    first = ats // window
                    change = np.bincount(np.minimum(first, n), minlength=n + 1)
                    change = change - np.bincount(np.minimum(first + ats % window + window, n), minlength=n + 1)
                    gone = np.cumsum(change)[:n] > 0
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(words)
                out["n_words"].append(n)
                out["n_removed"].append(n - len(words))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
                 pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    return docs.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, text string")


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256, text), one per input row.

    ``text`` is the kept words joined by one space, ``kept_sha256`` its hash. A null text has no
    words; texts shorter than a window lose none; a null id counts as the least. Rows that
    share an id count as one document told several times: their windows start at the same
    places, so none is earlier than another at its own place, and what one loses they all lose.
    An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn(
        "doc", F.coalesce("id", F.lit(NULL_ID)))
    texts = rows.select("doc", "text")

    turn = Window.partitionBy("k1", "k2").orderBy("doc", "at")
    same = Window.partitionBy("k1")
    met = (segment_rows(texts, window, gram)
           .withColumn("differ", F.min("k2").over(same) < F.max("k2").over(same))
           .withColumn("later", F.col("later") | (F.rank().over(turn) > 1)))
    spans = written(met.where("later or differ").select("doc", "at", "later"), "segments")

    grouped = spans.where("not later").groupBy("doc").agg(F.collect_list("at").alias("ats"))
    windows = (window_rows(texts.join(grouped, "doc"), window)
               .withColumn("later", F.col("later") | (F.rank().over(turn) > 1))
               .where("later").select("doc", "at"))
    gone = spans.where("later").select("doc", "at").unionByName(windows)
    return kept_words(rows.join(gone.groupBy("doc").agg(F.collect_list("at").alias("ats")), "doc", "left"), window)
