"""Operator 3: benchmark decontamination by a BM25 index of the test items and block-max WAND.

The index holds the items' terms with their BM25 impacts, scaled so that an item scores 1 on
itself; its posting lists are in item order and cut into blocks, each with its greatest impact.
Every training text is cut into overlapping passages, and every passage is a query:

1. A passage whose terms' greatest impacts, block by block, cannot sum up to the threshold is
   done with (the block-max bound for all lists at once; most passages end here).
2. Block-max WAND walks the lists of the others: the pivot is the first list where the running
   sum of the lists' bounds reaches the threshold; if the bounds of the blocks around the pivot
   item still reach it, the item is scored, and if not, all lists jump past these blocks. Every
   item that scores the threshold or more is retrieved.
3. A retrieved item is verified against the whole text: it is there if enough of its five-word
   shingles are, even with the last sentence (the answer) altered or cut off, or if enough of the
   question's and of the answer's are, wherever in the text each of them stands.

The index is built in blocks of ``INDEX_ITEMS`` items, one after another, with the rows written between
two of them, so what a task and the driver hold is bounded however many items there are.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrkit.llm.common import in_slices, texts_of, written

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach to retrieve it. A part that may score
#: less with enough of its shingles (``most_gone``) has its impacts scaled up to reach it then.
LEAST_SCORE = 0.7
#: Words of a shingle and the share of shingles that must be found.
SHINGLE, LEAST_OVERLAP = 5, 0.8
#: Words of half a passage; two halves in a row are a passage. An item longer than a half is
#: indexed in parts of that many words.
HALF = 64
#: Postings of one block, and items of one index.
BLOCK = 16
INDEX_ITEMS = 20_000
#: Parts of one range of the bound over all lists at once, and the ranges there are at most.
RANGE, RANGES = 2, 128
WORD = re.compile(r"\w+")
OVERLAPS = "overlap", "question_overlap", "answer_overlap"


def terms_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words of all but the last sentence, and of the last; a single sentence is cut in half."""
    sentences = [w for w in map(terms_of, re.split(r"(?<=[.!?])\s+", text)) if w]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    words = sentences[0] if sentences else []
    return words[:(len(words) + 1) // 2], words[(len(words) + 1) // 2:]


def shingles(words: list[str], n: int = SHINGLE) -> set[tuple[str, ...]]:
    """Runs of ``n`` words; fewer words are one run, none give none."""
    if not words:
        return set()
    return {tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))}


def most_gone(words: list[str]) -> int:
    """Words that the best copied part of an item may lack, at most, with ``LEAST_OVERLAP`` of the item's shingles.

    Every missing shingle takes one word along at most (at the ends; fewer in between), and repeated
    shingles go together. Of the whole parts, one lacks no more than its share.
    """
    distinct = len(shingles(words))
    missing = distinct - math.ceil(LEAST_OVERLAP * distinct - 1e-9)
    repeated = max(1, len(words) - SHINGLE + 1) - distinct
    return (missing + repeated if missing else 0) // max(1, len(words) // HALF)


class Index:
    """Posting lists with impacts over item parts; ``items`` are (id, text)."""

    def __init__(self, items: list[tuple[int, str]], block: int = BLOCK):
        self.parts: list[tuple[int, str, list[str]]] = []  # item, its whole text, words of the part
        gone: list[int] = []  # words that a copy of the part may lack
        for item, text in items:
            words = terms_of(text)
            gone += [most_gone(words)] * -(-len(words) // HALF)
            for at in range(0, len(words), HALF):
                # A short tail is part of the last whole one's overlap.
                self.parts.append((item, text, words[max(0, min(at, len(words) - HALF)):at + HALF]))
        n = len(self.parts)
        found = Counter(t for _, _, words in self.parts for t in set(words))
        mean = sum(len(w) for _, _, w in self.parts) / max(1, n)
        lists: dict[str, list[tuple[int, float]]] = {}
        for i, (_, _, words) in enumerate(self.parts):
            weights = {t: math.log(1 + (n - found[t] + 0.5) / (found[t] + 0.5))
                       * c * (K1 + 1) / (c + K1 * (1 - B + B * len(words) / mean)) for t, c in Counter(words).items()}
            own = sum(weights.values())
            left = 1 - sum(sorted(weights.values(), reverse=True)[:gone[i]]) / own
            own *= min(1.0, max(left, 1e-3) / LEAST_SCORE)
            for t, w in weights.items():
                lists.setdefault(t, []).append((i, w / own))
        self.term_ids = {t: i for i, t in enumerate(lists)}
        self.docs = [[d for d, _ in p] for p in lists.values()]
        self.impacts = [[w for _, w in p] for p in lists.values()]
        self.block = block
        self.block_max = [[max(w[i:i + block]) for i in range(0, len(w), block)] for w in self.impacts]
        self.list_max = [max(w) for w in self.impacts]
        # Greatest impact of each term in each range of parts, for the bound over all lists at once.
        self.range = max(RANGE, -(-n // RANGES))
        self.range_max = np.zeros((len(lists) + 1, -(-n // self.range) if n else 0), np.float32)
        for t, (docs, impacts) in enumerate(zip(self.docs, self.impacts)):
            np.maximum.at(self.range_max[t], np.array(docs) // self.range, impacts)

    def wand(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """(part, score) of all parts whose score on these distinct terms is ``least`` or more."""
        out = []
        lists = [[self.docs[t][0], t, 0] for t in terms]  # current part, term, position
        end = len(self.parts)
        slack = least - 1e-9

        def seek(cursor: list, part: int) -> None:
            docs = self.docs[cursor[1]]
            cursor[2] = bisect_left(docs, part, cursor[2])
            cursor[0] = docs[cursor[2]] if cursor[2] < len(docs) else end

        while True:
            lists = sorted(c for c in lists if c[0] < end)
            total, pivot = 0.0, -1
            for i, c in enumerate(lists):
                total += self.list_max[c[1]]
                if total >= slack:
                    pivot = i
                    break
            if pivot < 0:
                return out
            part = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == part:
                pivot += 1
            # Bounds of the blocks where the part would stand, and where those blocks end.
            bound, edge = 0.0, end
            for c in lists[:pivot + 1]:
                docs = self.docs[c[1]]
                at = bisect_left(docs, part, c[2])
                if at < len(docs):
                    b = at // self.block
                    bound += self.block_max[c[1]][b]
                    edge = min(edge, docs[min(len(docs), (b + 1) * self.block) - 1] + 1)
            if bound < slack:
                # Nothing before the first block's edge, or before the next list's part, can score enough.
                skip = max(part + 1, min(edge, lists[pivot + 1][0] if pivot + 1 < len(lists) else end))
                for c in lists[:pivot + 1]:
                    seek(c, skip)
                continue
            if lists[0][0] == part:
                score = sum(self.impacts[c[1]][c[2]] for c in lists[:pivot + 1])
                if score >= slack:
                    out.append((part, float(score)))
                for c in lists[:pivot + 1]:
                    seek(c, part + 1)
            else:
                for c in lists[:pivot]:
                    if c[0] < part:
                        seek(c, part)

    def verified(self, part: int, words: list[str], here: set[tuple[str, ...]]) -> tuple[float, float, float] | None:
        """Overlaps (whole, question, answer) of the part's item with these words, whose shingles are ``here``,
        or none if too little."""
        text = self.parts[part][1]
        whole = overlap_with(terms_of(text), words, here)
        if whole < LEAST_OVERLAP and len(terms_of(text)) < SHINGLE:
            return None
        question, answer = (overlap_with(x, words, here) for x in question_and_answer(text))
        return (whole, question, answer) if whole >= LEAST_OVERLAP or min(question, answer) >= LEAST_OVERLAP else None


def overlap_with(own: list[str], words: list[str], here: set[tuple[str, ...]]) -> float:
    """Share of the shingles of ``own`` in a text; fewer words than a shingle must stand there in a row."""
    if not own:
        return 0.0
    if len(own) < SHINGLE:
        run, first = tuple(own), own[0]
        return float(any(w == first and tuple(words[i:i + len(run)]) == run for i, w in enumerate(words)))
    mine = shingles(own)
    return len(mine & here) / len(mine)


def passages(index: Index, texts: pa.Array, least: float) -> dict[int, dict[int, tuple[float, float, float]]]:
    """By the row of every text that holds items: the items and their overlaps (whole, question, answer)."""
    joined = pc.utf8_lower(texts).to_pylist()
    words = [WORD.findall(t) for t in joined]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    none = len(index.term_ids)
    get = index.term_ids.get
    ids = np.fromiter(map(get, chain.from_iterable(words), repeat(none)), np.int64, int(sizes.sum()))
    row = np.repeat(np.arange(len(words)), sizes)
    first = np.cumsum(sizes) - sizes
    halves = -(-sizes // HALF)
    half_first = np.cumsum(halves) - halves
    half = half_first[row] + (np.arange(len(ids)) - first[row]) // HALF
    # Distinct terms of each half, and the sum of their bounds in each range of parts.
    known = ids < none
    pairs = np.unique(half[known] * (none + 1) + ids[known])
    n = int(halves.sum())
    own_half, own_term = pairs // (none + 1), pairs % (none + 1)
    bounds = np.zeros((n + 1, index.range_max.shape[1]), np.float32)
    starts = np.flatnonzero(np.append(True, own_half[1:] != own_half[:-1])) if len(pairs) else np.zeros(0, int)
    for a in range(0, len(starts), 4096):
        s = starts[a:a + 4096]
        stop = starts[a + 4096] if a + 4096 < len(starts) else len(pairs)
        bounds[own_half[s]] = np.add.reduceat(index.range_max[own_term[s[0]:stop]], s - s[0], axis=0)
    half_row = np.repeat(np.arange(len(words)), halves)
    same = np.append(half_row[1:] == half_row[:-1], False) if n else np.zeros(0, bool)
    both = bounds[:n] + np.where(same[:, None], bounds[1:], 0)
    # The last half starts a passage of its own only where it is the text's only one.
    alone = halves[half_row] == 1 if n else np.zeros(0, bool)
    possible = np.flatnonzero((both.max(axis=1, initial=0) >= least - 1e-5) & (same | alone))
    found: dict[int, dict[int, tuple[float, float, float]]] = {}
    of, here, seen = -1, set(), set()  # the text at hand, its shingles and the items verified in it
    for h in possible.tolist():
        r = int(half_row[h])
        at = (h - half_first[r]) * HALF
        terms = sorted({t for t in map(get, words[r][at:at + 2 * HALF]) if t is not None})
        for part, _ in index.wand(terms, least):
            if of != r:
                of, here, seen = r, shingles(words[r]), set()
            own = index.parts[part][:2]
            if own in seen:
                continue
            seen.add(own)
            overlap = index.verified(part, words[r], here)
            if overlap is not None:
                found.setdefault(r, {})[own[0]] = max(overlap, found.get(r, {}).get(own[0], overlap))
    return found


def searched(rows: DataFrame, items: DataFrame, item_col: str, text_col: str, search) -> DataFrame:
    """``rows`` through ``search(index)``, one shipped index of about ``INDEX_ITEMS`` items, dealt by hash, after
    another; between two of them the rows are written, so a stage holds a single index."""
    spark = rows.sparkSession
    listed = (items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
              .where("item is not null and text is not null").distinct())
    blocks = -(-listed.count() // INDEX_ITEMS)
    for b in range(blocks):
        share = listed.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).collect()
        shipped = spark.sparkContext.broadcast(Index(sorted((r.item, r.text) for r in share)))
        rows = rows.mapInArrow(search(shipped), rows.schema)
        if b + 1 < blocks:
            rows = written(rows, "decontamination")
            shipped.unpersist()
    return rows


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """Rows (doc_id, items, overlap, question_overlap, answer_overlap), one per document: the sorted ids of
    the test items that it holds, and the shares of shingles of the item with the greatest one;
    an empty list and 0 where it holds none.

    Null and wordless texts hold no items; null and wordless items are in no document; repeated
    items and rows are kept; without items every list is empty; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.select("doc_id", "text", F.array().cast("array<long>").alias("items"), *[F.lit(0.0).alias(c) for c in OVERLAPS])
    out = searched(out, items, item_col, item_text_col, lambda index: searcher(index, least))
    return out.select("doc_id", F.array_sort("items").alias("items"), *OVERLAPS)


def searcher(shipped, least: float):
    def search(batches):
        index = shipped.value
        for batch in in_slices(batches, "text", 4 << 20):
            found = passages(index, texts_of(batch, "text"), least)
            held = batch.column("items").to_pylist()
            overlaps = list(zip(*(batch.column(c).to_pylist() for c in OVERLAPS)))
            for r, items in found.items():
                held[r] = sorted({*held[r], *items})
                overlaps[r] = max([overlaps[r], *items.values()])
            columns = zip(*overlaps) if overlaps else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(held, pa.list_(pa.int64())),
                 *(pa.array(c, pa.float64()) for c in columns)], ["doc_id", "text", "items", *OVERLAPS])
    return search


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no test item; no shuffle."""
    def keeper(shipped):
        def keep(batches):
            index = shipped.value
            for batch in in_slices(batches, text_col, 4 << 20):
                clean = np.ones(batch.num_rows, bool)
                clean[list(passages(index, texts_of(batch, text_col), least))] = False
                yield batch.filter(pa.array(clean))
        return keep

    return searched(docs, items, item_col, item_text_col, keeper)
