"""Operator 12: alignment of two tokenizers over a corpus, with counts of linked id pairs.

A text is encoded by a byte-level BPE (A) and a piece model with byte fallback (B) of the same
bytes. Places where tokens of both end cut the tokens into groups; an A and a B token are linked
if their bytes overlap. Counts are over all documents:

1. Encode every document once, align it and write its ids (``encoded``).
2. Hash the distinct pairs: minimal perfect hash, blocks of keys built in tasks (``perfect_hash``).
3. Count: every task re-aligns its documents from the ids and adds the links up in a dense vector
   indexed by hash; the vectors are summed as a tree, ``FAN`` to one, in pieces.
4. Look up: the documents are re-aligned once more and read the counts of their links.

The hash and its counts are shipped for at most about ``SHARD_BLOCKS`` blocks of pairs at a time;
with more pairs than that, steps 3 and 4 run once per such shard, and what a task holds stays the
same. The highest count of a B id is a vector over B's vocabulary.

Both models cut a text before a single space, so a space-led word has the same ids in every
text; a worker encodes it once and remembers them. Texts with other runs of spaces go whole.
"""

from __future__ import annotations

from array import array
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrkit.llm import perfect_hash
from ctrkit.llm.bpe import UnitEncoder, byte_alphabet
from ctrkit.llm.common import in_slices, partitions, process_store, texts_of, written

#: Words whose ids a worker remembers in each of its two dictionaries, the young and the old one.
CACHE_WORDS = 300_000
#: The entry of a word or text without tokens.
NONE = 0xFFFFFFFF
NO_TOKENS = array("I", [NONE]).tobytes()
#: Hash blocks (of about 4096 pairs) that are shipped at a time, entries of a vector's piece, vectors summed to one.
SHARD_BLOCKS, PIECE, FAN = 512, 1024, 32
#: Text bytes that a task encodes and id bytes that it aligns at a time.
TEXT_BYTES, SLICE_BYTES = 1 << 20, 1 << 19
SPACE = "▁"
ENCODED_SCHEMA = "doc_id long, a binary, b binary, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
VECTOR_SCHEMA = "piece int, part long, sums binary"


# ------------------------------------------------------------------------------- vocabularies
def a_bytes(path: str) -> list[bytes]:
    """Bytes of A's ids."""
    from tokenizers import Tokenizer
    to = {c: b for b, c in byte_alphabet().items()}
    vocab = Tokenizer.from_file(path).get_vocab()
    out = [b""] * (max(vocab.values()) + 1)
    for entry, i in vocab.items():
        out[i] = bytes(to[c] for c in entry)
    return out


def b_bytes(path: str) -> list[bytes]:
    """Bytes of B's ids."""
    from sentencepiece import SentencePieceProcessor
    model = SentencePieceProcessor(model_file=path)
    return [bytes([int(model.id_to_piece(i)[1:-1], 16)]) if model.is_byte(i)
            else model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(model.get_piece_size())]


def lengths(vocab: list[bytes]) -> np.ndarray:
    return np.array([len(x) for x in vocab], np.int64)


def width(*vocabs: list[bytes]) -> str:
    """The narrower of two id widths that holds every id."""
    return "<u2" if max(map(len, vocabs)) < 1 << 16 else "<u4"


# ------------------------------------------------------------------------------- alignment
def stretches(a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte offsets where the tokens of either kind end, whether an A token ends there, whether a B token does)."""
    ends_a, ends_b = np.cumsum(a_len[a]), np.cumsum(b_len[b])
    mark = np.zeros(int(ends_a[-1]) + 1, np.uint8)
    mark[ends_a] = 1
    mark[ends_b] |= 2
    ends = np.flatnonzero(mark)
    return ends, mark[ends] & 1, mark[ends] >> 1


def linked(a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair keys of all links in turn, byte offsets at which the links' overlaps end).

    Between two neighbouring token ends, of either tokenizer, lies one A and one B token, and no
    two such stretches have the same two: a stretch is a link.
    """
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends, is_a, is_b = stretches(a, b, a_len, b_len)
    at_a = np.cumsum(is_a, dtype=np.int64) - is_a
    at_b = np.cumsum(is_b, dtype=np.int64) - is_b
    return a[at_a].astype(np.int64) << 32 | b[at_b].astype(np.int64), ends


class Aligner:
    """Ids and groups of texts, whole batches at a time."""

    def __init__(self, a_path: str, b_path: str):
        store = process_store("align")
        if (a_path, b_path) not in store:
            from sentencepiece import SentencePieceProcessor
            model = SentencePieceProcessor(model_file=b_path)
            apart = not any(SPACE in model.id_to_piece(i).lstrip(SPACE) for i in range(model.get_piece_size()))
            a_vocab, b_vocab = a_bytes(a_path), b_bytes(b_path)
            # How a token is written before another one of its kind and group, and at the end of those.
            shown = [f"{i}{sign}".encode() for vocab, signs in ((a_vocab, ",|"), (b_vocab, ",;"))
                     for i in range(len(vocab)) for sign in signs]
            store[a_path, b_path] = (model, a_vocab, b_vocab, shown, apart, [{}, {}])
        self.b_model, self.a_vocab, self.b_vocab, self.shown, self.apart, self.known = store[a_path, b_path]
        self.a_model = UnitEncoder(a_path, cache_units=50_000, specials_as_text=True)
        self.dtype = width(self.a_vocab, self.b_vocab)
        self.a_len, self.b_len = lengths(self.a_vocab), lengths(self.b_vocab)

    def checked(self, led: str, a: bytes, b: list[int]) -> bytes:
        """The number of A ids, those and the B ids, or ``NO_TOKENS`` if the bytes of either are not those of
        the text, its leading space included. One string of bytes, so that many can be remembered."""
        raw, a_vocab, b_vocab, of_a = led.encode(), self.a_vocab, self.b_vocab, array("I", a)
        if b"".join([a_vocab[i] for i in of_a]) != raw or b"".join([b_vocab[i] for i in b]) != raw:
            return NO_TOKENS
        return array("I", [len(of_a), *of_a, *b]).tobytes()

    def new_words(self, words: list[str]) -> list[bytes]:
        led = [" " + w for w in words]
        a = list(map(self.a_model._easy, led))
        rest = [i for i, x in enumerate(a) if x is None]
        for i, x in zip(rest, self.a_model.tokenizer.encode_batch_fast([led[i] for i in rest], add_special_tokens=False)):
            a[i] = array("I", x.ids).tobytes()
        return list(map(self.checked, led, a, self.b_model.encode(words, num_threads=1)))

    def words(self, words: list[str]) -> list[bytes]:
        """Entries of words that follow a single space. What was asked for lately is remembered: a full
        young dictionary becomes the old one, and the old one goes."""
        young, old = self.known
        out = list(map(young.get, words))
        new = []
        for i, found in enumerate(out):
            if found is None:
                found = old.get(words[i])
                if found is None:
                    new.append(i)
                else:
                    out[i] = young[words[i]] = found
        for at in range(0, len(new), 10_000):
            part = new[at:at + 10_000]
            for i, entry in zip(part, self.new_words([words[i] for i in part])):
                out[i] = young[words[i]] = entry
        if len(young) > CACHE_WORDS:
            self.known[:] = {}, young
        return out

    def ids(self, texts: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray]:
        """For A and for B (ids of the texts in turn, offsets of the texts in them); whether a text has tokens."""
        hard = pc.or_(pc.match_substring(texts, "  "), pc.or_(pc.starts_with(texts, " "), pc.ends_with(texts, " ")))
        hard = hard.to_numpy(zero_copy_only=False) | (not self.apart)
        pieces = pc.split_pattern(pc.if_else(pa.array(hard), "", texts), " ")
        starts = pieces.offsets.to_numpy().astype(np.int64) - pieces.offsets[0].as_py()
        coded = pc.dictionary_encode(pieces.flatten())
        index, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        # The empty word is an empty text, or stands in the place of one that goes whole.
        self.known[0][""] = NO_TOKENS
        units = self.words(words)
        whole = np.flatnonzero(hard)
        index[starts[:-1][whole]] = len(units) + np.arange(len(whole))
        for i in whole.tolist():
            text = texts[i].as_py()
            a = self.a_model.tokenizer.encode(" " + text, add_special_tokens=False).ids
            units.append(self.checked(" " + text, array("I", a).tobytes(), self.b_model.encode(text, num_threads=1)))
        sizes = np.fromiter(map(len, units), np.int64, len(units)) // 4
        pool, begin = np.frombuffer(b"".join(units), "<u4"), np.cumsum(sizes) - sizes
        ok = pool[begin] != NONE if len(units) else np.zeros(0, bool)
        of_a = np.where(ok, pool[begin], 0).astype(np.int64) if len(units) else sizes
        valid = np.logical_and.reduceat(ok[index], starts[:-1]) if len(texts) else np.zeros(0, bool)
        return (gathered(pool, begin + 1, of_a, index, starts), gathered(pool, begin + 1 + of_a, sizes - 1 - of_a, index, starts), valid)

    def encode(self, texts: pa.Array) -> dict:
        """Columns of ``ENCODED_SCHEMA`` but the id."""
        (a, a_at), (b, b_at), valid = self.ids(texts)
        a, n_a = kept(a, a_at, valid)
        b, n_b = kept(b, b_at, valid)
        n_groups, n_links, hashes = self.groups(a, b, n_a, n_b)
        return {"a": cut(a.astype(self.dtype), n_a), "b": cut(b.astype(self.dtype), n_b), "n_a": n_a, "n_b": n_b,
                "n_groups": n_groups, "n_links": n_links, "groups_sha256": hashes}

    def groups(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(groups, links, hash of the groups) of every text."""
        if not len(a):
            return np.zeros(len(n_a), np.int64), np.zeros(len(n_a), np.int64), [""] * len(n_a)
        ends, is_a, is_b = stretches(a, b, self.a_len, self.b_len)
        common = (is_a & is_b).astype(np.int64)
        group = np.cumsum(common) - common
        of_a, of_b = group[is_a == 1], group[is_b == 1]
        # A group's A tokens stand after the B tokens of the groups before it, its B tokens after its A tokens.
        groups = int(group[-1]) + 1
        until_a, until_b = np.cumsum(np.bincount(of_a, minlength=groups)), np.cumsum(np.bincount(of_b, minlength=groups))
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.concatenate([[0], until_b])[of_a]] = 2 * a.astype(np.int64) + np.append(np.diff(of_a), 1)
        codes[np.arange(len(b)) + until_a[of_b]] = 2 * (len(self.a_vocab) + b.astype(np.int64)) + np.append(np.diff(of_b), 1)
        flat, places = codes.tolist(), np.concatenate([[0], np.cumsum(n_a + n_b)]).tolist()
        hashes = [sha256(b"".join(map(self.shown.__getitem__, flat[s:e]))[:-1]).hexdigest() if e > s else ""
                  for s, e in zip(places, places[1:])]
        last = np.cumsum(n_a)
        upto = np.searchsorted(ends, np.concatenate([[0], np.cumsum(self.a_len[a])])[last], side="right")
        done = np.concatenate([[0], np.cumsum(common)])
        return np.diff(done[np.concatenate([[0], upto])]), np.diff(np.concatenate([[0], upto])), hashes


def gathered(pool: np.ndarray, begin: np.ndarray, sizes: np.ndarray, index: np.ndarray, starts: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of the pool that the index names, in turn; the offsets in them of the index's ``starts``)."""
    counts = sizes[index]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return pool[np.repeat(begin[index] - (ends - counts), counts) + np.arange(total)], np.concatenate([[0], ends])[starts]


def kept(ids: np.ndarray, offsets: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of the valid texts, how many each text has)."""
    counts = np.diff(offsets)
    return ids[np.repeat(valid, counts)], np.where(valid, counts, 0)


def cut(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The ids of every text as bytes."""
    size, flat, ends = ids.dtype.itemsize, ids.tobytes(), np.cumsum(counts).tolist()
    return [flat[s * size:e * size] for s, e in zip([0, *ends], ends)]


def encoded(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One written row per document: its ids of both kinds and its groups."""
    def encode(batches):
        aligner = Aligner(a_path, b_path)
        for batch in in_slices(batches, "text", TEXT_BYTES):
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), **aligner.encode(texts_of(batch, "text"))},
                                             schema=pa.schema([
                                                 ("doc_id", pa.int64()), ("a", pa.binary()), ("b", pa.binary()),
                                                 ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
                                                 ("n_links", pa.int64()), ("groups_sha256", pa.string())]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(encode, ENCODED_SCHEMA), "align-ids")


# ------------------------------------------------------------------------------- corpus counts
def _ids(batch: pa.RecordBatch, col: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(col).to_pylist()), dtype)


def distinct_pairs(rows: DataFrame, a_len: np.ndarray, b_len: np.ndarray, dtype: str) -> DataFrame:
    """The distinct linked pairs, one per row; a task puts each of its own out once."""
    def pairs(batches):
        seen = np.zeros(0, np.int64)
        for batch in in_slices(batches, "a", SLICE_BYTES):
            seen = np.union1d(seen, linked(_ids(batch, "a", dtype), _ids(batch, "b", dtype), a_len, b_len)[0])
        for at in range(0, len(seen), 10_000):
            yield pa.RecordBatch.from_pydict({"key": seen[at:at + 10_000]})

    return written(rows.select("a", "b").mapInArrow(pairs, "key long").distinct(), "align-pairs")


def added(vectors: DataFrame) -> DataFrame:
    """Sums of the vector pieces of the same (piece, part)."""
    def add(batches):
        now, total = None, None
        for batch in batches:
            for piece, part, sums in zip(*(batch.column(c).to_pylist() for c in ("piece", "part", "sums"))):
                own = np.frombuffer(sums, "<i8")
                if (piece, part) != now:
                    if now:
                        yield row(now, total)
                    now, total = (piece, part), own.copy()
                else:
                    total += own
        if now:
            yield row(now, total)

    def row(now, total):
        return pa.RecordBatch.from_pydict({"piece": pa.array([now[0]], pa.int32()), "part": [now[1]],
                                           "sums": [total.astype("<i8").tobytes()]})

    n = partitions(vectors.sparkSession)
    return vectors.repartition(n, "piece", "part").sortWithinPartitions("piece", "part").mapInArrow(add, VECTOR_SCHEMA)


def counted(rows: DataFrame, table: dict, a_len: np.ndarray, b_len: np.ndarray, dtype: str) -> DataFrame:
    """How many links hold each pair of the table: pieces of one vector by index, written."""
    spark = rows.sparkSession
    size = len(table["keys"])
    shipped = spark.sparkContext.broadcast(table)

    def vectors(batches):
        known = shipped.value
        total = np.zeros(-(-size // PIECE) * PIECE, np.int64)
        for batch in in_slices(batches, "a", SLICE_BYTES):
            keys, times = np.unique(linked(_ids(batch, "a", dtype), _ids(batch, "b", dtype), a_len, b_len)[0], return_counts=True)
            at = perfect_hash.indexes(known, keys)
            total[at[at >= 0]] += times[at >= 0]
        part = TaskContext.get().partitionId()
        pieces = total.reshape(-1, PIECE)
        for i in np.flatnonzero(pieces.any(axis=1)).tolist():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([i], pa.int32()), "part": pa.array([part], pa.int64()),
                                              "sums": [pieces[i].astype("<i8").tobytes()]})

    summed = written(rows.select("a", "b").mapInArrow(vectors, VECTOR_SCHEMA), "align-vectors")
    parts = (summed.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        summed = added(summed.withColumn("part", F.floor(F.col("part") / FAN).cast("long")))
        parts = -(-parts // FAN)
    summed = written(summed, "align-counts")
    shipped.unpersist()
    return summed


def vector(summed: DataFrame, size: int) -> np.ndarray:
    """The vector of at most ``SHARD_BLOCKS`` blocks of pairs."""
    out = np.zeros(-(-size // PIECE) * PIECE, np.int64)
    for r in summed.select("piece", "sums").collect():
        out[r["piece"] * PIECE:(r["piece"] + 1) * PIECE] = np.frombuffer(r["sums"], "<i8")
    return out[:size]


def looked_up(rows: DataFrame, table: dict, counts: np.ndarray, best: np.ndarray, a_len: np.ndarray, b_len: np.ndarray,
              dtype: str) -> DataFrame:
    """Adds to ``n_best`` and ``count_sum`` what the table's pairs give."""
    is_best = counts == best[table["keys"] & 0xFFFFFFFF] if len(counts) else np.zeros(0, bool)
    shipped = rows.sparkSession.sparkContext.broadcast((table, counts, is_best))
    schema = rows.schema

    def look(batches):
        known, number, top = shipped.value
        for batch in in_slices(batches, "a", SLICE_BYTES):
            a, b = _ids(batch, "a", dtype), _ids(batch, "b", dtype)
            keys, ends = linked(a, b, a_len, b_len)
            at = perfect_hash.indexes(known, keys)
            found = at >= 0
            n, t = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            n[found], t[found] = number[at[found]], top[at[found]]
            # Documents end where the bytes of their A tokens do.
            tokens = np.cumsum(batch.column("n_a").to_numpy())
            upto = np.concatenate([[0], np.cumsum(a_len[a])])[tokens]
            last = np.searchsorted(ends, upto, side="right")
            sums, tops = (np.diff(np.concatenate([[0], x])[np.concatenate([[0], last])]) for x in (np.cumsum(n), np.cumsum(t)))
            done = {"n_best": tops, "count_sum": sums}
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column(c).to_numpy() + done[c], pa.int64()) if c in done else batch.column(c)
                 for c in batch.schema.names], names=batch.schema.names)

    return rows.mapInArrow(look, schema)


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ids of both kinds (``a``, ``b``), their number, groups, links, the hash of the
    groups, links whose pair is the most frequent of its B id, and the sum of the pairs' counts.

    A text that is null or empty, or whose bytes one of the tokenizers does not give back, has no
    tokens. Ids are passed through, null and repeated ones too; rows count as often as they are
    there; an empty table gives no rows; other columns are ignored.
    """
    a_vocab, b_vocab = a_bytes(a_path), b_bytes(b_path)
    a_len, b_len, dtype = lengths(a_vocab), lengths(b_vocab), width(a_vocab, b_vocab)
    rows = encoded(docs, a_path, b_path, id_col, text_col)
    pairs = distinct_pairs(rows, a_len, b_len, dtype)
    n_blocks = max(1, -(-pairs.count() // perfect_hash.BLOCK_KEYS))
    blocks = perfect_hash.build(pairs, n_blocks)
    shards = [(s, min(n_blocks, s + SHARD_BLOCKS)) for s in range(0, n_blocks, SHARD_BLOCKS)]

    def shard(first: int, last: int) -> dict:
        mine = blocks.where(F.col("block").between(first, last - 1))
        return perfect_hash.collected(mine.collect(), first, last, n_blocks)  # SHARD_BLOCKS rows at most

    best, sums = np.zeros(len(b_vocab), np.int64), []
    for s in shards:
        table = shard(*s)
        sums.append(counted(rows, table, a_len, b_len, dtype))
        np.maximum.at(best, table["keys"] & 0xFFFFFFFF, vector(sums[-1], len(table["keys"])))
    rows = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for i, s in enumerate(shards):
        table = shard(*s)
        rows = looked_up(rows, table, vector(sums[i], len(table["keys"])), best, a_len, b_len, dtype)
        if i + 1 < len(shards):
            rows = written(rows, "align-shard")
    return rows
