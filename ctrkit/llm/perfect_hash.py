"""Minimal perfect hashing of 64-bit keys, built by Spark in blocks of keys.

A key's block follows from its hash. Within a block every level has a bit array: keys that have
a slot to themselves set its bit, the others go on to the next level. A key's index is the
number of bits set before its own over all blocks, so the indexes of n keys are 0 to n - 1. The
keys are stored in the order of their indexes; a lookup compares them, so a key that was not
hashed is known to be absent.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ctrkit.llm.common import partitions, written

#: Keys of a block on average, and slots of a level for a key that it has to place.
BLOCK_KEYS, SLOTS = 4096, 3.0
BLOCK_SCHEMA = "block long, sizes array<int>, bits binary, keys binary"


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Well-spread unsigned 64-bit hashes of 64-bit keys."""
    x = keys.astype(np.uint64) + np.uint64((seed + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def within(hashes: np.ndarray, size) -> np.ndarray:
    """Hashes brought to 0 to size - 1 by their upper halves."""
    return ((hashes >> np.uint64(32)) * np.asarray(size, np.uint64) >> np.uint64(32)).astype(np.int64)


def hashed_block(keys: np.ndarray) -> tuple[list[int], bytes, np.ndarray]:
    """(slots of every level, the packed bits of all levels, the keys by index)."""
    sizes, bits, placed = [], [], []
    while len(keys):
        size = max(8, int(SLOTS * len(keys)) + 1)
        slot = within(mixed(keys, len(sizes) + 1), size)
        alone = np.bincount(slot, minlength=size)[slot] == 1
        own = np.zeros(size, np.uint8)
        own[slot[alone]] = 1
        placed.append(keys[alone][np.argsort(slot[alone])])
        sizes.append(size)
        bits.append(own)
        keys = keys[~alone]
    return sizes, np.packbits(np.concatenate(bits)).tobytes(), np.concatenate(placed)


def build(keys: DataFrame, n_blocks: int, col: str = "key") -> DataFrame:
    """Rows of ``BLOCK_SCHEMA``, one per block that has keys, of distinct keys that are not null."""
    def assign(batches):
        for batch in batches:
            k = batch.column(0).to_numpy()
            block = within(mixed(k, 0), n_blocks)
            yield pa.RecordBatch.from_pydict({"block": block, "key": k})

    def make(batches):
        def row(block, held):
            sizes, bits, placed = hashed_block(np.concatenate(held))
            return pa.RecordBatch.from_pylist([{"block": block, "sizes": sizes, "bits": bits,
                                                "keys": placed.astype("<i8").tobytes()}], out)
        out = pa.schema([("block", pa.int64()), ("sizes", pa.list_(pa.int32())), ("bits", pa.binary()), ("keys", pa.binary())])
        now, held = None, []
        for batch in batches:
            blocks, ks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(blocks)) + 1
            for b, part in zip(blocks[np.concatenate([[0], cuts])] if len(blocks) else [], np.split(ks, cuts)):
                if held and b != now:
                    yield row(now, held)
                    held = []
                now = int(b)
                held.append(part)
        if held:
            yield row(now, held)

    placed = keys.select(F.col(col).cast("long")).mapInArrow(assign, "block long, key long")
    return written(placed.repartition(partitions(keys.sparkSession), "block").sortWithinPartitions("block", "key")
                   .mapInArrow(make, BLOCK_SCHEMA), "perfect-hash")


def collected(rows: list, first: int, last: int, n_blocks: int) -> dict:
    """The blocks ``first`` to before ``last`` as plain arrays, to be shipped with a job."""
    rows = sorted(rows, key=lambda r: r["block"])
    depth = max((len(r["sizes"]) for r in rows), default=1)
    sizes = np.zeros((last - first, depth), np.int64)
    for r in rows:
        sizes[r["block"] - first, :len(r["sizes"])] = r["sizes"]
    starts = (np.cumsum(sizes.ravel()) - sizes.ravel()).reshape(sizes.shape)
    bits = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=sum(r["sizes"])) for r in rows]
    flat = np.concatenate(bits) if bits else np.zeros(0, np.uint8)
    return {"first": first, "last": last, "n_blocks": n_blocks, "sizes": sizes, "starts": starts, "bits": flat,
            "rank": (np.cumsum(flat, dtype=np.int64) - flat).astype(np.int32),
            "keys": np.frombuffer(b"".join(r["keys"] for r in rows), "<i8")}


def indexes(table: dict, keys: np.ndarray) -> np.ndarray:
    """Indexes of keys among the collected ones, -1 for keys that are not among them."""
    out = np.full(len(keys), -1, np.int64)
    block = within(mixed(keys, 0), table["n_blocks"])
    todo = np.flatnonzero((block >= table["first"]) & (block < table["last"]))
    block, left = block[todo] - table["first"], keys[todo]
    for level in range(table["sizes"].shape[1]):
        size = table["sizes"][:, level][block]
        has = size > 0
        if not has.all():
            todo, block, left, size = todo[has], block[has], left[has], size[has]
        if not len(todo):
            break
        at = table["starts"][:, level][block] + within(mixed(left, level + 1), size)
        hit = table["bits"][at] == 1
        out[todo[hit]] = table["rank"][at[hit]]
        miss = ~hit
        todo, block, left = todo[miss], block[miss], left[miss]
    known = np.flatnonzero(out >= 0)
    out[known[table["keys"][out[known]] != keys[known]]] = -1
    return out
