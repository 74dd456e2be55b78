"""Operator 13: Merkle dataset manifest in van Emde Boas layout.

Every document is a leaf; the leaves of a source, in ascending order of ids, form a tree in which
``FAN`` consecutive nodes have one parent, and the sources' roots form one more such tree. H is
the lower-case hex sha256 of its inputs in turn, digests as hex text.

The manifest holds a tree as tables of blocks, one table per layer. A block is an aligned
subtree of ``LEVELS`` steps, stored as one string of raw digests in van Emde Boas order: a tree
of nodes is split at half its height, its top part comes first and then every subtree under it,
each laid out in the same way. As only the last subtree of a level may be short, the address of
a node follows from arithmetic alone (``address``; ``layout`` gives those of whole levels).
Blocks are built from their leaves by these addresses, and siblings are read back by them. The
blocks' roots are the leaves of the next layer, until one block is left.

On Spark: documents are hashed in one pass, numbered by an exact ordered scan, and shuffled by
(tree, block), so a source of any size spreads over many tasks and a task holds one block at a
time. Proofs go the other way: from the last layer down, a block hands the siblings above it to
the blocks below by an equi-join of block rows, and only the lowest layer works by document.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ctrkit.llm.common import partitions, written
from ctrkit.operators.ranking import ordered_scan

FAN = 16
#: Steps from a block's leaves to its root; a block has at most FAN ** LEVELS leaves.
LEVELS = 3
#: Blocks that a partition holds at most, on average.
PARTITION_BLOCKS = 256
#: Block rows that a task puts out at a time.
OUT_BLOCKS = 32
FIELDS = "doc_id", "source", "lang", "n_chars", "text"
DIGEST = 32
BLOCK_SCHEMA = "tree string, block long, n int, height int, nodes binary, root binary, ids binary, claims binary"
PATH_SCHEMA = "tree string, pos long, lefts array<int>, rights array<int>, siblings binary, subroot binary, root binary"
PROOF_SCHEMA = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, "
                "verified boolean")


# ------------------------------------------------------------------------------- addresses
def steps(n: int) -> int:
    """Steps that bring ``n`` nodes to one."""
    h = 0
    while n > 1:
        n, h = -(-n // FAN), h + 1
    return h


def nodes_of(n: int, rows: int) -> int:
    """Nodes of a tree of ``rows`` levels of nodes whose lowest has ``n``."""
    total = 0
    for _ in range(rows):
        total, n = total + n, -(-n // FAN)
    return total


def address(n: int, rows: int, level: int, index: int) -> int:
    """Place of node ``index`` of ``level`` (0: leaves) in a tree of ``rows`` levels over ``n`` leaves."""
    at = 0
    while rows > 1:
        low = rows // 2
        span = FAN ** (low - 1)
        trees = -(-n // span)
        above = -(-trees // FAN)
        if level >= low:
            n, rows, level = above, rows - low, level - low
            continue
        own = index // FAN ** (low - 1 - level)
        at += nodes_of(above, rows - low) + own * nodes_of(span, low)
        index -= own * FAN ** (low - 1 - level)
        n, rows = min(span, n - own * span), low
    return at + index


@lru_cache(maxsize=512)
def layout(n: int, rows: int) -> tuple[np.ndarray, ...]:
    """The addresses of all nodes, level by level."""
    if rows == 1:
        return (np.arange(n),)
    low = rows // 2
    span = FAN ** (low - 1)
    trees = -(-n // span)
    above = layout(-(-trees // FAN), rows - low)
    start = sum(map(len, above))
    full, last = layout(span, low), layout(n - (trees - 1) * span, low)
    begin = start + np.arange(trees - 1) * sum(map(len, full))
    end = start + (trees - 1) * sum(map(len, full))
    below = tuple(np.concatenate([(begin[:, None] + f).ravel(), end + x]) for f, x in zip(full, last))
    return (*below, *above)


# ------------------------------------------------------------------------------- blocks
def built(leaves: bytes, height: int) -> tuple[bytes, bytes]:
    """(the nodes of a block in their places, its root) of raw leaf digests."""
    level = np.frombuffer(leaves, np.uint8).reshape(-1, DIGEST)
    places = layout(len(level), height + 1)
    nodes = np.empty((sum(map(len, places)), DIGEST), np.uint8)
    nodes[places[0]] = level
    for at in places[1:]:
        text = level.tobytes().hex().encode()
        run = 2 * DIGEST * FAN
        level = np.frombuffer(b"".join(sha256(text[i:i + run]).digest() for i in range(0, len(text), run)),
                              np.uint8).reshape(-1, DIGEST)
        nodes[at] = level
    return nodes.tobytes(), level[0].tobytes()


def levels_of(n: int, height: int, nodes: bytes) -> list[bytes]:
    """The digests of a block's levels as hex text, read by their addresses."""
    stored = np.frombuffer(nodes, np.uint8).reshape(-1, DIGEST)
    return [stored[at].tobytes().hex().encode() for at in layout(n, height + 1)]


def siblings_at(levels: list[bytes], index: int):
    """(left, right) siblings of a leaf, level by level up to the block's root."""
    size = 2 * DIGEST
    for text in levels[:-1]:
        run = index // FAN * FAN
        yield text[run * size:index * size], text[(index + 1) * size:(run + FAN) * size]
        index //= FAN


def folded(leaf: bytes, path) -> bytes:
    """The root that follows from a leaf (hex) and its siblings."""
    for left, right in path:
        leaf = sha256(left + leaf + right).hexdigest().encode()
    return leaf


def _blocks(batches):
    """Blocks from rows sorted by (tree, block, place): a block begins where place is 0."""
    def record(rows):
        table = pa.Table.from_batches(rows)
        n, block = table.num_rows, table["block"][0].as_py()
        # A block after the first, or a full one, is part of a larger tree or fills its own.
        height = LEVELS if block else steps(n)
        nodes, root = built(b"".join(table["leaf"].to_pylist()), height)
        known = table["id"].is_valid().combine_chunks().to_numpy(zero_copy_only=False).astype("u1")
        ids = table["id"].fill_null(0).to_numpy().astype("<i8")
        claims = table["claim"].to_pylist()
        some = np.array([c is not None for c in claims], "u1").tobytes()
        return {"tree": table["tree"][0].as_py(), "block": block, "n": n, "height": height, "nodes": nodes, "root": root,
                "ids": ids.tobytes() + known.tobytes(), "claims": some + b"".join(c for c in claims if c is not None)}

    held, out = [], []
    schema = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int32()), ("height", pa.int32()),
                        ("nodes", pa.binary()), ("root", pa.binary()), ("ids", pa.binary()), ("claims", pa.binary())])
    for batch in batches:
        starts = np.flatnonzero(batch.column("place").to_numpy() == 0).tolist()
        for i, (a, b) in enumerate(zip([0, *starts], [*starts, batch.num_rows])):
            if i and held:
                out.append(record(held))
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
            if len(out) == OUT_BLOCKS:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
    if held:
        out.append(record(held))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def build_layer(leaves: DataFrame, blocks: int = 0) -> DataFrame:
    """Block rows of (tree, pos, leaf, id, claim): positions of a tree run from 0 without gaps."""
    span = FAN ** LEVELS
    rows = leaves.select("tree", F.floor(F.col("pos") / span).cast("long").alias("block"),
                         (F.col("pos") % span).cast("int").alias("place"), "leaf", "id", "claim")
    n = max(partitions(leaves.sparkSession), blocks // PARTITION_BLOCKS)
    return written(rows.repartition(n, "tree", "block").sortWithinPartitions("tree", "block", "place")
                   .mapInArrow(_blocks, BLOCK_SCHEMA), "merkle")


def build_layers(leaves: DataFrame) -> list[DataFrame]:
    """All layers of the trees in ``leaves``, until each is one block."""
    layers = [build_layer(leaves)]
    while not layers[-1].where("block > 0").isEmpty():
        layers.append(build_layer(layers[-1].select(
            "tree", F.col("block").alias("pos"), F.col("root").alias("leaf"), F.lit(None).cast("long").alias("id"),
            F.lit(None).cast("binary").alias("claim"))))
    return layers


# ------------------------------------------------------------------------------- manifest
def field(col: str | Column) -> Column:
    """A value as it is hashed: its bytes counted, or ``-`` for null."""
    text = (F.col(col) if isinstance(col, str) else col).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(**changed: Column) -> Column:
    """Raw digest of a document; ``changed`` columns stand in for its own."""
    return F.unhex(F.sha2(F.concat(*[field(changed.get(c, c)) for c in FIELDS]), 256))


def lowered(text: str) -> Column:
    """A-Z in lower case, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


@dataclass
class Manifest:
    """Block tables of the sources' trees and of the tree over them, lowest layer first; ``places`` has the
    position of every source's tree in the latter."""
    sources: list[DataFrame]
    top: list[DataFrame]
    places: DataFrame


def build(docs: DataFrame, claim: Column | None = None) -> Manifest:
    """The manifest of a table with the columns ``FIELDS``.

    ``claim`` is a raw leaf digest to prove in the document's place, null for its own. A null source is a
    source of its own and comes first; null ids come first in their source; rows of one id follow
    the order of their digests; other columns are ignored; an empty table has no blocks.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    rows = written(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf_digest().alias("leaf"),
                               (F.lit(None) if claim is None else claim).cast("binary").alias("claim")), "merkle-leaves")
    placed = ordered_scan(rows, [F.col("id").asc_nulls_first(), F.col("leaf").asc()], ["tree"], index_col="pos")
    sources = build_layers(placed)
    places = written(ordered_scan(sources[-1].select("tree", F.col("root").alias("leaf")), [F.col("tree").asc()],
                                  index_col="pos"), "merkle-places")
    top = build_layers(places.select(F.lit("").alias("tree"), "pos", "leaf", F.lit(None).cast("long").alias("id"),
                                     F.lit(None).cast("binary").alias("claim")))
    return Manifest(sources, top, places)


def _with_paths(layer: DataFrame, paths: DataFrame) -> DataFrame:
    """Block rows with the siblings above them."""
    n = max(partitions(layer.sparkSession), layer.count() // PARTITION_BLOCKS)
    above = paths.withColumnRenamed("pos", "block").withColumnRenamed("root", "top_root")
    return layer.repartition(n, "tree", "block").join(above, ["tree", "block"])


def descend(layer: DataFrame, paths: DataFrame) -> DataFrame:
    """The paths of a layer's leaves, from those of its blocks."""
    def expand(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                levels = levels_of(r["n"], r["height"], r["nodes"])
                rows = []
                for k in range(r["n"]):
                    own = list(siblings_at(levels, k))
                    rows.append({
                        "tree": r["tree"], "pos": r["block"] * FAN ** LEVELS + k,
                        "lefts": [len(a) // (2 * DIGEST) for a, _ in own] + r["lefts"],
                        "rights": [len(b) // (2 * DIGEST) for _, b in own] + r["rights"],
                        "siblings": bytes.fromhex(b"".join(a + b for a, b in own).decode()) + r["siblings"],
                        "subroot": r["subroot"], "root": r["top_root"]})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([
                    ("tree", pa.string()), ("pos", pa.int64()), ("lefts", pa.list_(pa.int32())),
                    ("rights", pa.list_(pa.int32())), ("siblings", pa.binary()), ("subroot", pa.binary()),
                    ("root", pa.binary())]))

    return written(_with_paths(layer, paths).mapInArrow(expand, PATH_SCHEMA), "merkle-paths")


def upper_path(lefts: list[int], rights: list[int], siblings: bytes) -> list[tuple[bytes, bytes]]:
    """(left, right) siblings as hex text of a stored path."""
    text, out, at = siblings.hex().encode(), [], 0
    for a, b in zip(lefts, rights):
        mid, end = at + a * 2 * DIGEST, at + (a + b) * 2 * DIGEST
        out.append((text[at:mid], text[mid:end]))
        at = end
    return out


def _proofs(batches):
    """One row per document of the lowest blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            n, levels = r["n"], levels_of(r["n"], r["height"], r["nodes"])
            above = upper_path(r["lefts"], r["rights"], r["siblings"])
            tail = b"".join(a + b for a, b in above)
            ids, known = np.frombuffer(r["ids"][:8 * n], "<i8"), np.frombuffer(r["ids"][8 * n:], "u1").astype(bool)
            claimed = np.frombuffer(r["claims"][:n], "u1")
            other = iter(np.frombuffer(r["claims"][n:], np.uint8).reshape(-1, DIGEST))
            leaves, proofs, roots = [], [], []
            for k in range(n):
                leaf = levels[0][k * 2 * DIGEST:(k + 1) * 2 * DIGEST]
                own = list(siblings_at(levels, k))
                proofs.append(sha256(b"".join(a + b for a, b in own) + tail).hexdigest())
                leaves.append(leaf.decode())
                shown = next(other).tobytes().hex().encode() if claimed[k] else leaf
                roots.append(folded(shown, own + above).decode())
            root = r["top_root"].hex()
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64(), mask=~known), "leaf": leaves, "subroot": [r["subroot"].hex()] * n,
                "root": [root] * n, "proof_sha256": proofs, "folded_root": roots,
                "verified": pa.array([x == root for x in roots], pa.bool_())})


def prove(manifest: Manifest) -> DataFrame:
    """One row per document: its leaf, its source's root, the root, the H of its siblings up to the root, and
    the root that follows from the claimed leaf and those siblings."""
    none = F.array().cast("array<int>")
    paths = manifest.top[-1].select("tree", F.lit(0).cast("long").alias("pos"), none.alias("lefts"), none.alias("rights"),
                                    F.lit(b"").alias("siblings"), F.lit(None).cast("binary").alias("subroot"), "root")
    for layer in reversed(manifest.top):
        paths = descend(layer, paths)
    # The leaves of the top tree are the roots of the sources' trees.
    paths = paths.drop("tree", "subroot").join(manifest.places.withColumnRenamed("leaf", "subroot"), "pos").select(
        "tree", F.lit(0).cast("long").alias("pos"), "lefts", "rights", "siblings", "subroot", "root")
    for layer in reversed(manifest.sources[1:]):
        paths = descend(layer, paths)
    return _with_paths(manifest.sources[0], paths).mapInArrow(_proofs, PROOF_SCHEMA)
