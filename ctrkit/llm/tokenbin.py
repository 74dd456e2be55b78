"""Operator 2: token ids as flat binary shards with 64-bit document offsets.

A shard is three files: ``.bin`` (the ids of its documents in turn, unsigned 16 or 32 bits,
little-endian), ``.idx`` (n + 1 unsigned 64-bit offsets of the documents in it) and ``.doc``
(the 64-bit document ids, then one byte each that is 0 for a null id). Shards follow one
another in ascending document id. The manifest table holds one row per shard; its ``base``,
the number of ids in all shards before it, is a prefix sum over the shards' counts, so the
place of a document in the whole stream is its shard's base plus its offset.
"""

from __future__ import annotations

import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ctrkit.llm.bpe import UnitEncoder
from ctrkit.llm.common import in_slices, partitions, texts_of

SHARD_SCHEMA = "shard long, name string, n_docs long, n_tokens long"
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Rows that the reader puts out at a time.
READ_ROWS = 4096


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder of the cluster, and the path in it."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def width_for(tokenizer_path: str, end_id: int) -> str:
    """The narrower of the two id widths that holds every id of the vocabulary file and the end id."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    top = max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))])
    return "<u2" if top < 1 << 16 else "<u4"


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int,
                 id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> str:
    """Encode every whole text, end each with ``end_id``, write shards; returns the manifest's path.

    Null texts are empty and hold the end id alone; a null id comes first; rows with the same
    id follow the order of their texts' hash; an empty table gives a manifest without rows;
    other columns are ignored. A task that runs again writes files under new names, and the
    manifest, written by Spark's committer, names only those of the attempt that counted.
    """
    spark = docs.sparkSession
    width = width_for(tokenizer_path, end_id)
    ordered = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
               .repartitionByRange(shards or partitions(spark), "id")
               .sortWithinPartitions("id", F.xxhash64("text")))

    def write(batches):
        encoder = UnitEncoder(tokenizer_path)
        store, root = file_system(folder)
        name = uuid.uuid4().hex
        out, docs_at, ids, known, at = None, [np.zeros(1, "<u8")], [], [], 0
        for batch in in_slices(batches, "text"):
            flat, offsets = encoder.encode(texts_of(batch, "text"))
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}.bin")
            ends = offsets[1:] + np.arange(1, len(offsets))
            out.write(np.insert(flat, offsets[1:], end_id).astype(width).tobytes())
            docs_at.append((at + ends).astype("<u8"))
            at += int(ends[-1])
            ids.append(batch.column("id").fill_null(0).to_numpy().astype("<i8"))
            known.append(batch.column("id").is_valid().to_numpy(zero_copy_only=False).astype("u1"))
        if out is not None:
            out.close()
            with store.open_output_stream(f"{root}/{name}.idx") as f:
                f.write(np.concatenate(docs_at).tobytes())
            with store.open_output_stream(f"{root}/{name}.doc") as f:
                f.write(np.concatenate(ids).tobytes() + np.concatenate(known).tobytes())
            yield pa.RecordBatch.from_pydict({
                "shard": [TaskContext.get().partitionId()], "name": [name],
                "n_docs": [sum(map(len, ids))], "n_tokens": [at]})

    written = f"{folder}/counts"
    ordered.mapInArrow(write, SHARD_SCHEMA).write.parquet(written)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    manifest = (spark.read.schema(SHARD_SCHEMA).parquet(written)  # one row per shard
                .withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")))
    manifest.write.parquet(f"{folder}/manifest")
    return f"{folder}/manifest"


def read_shards(spark: SparkSession, folder: str, width: str) -> DataFrame:
    """One row per document from the files: where its ids start, how many, and their crc32."""
    shards = spark.read.parquet(f"{folder}/manifest")

    def read(batches):
        store, root = file_system(folder)
        local = isinstance(store, pafs.LocalFileSystem)

        def opened(name: str, dtype: str) -> np.ndarray:
            if local:
                return np.memmap(f"{root}/{name}", dtype, mode="r")
            with store.open_input_file(f"{root}/{name}") as f:
                return np.frombuffer(f.read_buffer(), dtype)

        for row in (r for b in batches for r in b.to_pylist()):
            ids, at = opened(f"{row['name']}.bin", width), opened(f"{row['name']}.idx", "<u8")
            n = row["n_docs"]
            names = opened(f"{row['name']}.doc", "u1")
            doc, known = names[:8 * n].view("<i8"), names[8 * n:].astype(bool)
            for lo in range(0, n, READ_ROWS):
                hi = min(n, lo + READ_ROWS)
                edges = at[lo:hi + 1].astype(np.int64)
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(edges, edges[1:])]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(doc[lo:hi].astype(np.int64), mask=~known[lo:hi]),
                    "start": edges[:-1] + row["base"], "n_tokens": np.diff(edges),
                    "ids_crc32": pa.array(crc, pa.int64())})

    many = max(1, min(partitions(spark), 10_000))
    return shards.select("name", "n_docs", "base").repartition(many).mapInArrow(read, READ_SCHEMA)


def encode_to_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards and read every document back from them."""
    write_shards(docs, folder, tokenizer_path, end_id, id_col, text_col)
    return read_shards(docs.sparkSession, folder, width_for(tokenizer_path, end_id))
