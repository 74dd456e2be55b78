"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ctrkit.session import scratch_path

#: Text bytes that a task works on at a time: bounds the memory of every vectorised step.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to a fresh folder of the shared directory and reread it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_slices(batches, text_col: str, limit: int = SLICE_BYTES):
    """Cut record batches so that the texts of a piece hold about ``limit`` bytes at most.

    A longer single text makes a piece of its own; no text is cut.
    """
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start, n = 0, batch.num_rows
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Return what Arrow and the C library hold in reserve: a worker stays on after its task, beside those of the
    next stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
    if trim is not None:
        trim(0)


def texts_of(batch: pa.RecordBatch, col: str) -> pa.Array:
    """The texts as Arrow strings, null as the empty text."""
    return pc.fill_null(batch.column(col), "")


def process_store(name: str) -> dict:
    """A dictionary that outlives the task within its Python worker (a cache, never state)."""
    module = sys.modules.setdefault("_ctrkit_llm_process", types.ModuleType("_ctrkit_llm_process"))
    return module.__dict__.setdefault(name, {})


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_residue(col: str, mod: int):
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % mod
