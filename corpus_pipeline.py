"""Documents to packed training sequences: five stages, each one operator of ``ctrkit.llm``.

A stage takes (spark, docs, sf_dir) and returns the documents that go on, with their columns;
the last returns the pieces of the packed sequences. ``run`` writes every stage's result to the
shared folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ctrkit.llm import decontaminate, packing, secrets, simhash, toxicity
from ctrkit.llm.common import table, written
from ctrkit.llm.data import SEQUENCE_END, TOXIC_HELD_OUT, held_out, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network rejects go; it learns from the labels not held out."""
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out(*TOXIC_HELD_OUT))
    return toxicity.keep_clean(docs, toxicity.train(docs.where(~held_out(*TOXIC_HELD_OUT)), labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked SimHash fingerprints stays."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked and ``n_chars`` counted anew; every document stays."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 2048 tokens."""
    return packing.pack(docs, tokenizer_path(), SEQUENCE_END)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL cannot express the stages; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
