"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ctrkit.llm import (align, decontaminate, html_text, imatch, langid, merkle, oracles, packing, pii, secrets, simhash, substrings,
                        tokenbin, toxicity)
from ctrkit.llm.common import crc_residue, table
from ctrkit.llm.data import (FILE_END, LANGUAGE_HELD_OUT, PIECE_MODEL, SEQUENCE_END, TOXIC_HELD_OUT, held_out,
                              tokenizer_path)
from ctrkit.llm.registry import register
from ctrkit.session import scratch_path

#: Op 13 tampers with documents whose id's crc32 this number divides.
TAMPERED = 5


@register("op2_token_files")
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return tokenbin.encode_to_files(docs, scratch_path(spark, "tokens"), tokenizer_path(), FILE_END)


@register("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return (simhash.near_duplicates(docs)
            .select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"))


@register("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, tokenizer_path(), SEQUENCE_END)


@register("op9_substrings")
def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return substrings.dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@register("op6_secrets")
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text")).drop("masked")


@register("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@register("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held_out(*TOXIC_HELD_OUT))
    scored = toxicity.score(docs, toxicity.train(docs.where(~held_out(*TOXIC_HELD_OUT)), labels))
    return scored.select("doc_id", held_out(*TOXIC_HELD_OUT).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


@register("op5_language")
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.train(docs.where(~held_out(*LANGUAGE_HELD_OUT)))
    return langid.identify(docs, model).select(
        "doc_id", held_out(*LANGUAGE_HELD_OUT).alias("held_out"), "lang_pred", "score")


@register("op3_decontamination")
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents", "doc_id", "text"),
                              table(spark, sf_dir, "benchmark", "item_id", "text"))


@register("op4_imatch")
def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


@register("op11_pii", oracles.pii())
def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents", "doc_id", "text")))


@register("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return align.align(docs, tokenizer_path(), tokenizer_path(PIECE_MODEL)).drop("a", "b")


@register("op13_merkle", oracles.MERKLE)
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", *merkle.FIELDS)
    tampered = F.when(crc_residue("doc_id", TAMPERED) == 0, merkle.leaf_digest(text=merkle.lowered("text")))
    return merkle.prove(merkle.build(docs, tampered))


register("pipeline")(corpus_pipeline.run)
